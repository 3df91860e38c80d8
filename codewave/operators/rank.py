"""Exact ranks and exact proportional cuts without a one-task window over the data.

``exact_rank`` cuts the sort order into buckets at literal boundaries, numbers rows
inside each bucket and adds the size of all earlier buckets. The boundaries only
balance the work; the rank is exact whatever they are. A value so frequent that it
fills several buckets gets buckets of its own, cut along the id that breaks the ties.

``kth_smallest`` needs no shuffle of the rows at all: it counts per bucket, keeps the
bucket that holds the k-th row, and repeats until that bucket is small.
"""

from __future__ import annotations

import math
import os
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codewave.operators.joins import lookup, null_safe_join
from codewave.session import stage_table

SELECT_ROWS = 1_000_000
_LARGEST = sys.float_info.max
_LAST_BUCKET = 1_000_000_000


def _buckets(df: DataFrame) -> int:
    return max(2, min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _present(col: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(col), col)


def _sortable(col: Column) -> Column:
    """As a double below infinity, missing values as NaN, which sorts after all others."""
    number = _present(col).cast("double")
    finite = F.when(number > _LARGEST, F.lit(_LARGEST)).otherwise(number)
    return F.coalesce(finite, F.lit(float("nan")))


def _order(col: Column, descending: bool) -> Column:
    return _present(col).desc_nulls_last() if descending else _present(col).asc_nulls_last()


def _id_number(df: DataFrame, ident: str) -> Column:
    """An id as a number that never falls while the id rises; it only serves to cut.

    Of a text these are the six bytes after the beginning that all ids share.
    """
    if not isinstance(df.schema[ident].dataType, StringType):
        return F.col(ident).cast("double")
    ends = [end.encode() for end in df.agg(F.min(ident), F.max(ident)).first() if end is not None]
    shared = len(os.path.commonprefix(ends)) if ends else 0
    differing = F.substring(F.encode(F.col(ident), "UTF-8"), shared + 1, 6)
    return F.conv(F.rpad(F.hex(differing), 12, "0"), 16, 10).cast("double")


@dataclass(frozen=True)
class _Boundaries:
    """Literal cut points of the sort value and of the id."""

    value: list[float]
    ident: list[float]
    heavy: list[int]


def _boundaries(df: DataFrame, value: Column, ident: Column, buckets: int) -> _Boundaries:
    """Approximate quantiles of both columns, in one pass."""
    probs = [i / buckets for i in range(1, buckets)]
    cols = df.select(_sortable(value).alias("v"), ident.cast("double").alias("i"))
    values, idents = cols.approxQuantile(["v", "i"], probs, 0.25 / buckets)
    heavy_values = {v for v, n in Counter(values).items() if n > 1}
    points = set(values) | {math.nextafter(v, math.inf) for v in heavy_values}
    splits = sorted({-math.inf, *points, math.inf})
    heavy = [bisect_right(splits, v) - 1 for v in sorted(heavy_values)]
    idents = [-math.inf, *sorted({v for v in idents if math.isfinite(v)}), math.inf]
    return _Boundaries(splits, idents, heavy)


def _bucketize(df: DataFrame, source: str, target: str, splits: list[float]) -> DataFrame:
    if len(splits) < 3:
        return df.withColumn(target, F.lit(0))
    cut = Bucketizer(splits=splits, inputCol=source, outputCol="_cut", handleInvalid="keep")
    bucket = F.coalesce(F.col("_cut").cast("int"), F.lit(_LAST_BUCKET))
    return cut.transform(df).withColumn(target, bucket).drop("_cut")


def _with_buckets(
    df: DataFrame, value: Column, ident: Column, bounds: _Boundaries, descending: bool
) -> DataFrame:
    """Add ``_b`` (bucket of the value, missing values last) and ``_s`` (of the id)."""
    df = df.withColumns({"_v": _sortable(value), "_i": ident.cast("double")})
    df = _bucketize(df, "_v", "_b", bounds.value)
    df = _bucketize(df, "_i", "_s", bounds.ident)
    split_by_id = F.isnan("_v")
    if bounds.heavy:
        split_by_id = split_by_id | F.col("_b").isin(bounds.heavy)
    position = -F.col("_b") if descending else F.col("_b")
    return df.withColumns(
        {
            "_b": F.when(F.isnan("_v"), F.lit(_LAST_BUCKET)).otherwise(position),
            "_s": F.when(split_by_id, F.col("_s")).otherwise(F.lit(0)),
        }
    ).drop("_v", "_i")


def exact_rank(
    df: DataFrame,
    value: str,
    ident: str,
    *,
    group_by: Sequence[str] = (),
    descending: bool = False,
    tie_break: Sequence[str] = (),
    out: str = "rank",
    size_out: str | None = None,
) -> DataFrame:
    """Add the rank 1..n by ``value`` (missing last), then ``ident``, per group if any.

    ``value`` is numeric, ``ident`` numeric or text; with ``tie_break`` the pair need not be
    unique. One group may hold most rows: groups are split into the same buckets. The size
    of the group comes along as ``size_out``, from the bucket counts.
    """
    number = _id_number(df, ident)
    bounds = _boundaries(df, F.col(value), number, _buckets(df))
    keyed = _with_buckets(df, F.col(value), number, bounds, descending)
    group_keys = {}
    for name in group_by:
        dtype = df.schema[name].dataType.simpleString()
        group_keys[f"_g_{name}"] = F.coalesce(F.col(name), F.lit(0 if dtype != "string" else "").cast(dtype))
        group_keys[f"_n_{name}"] = F.col(name).isNull()
    keyed = keyed.withColumns(group_keys) if group_keys else keyed
    groups = list(group_keys)
    keys = [*groups, "_b", "_s"]

    sizes = keyed.groupBy(keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(groups).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(groups)).alias(size_out or "_all"),
    )
    within = Window.partitionBy(keys).orderBy(
        _order(F.col(value), descending), F.col(ident).asc_nulls_last(), *tie_break
    )
    numbered = keyed.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_row"))
        .select(*df.columns, out, *([size_out] if size_out else []))
    )


@dataclass(frozen=True)
class CutPoint:
    """The last row, in sort order, of those that were asked for."""

    value: float | None
    ident: int | str
    descending: bool = False

    def covers(self, value: Column, ident: Column) -> Column:
        """True for rows at or before the cut; a plain predicate that can be pushed down."""
        same_id = ident <= F.lit(self.ident)
        present = value.isNotNull() & ~F.isnan(value)
        if self.value is None:
            return present | same_id
        cut = F.lit(self.value)
        earlier = (value > cut) & present if self.descending else value < cut
        return F.coalesce(earlier | ((value == cut) & same_id), F.lit(False))


def kth_smallest(
    df: DataFrame, value: str, ident: str, k: int | Callable[[int], int], *, descending: bool = False
) -> CutPoint | None:
    """The k-th row by ``value`` (missing last), ties broken by the unique ``ident``.

    ``k`` may depend on the number of rows, which is counted anyway.
    """
    rows = df.select(_present(F.col(value)).alias("v"), F.col(ident).alias("i"))
    n = rows.count()
    k = k(n) if callable(k) else k
    if k <= 0:
        return None
    buckets = _buckets(df)
    while n > SELECT_ROWS:
        number = _id_number(rows, "i")
        bounds = _boundaries(rows, F.col("v"), number, buckets)
        keyed = _with_buckets(rows, F.col("v"), number, bounds, descending)
        # The bucket with the row is found on the executors; only its line is fetched.
        upto = F.sum("size").over(Window.orderBy("_b", "_s"))
        counts = keyed.groupBy("_b", "_s").agg(F.count(F.lit(1)).alias("size")).withColumn("upto", upto)
        hit = counts.filter(F.col("upto") >= k).orderBy("_b", "_s").first()
        k -= hit["upto"] - hit["size"]
        if hit["size"] == n:
            break
        in_bucket = (F.col("_b") == hit["_b"]) & (F.col("_s") == hit["_s"])
        rows, n = keyed.filter(in_bucket).select("v", "i"), hit["size"]
    # The last rows are numbered by one task; only the row that is asked for is fetched.
    number = F.row_number().over(Window.orderBy(_order(F.col("v"), descending), "i"))
    found = rows.withColumn("row", number).filter(F.col("row") == k).collect()
    return CutPoint(found[0]["v"], found[0]["i"], descending) if found else None


def group_hash_cuts(
    df: DataFrame, group: str, ident: str, hashed: Column, k: Column
) -> DataFrame:
    """Per group the hash and id of its k-th row in hash order, as one small table.

    ``hashed`` is an evenly spread hexadecimal text, so its first digits are balanced
    buckets by themselves and only the bucket with the cut is ever sorted. ``k`` may
    use the column ``n``, the size of the group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(ident).alias("i"), hashed.alias("h"))
    rows = rows.withColumn("b", F.substring("h", 1, 4))
    sizes = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("size"))
    running = Window.partitionBy("g").orderBy("b")
    cuts = (
        sizes.withColumns(
            {
                "upto": F.sum("size").over(running),
                "n": F.sum("size").over(Window.partitionBy("g")),
            }
        )
        .withColumns({"k": k, "before": F.col("upto") - F.col("size")})
        .filter((F.col("before") < F.col("k")) & (F.col("k") <= F.col("upto")))
        .select("g", "b", "n", "k", "before")
    )
    in_cut = lookup(rows, cuts, ["g", "b"], "inner")
    nth = Window.partitionBy("g", "b").orderBy("h", "i")
    return (
        in_cut.withColumn("row", F.row_number().over(nth))
        .filter(F.col("row") == F.col("k") - F.col("before"))
        .select(F.col("g").alias(group), F.col("h").alias("cut_hash"), F.col("i").alias("cut_id"), "n")
    )


SKETCH = 10_000  # a sketched boundary is off by no more than one row in so many
FEW_ROWS = 200_000  # that one task may sort
SMALL_GROUP = 1_000  # rows of a group that are ranked without boundaries


def _finite_or_last(col: Column) -> Column:
    """As a double below infinity, missing values as infinity, behind all others."""
    number = _present(col).cast("double")
    return F.when(number.isNull(), F.lit(math.inf)).when(number > _LARGEST, F.lit(_LARGEST)).otherwise(number)


def group_cut_points(
    df: DataFrame, group: str, value: str, ident: str, fractions: Sequence[float], ranks: Sequence[Column]
) -> DataFrame:
    """``(group, n, cuts)``: for every group its rows of certain ranks, as one small table.

    A rank is an expression of ``n``, the size of the group, and close to its fraction of n. Order
    is by value (missing last), then by the unique ident. ``cuts`` has {v, i} per rank, null where
    the rank is below one. Sketches that are merged per group bracket every cut; counts tell
    whether the brackets hold and how many rows are below; only rows inside a bracket are
    exchanged and ranked, about four in SKETCH per cut, and those that tie with it.
    """
    v = _finite_or_last(F.col(value))
    rows = df.select(F.col(group).alias("g"), v.alias("v"), F.col(ident).alias("i"))
    spans = range(len(ranks))
    if rows.count() <= FEW_ROWS:
        own = Window.partitionBy("g")
        placed = rows.withColumns(
            {"n": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("v", "i"))}
        )
        at = [F.max(F.when(F.col("rank") == F.least(rank, F.col("n")), F.struct("v", "i"))) for rank in ranks]
        cuts = placed.groupBy("g", "n").agg(F.array(*at).alias("cuts"))
        return stage_table(cuts.withColumnRenamed("g", group), "cuts")
    margin = 2.0 / SKETCH
    probs = [min(max(f + side, 0.0), 1.0) for f in fractions for side in (-margin, margin)]
    sketch = F.percentile_approx("v", F.array(*[F.lit(p) for p in probs]), F.lit(SKETCH))
    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), sketch.alias("q"))
    small = F.col("n") < SMALL_GROUP
    wanted = F.array(
        *[
            F.struct(
                F.lit(j).alias("j"),
                F.least(rank, F.col("n")).cast("bigint").alias("k"),
                F.when(small, F.lit(-math.inf)).otherwise(F.get("q", 2 * j)).alias("lo"),
                F.when(small, F.lit(math.inf)).otherwise(F.get("q", 2 * j + 1)).alias("hi"),
            )
            for j, rank in enumerate(ranks)
        ]
    )
    brackets = stage_table(stats.select("g", "n", wanted.alias("w")), "sketches")
    counted = null_safe_join(rows, brackets, ["g"]).groupBy("g", "n", "w").agg(
        *[F.count(F.when(F.col("v") < F.col("w")[j]["lo"], 1)).alias(f"below{j}") for j in spans],
        *[F.count(F.when(F.col("v") <= F.col("w")[j]["hi"], 1)).alias(f"upto{j}") for j in spans],
    )
    checked = []
    for j in spans:
        w = F.col("w")[j]
        holds = (F.col(f"below{j}") < w["k"]) & (w["k"] <= F.col(f"upto{j}"))
        checked.append(
            F.struct(
                w["j"].alias("j"),
                (w["k"] - F.when(holds, F.col(f"below{j}")).otherwise(0)).alias("k"),
                F.when(holds, w["lo"]).otherwise(-math.inf).alias("lo"),
                F.when(holds, w["hi"]).otherwise(math.inf).alias("hi"),
            )
        )
    # A rank below one has no row.
    sound = F.filter(F.array(*checked), lambda w: w["k"] > 0)
    brackets = stage_table(counted.select("g", "n", sound.alias("w")), "brackets")
    near = null_safe_join(rows, brackets, ["g"]).select("g", "v", "i", F.explode("w").alias("w"))
    near = near.filter(F.col("v").between(F.col("w.lo"), F.col("w.hi")))
    near = stage_table(near.select("g", F.col("w.j").alias("j"), F.col("w.k").alias("k"), "v", "i"), "near")
    if near.count() <= FEW_ROWS:
        order = Window.partitionBy("g", "j").orderBy("v", "i")
        ranked = near.withColumn("rank", F.row_number().over(order))
    else:
        ranked = exact_rank(near, "v", "i", group_by=["g", "j"])
    found = ranked.filter(F.col("rank") == F.col("k")).groupBy("g").agg(
        *[F.max(F.when(F.col("j") == j, F.struct("v", "i"))).alias(f"c{j}") for j in spans]
    )
    cuts = F.array(*[F.col(f"c{j}") for j in spans]).alias("cuts")
    joined = null_safe_join(brackets.select("g", "n"), found, ["g"], "left")
    return stage_table(joined.select(F.col("g").alias(group), "n", cuts), "cuts")


def at_or_before(value: Column, ident: Column, cut: Column) -> Column:
    """True for rows up to a cut of ``group_cut_points``; false for all if there is none."""
    v = _finite_or_last(value)
    return F.coalesce((v < cut["v"]) | ((v == cut["v"]) & (ident <= cut["i"])), F.lit(False))
