"""Waves, order and splits of the training set."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from codewave.functions.nulls import code_text
from codewave.operators.joins import lookup
from codewave.operators.rank import exact_rank, group_hash_cuts
from codewave.session import stage_table

# Survey order of the waves, the trial waves first.
TRIAL_WAVES = (80, 81, 82)
LAST_WAVE = 24
WAVE_ORDER = (*TRIAL_WAVES, *range(1, LAST_WAVE + 1))


def wave_number(df: DataFrame, wave: str) -> Column:
    """A wave as a whole number; a numeric column is used as it is, so filters reach the scan."""
    if isinstance(df.schema[wave].dataType, IntegralType):
        return df[wave]
    return df[wave].cast("string").try_cast("double").try_cast("int")


def wave_order(number: Column, order: Sequence[int] = WAVE_ORDER) -> Column:
    """Survey position 1..n of a wave; null for an unknown one."""
    position = F.array_position(F.array(*[F.lit(w) for w in order]), number.cast("int"))
    return F.when(position > 0, position.cast("int"))


def ordered_waves(
    df: DataFrame, wave: str, order: Sequence[int] = WAVE_ORDER, out: str = "wave_order"
) -> DataFrame:
    """Add the survey position of each wave; sort by it with nulls last."""
    return df.withColumn(out, wave_order(wave_number(df, wave), order))


def wave_window(df: DataFrame, wave: str, current: int) -> DataFrame:
    """Rows of waves that precede ``current`` in survey order."""
    number = wave_number(df, wave)
    if current >= min(TRIAL_WAVES):
        before = (number > LAST_WAVE) & (number < current)
    else:
        before = (number >= min(TRIAL_WAVES)) | (number < current)
    return df.filter(before).withColumn(wave, number.cast("int"))


def seq_in_group(
    df: DataFrame, key: str, order: str, out: str = "nro_rph", tie_break: Sequence[str] = ()
) -> DataFrame:
    """Position within a household in file order; one household may be very large."""
    return exact_rank(df, order, order, group_by=[key], tie_break=tie_break, out=out)


def global_row_id(df: DataFrame, order: str, out: str = "id_fila") -> DataFrame:
    """1..N over the whole frame in the order of a unique numeric column."""
    return exact_rank(df, order, order, out=out)


#: Place of a row, as ``sources.readers.read_in_order`` gives it.
FILE_NO, ROW_NO = "_file_no", "_row_no"
ORDER_CHUNK = 1 << 20  # rows of a file that are numbered together


def seq_in_file_order(df: DataFrame, key: str, out: str = "nro_rph") -> DataFrame:
    """Position within a household in the order of the files; the place columns are dropped.

    Rows are numbered within a household and a stretch of a file, and the counts of earlier
    stretches are added, so a household that fills whole files is still spread over tasks. Both
    steps share one exchange of the rows.
    """
    blank = "" if df.schema[key].dataType.simpleString() == "string" else 0
    kind = df.schema[key].dataType.simpleString()
    placed = df.withColumns(
        {
            "_k": F.coalesce(F.col(key), F.lit(blank).cast(kind)),
            "_null": F.col(key).isNull(),
            "_chunk": F.floor(F.col(ROW_NO) / ORDER_CHUNK),
        }
    )
    household, stretch = ["_k", "_null"], ["_k", "_null", FILE_NO, "_chunk"]
    counts = placed.groupBy(*stretch).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*household).orderBy(FILE_NO, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*stretch, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*stretch).orderBy(ROW_NO))
    numbered = placed.withColumn("_number", number).join(before, stretch)
    kept = [c for c in df.columns if c not in (FILE_NO, ROW_NO)]
    return numbered.select(*kept, (F.col("_before") + F.col("_number")).alias(out))


def file_row_id(df: DataFrame, out: str = "id_fila") -> DataFrame:
    """1..N over all rows of the files, in their order; the place columns are dropped.

    The number is the size of the earlier files plus the place in the file: no row is exchanged.
    ``df`` has all rows of its files.
    """
    sizes = df.groupBy(FILE_NO).agg(F.count(F.lit(1)).alias("_n"))  # one line per file
    earlier = Window.orderBy(FILE_NO).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(FILE_NO, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    kept = [c for c in df.columns if c not in (FILE_NO, ROW_NO)]
    return df.join(stage_table(before, "file_sizes"), FILE_NO).select(*kept, (F.col("_before") + F.col(ROW_NO) + 1).alias(out))


def merge_origins(
    origins: Mapping[str, DataFrame], code: str = "aeciuo_2", tag: str = "origen"
) -> DataFrame:
    """Stack frames under a provenance tag, codes as text, absent columns as null."""
    merged = None
    for name, df in origins.items():
        tagged = df.withColumns({code: code_text(df, code), tag: F.lit(name)})
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def stratified_split(
    df: DataFrame, label: str, ident: str, p: float = 0.8, seed: int = 1234, out: str = "split"
) -> DataFrame:
    """Mark ceil(n*p) rows of each class 'train', the rest 'test', by a seeded hash.

    A class may hold most rows: only its hash bucket with the cut is sorted, and the
    rows themselves are compared with one cut per class instead of being shuffled.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")).cast("binary"))
    k = F.ceil(F.col("n") * F.lit(float(p)))
    cuts = group_hash_cuts(df, label, ident, hashed, k).drop("n")
    row = F.struct(hashed, F.col(ident))
    cut = F.struct(F.col("cut_hash"), F.col("cut_id"))
    train = F.col("cut_id").isNotNull() & (row <= cut)
    return (
        lookup(df, cuts, [label])
        .withColumn(out, F.when(train, F.lit("train")).otherwise(F.lit("test")))
        .drop("cut_hash", "cut_id")
    )


def temporal_split(
    df: DataFrame,
    cut: int,
    origin: str = "origen",
    wave: str = "submuestra",
    current: str = "ix",
    out: str = "split",
) -> DataFrame:
    """Train on older origins and trial waves, test on later waves of the current survey."""
    number = wave_number(df, wave)
    is_current = F.col(origin) == current
    train = F.coalesce(~is_current | number.isin(*TRIAL_WAVES), F.lit(False))
    test = F.coalesce(is_current & (number >= cut) & (number < min(TRIAL_WAVES)), F.lit(False))
    return df.withColumn(
        out, F.when(train, F.lit("train")).when(test, F.lit("test"))
    ).filter(F.col(out).isNotNull())


def floor_share(n: int, p: float) -> int:
    """Rows in a proportional slice."""
    return math.floor(n * p)
