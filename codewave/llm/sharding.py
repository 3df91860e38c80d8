"""Sharding along a Hilbert curve: several metadata dimensions are quantised, rows are put
in the order of the curve's index, and the order is cut into runs of equal length.

Rows near each other on the curve agree in most dimensions, so files cut from it can be
pruned by any of them. The rank of every row is exact and comes from sums over the levels
of one fixed order: cell of the grid, leading bits of the text's checksum, a spread of the
id, rest of the checksum, id. No level holds more than ``2**BITS_HIGH`` entries below one
parent, so each window stays small however large one source or one group of copies is.

Defined cases: a null text has size 1 and checksum 0; a null id sorts first; a null in a
dimension is a value of its own; repeated rows take neighbouring slots; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 5  # of each dimension: 2**15 cells in three dimensions
BITS_HIGH = 12  # leading bits of the checksum
SPREAD = 1024  # parts by id inside one run of equal leading bits


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of integer coordinates of ``bits`` bits each.

    The coordinates are turned level by level into the frame of their sub-cube, then Gray
    decoded and interleaved (Skilling, 2004).
    """
    names = [f"x{i}" for i in range(len(dims))]

    def turn(acc: Column, q: Column) -> Column:
        x = [acc[n] for n in names]
        low = q - 1
        for i in range(len(x)):
            high = x[i].bitwiseAND(q) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            turned = F.when(high, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
            if i:
                x[i] = F.when(high, x[i]).otherwise(x[i].bitwiseXOR(swap))
            x[0] = turned
        return F.struct(*[c.alias(n) for c, n in zip(x, names)])

    levels = F.array(*[F.lit(1 << b).cast("int") for b in range(bits - 1, 0, -1)])
    start = F.struct(*[d.cast("int").alias(n) for d, n in zip(dims, names)])
    turned = F.aggregate(levels, start, turn)

    def decode(state: Column) -> Column:
        x = [state[n] for n in names]
        for i in range(1, len(x)):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        flips = [F.when(x[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(0) for b in range(1, bits)]
        t = reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0))
        x = [c.bitwiseXOR(t) for c in x]
        place, out = bits * len(x) - 1, F.lit(0).cast("bigint")
        for b in range(bits - 1, -1, -1):
            for c in x:
                bit = F.shiftright(c, b).bitwiseAND(F.lit(1)).cast("bigint")
                out = out + F.shiftleft(bit, place)
                place -= 1
        return out

    return F.transform(F.array(turned), decode)[0]


def hash_cell(col: Column, bits: int = BITS) -> Column:
    """A categorical value as a coordinate; equal values share it, null has its own hash."""
    text = F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("null"))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(1 << bits)).cast("int")


def magnitude_cell(col: Column, bits: int = BITS) -> Column:
    """A count as a coordinate: its number of binary digits."""
    return F.least(F.length(F.bin(col)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """(id, size, text_crc32, curve_index, shard, slot); shard sizes differ by one row at most."""
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    size = (F.length(text) + 1).cast("bigint")
    dims = [hash_cell(F.col(f"`{c}`")) for c in categories]
    names = [f"c{i}" for i in range(len(dims) + 1)]
    rows = (
        docs.select(
            F.col(id_col).alias("id"),
            size.alias("size"),
            F.crc32(text).alias("crc"),
            *[d.alias(n) for d, n in zip(dims, names)],
        )
        .withColumn(names[-1], magnitude_cell(F.col("size")))
        .withColumn("hi", F.shiftrightunsigned("crc", 32 - BITS_HIGH).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
    )

    fine = rows.groupBy(*names, "hi", "part").agg(F.count("*").alias("n"))
    runs = fine.groupBy(*names, "hi").agg(F.sum("n").alias("n"))
    # At most 2**(bits * dimensions) cells: one small window over all of them.
    cells = runs.groupBy(*names).agg(F.sum("n").alias("n"))
    cells = cells.withColumn("curve", hilbert_index([F.col(n) for n in names]))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    cells = cells.select(
        *names,
        "curve",
        F.coalesce(F.sum("n").over(before), zero).alias("at_cell"),
        F.sum("n").over(everything).alias("total"),
    )
    in_cell = Window.partitionBy(*names).orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*names, "hi", F.coalesce(F.sum("n").over(in_cell), zero).alias("at_run"))
    in_run = Window.partitionBy(*names, "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.select(*names, "hi", "part", F.coalesce(F.sum("n").over(in_run), zero).alias("at_part"))
    starts = fine.join(runs, [*names, "hi"]).join(cells, names)
    starts = starts.withColumn("start", F.col("at_cell") + F.col("at_run") + F.col("at_part"))

    key = [*names, "hi", "part"]
    ranked = rows.join(starts.select(*key, "curve", "start", "total"), key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("crc", "id", "size"))
    ranked = ranked.withColumn("rank", F.col("start") + nth - 1)
    shard = F.floor(F.expr(f"rank * {shards} div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("curve").alias("curve_index"),
        "shard",
        (F.col("rank") - first).cast("bigint").alias("slot"),
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **names
) -> str:
    """Write ``docs`` as one folder per shard, in the order of the slots; the name of the folder's
    column is returned: ``shard``, with underscores before it if ``docs`` has such a column.

    Rows and slots come together by id, checksum and size of the text. Rows that agree in these
    are numbered, so repeated ids keep as many rows as they have.
    """
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    same = Window.partitionBy("id", "crc", "size")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.crc32(text).alias("crc"),
        (F.length(text) + 1).cast("bigint").alias("size"),
    ).withColumn("nth", F.row_number().over(same.orderBy(F.lit(0))))
    place = hilbert_shards(docs, shards, id_col, text_col, **names)
    place = place.select(F.col(id_col).alias("id"), F.col("text_crc32").alias("crc"), "size", "shard", "slot")
    place = place.withColumn("nth", F.row_number().over(same.orderBy("slot")))
    keys = [rows[c].eqNullSafe(place[c]) if c == "id" else rows[c] == place[c] for c in ("id", "crc", "size", "nth")]
    placed = rows.join(place, keys).select("row", F.col("shard").alias(folder), "slot")
    ranged = placed.repartitionByRange(folder, "slot").sortWithinPartitions(folder, "slot")
    ranged.select("row.*", folder).write.partitionBy(folder).parquet(path)
    return folder
