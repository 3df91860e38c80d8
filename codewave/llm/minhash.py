"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle of a text is hashed once; the leading bits of the hash name a bin and the
smallest hash of each bin is kept. An empty bin takes the value of another bin, found by
hashing the bin's number again and again until a filled one is met (after ``PROBES`` tries
the filled bin with the smallest hash for this empty one is taken, which is the same draw).
The lowest ``LOW_BITS`` bits of each bin are stored, packed into 64-bit numbers; likeness is
the share of equal bins, corrected for bins that are equal by chance.

All of it is column expressions: sorting the hashes together with one mark per bin puts
every bin's smallest entry first, and a mark that comes first is an empty bin.

Defined cases: a null text is an empty text; a text with fewer words than a shingle is one
shingle; a text without words has the empty fingerprint, which is like itself (1) and
unlike any other (0); rows that repeat an id and its text are one document in the order of
ids and get equal results; a null id comes after all others; a single document is its own
neighbour; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.session import stage_table

BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
SHINGLE = 5  # words
PROBES = 16
_REST = (1 << (64 - BIN_BITS)) - 1
_PER_LONG = 64 // LOW_BITS


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS)


def _empty(h: Column) -> Column:
    return h.bitwiseAND(F.lit(_REST)) == _REST


def with_fingerprint(df: DataFrame, text: Column, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``: array<bigint> of packed bins, empty for a text without words.

    Arrays that an inner expression indexes are columns of their own, so that each is made
    once per row.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    df = df.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))

    w, n = F.col("_w"), F.size("_w")
    # The first word's position in a text of k words or more; one shingle otherwise.
    at = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
    hashes = F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))
    first = -(1 << (BIN_BITS - 1))
    marks = F.transform(
        F.sequence(F.lit(first), F.lit(first + BINS - 1)),
        lambda b: F.shiftleft(b.cast("bigint"), 64 - BIN_BITS).bitwiseOR(F.lit(_REST)),
    )
    df = df.select(*columns, (n > 0).alias("_any"), F.sort_array(F.concat(hashes, marks)).alias("_s"))

    s = F.col("_s")
    starts = F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))
    df = df.select(*columns, "_any", starts.alias("_b"))
    df = df.select(*columns, "_any", "_b", F.filter("_b", lambda h: ~_empty(h)).alias("_f"))

    b, filled = F.col("_b"), F.col("_f")

    def probe(i: Column, t: int) -> Column:
        met = F.get(b, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
        return F.when(~_empty(met), met)

    def search(i: Column) -> Column:
        return F.array_min(F.transform(filled, lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("x"), h.alias("h"))))["h"]

    dense = F.transform(
        b, lambda h, i: F.when(~_empty(h), h).otherwise(F.coalesce(*[probe(i, t) for t in range(PROBES)], search(i)))
    )
    df = df.select(*columns, "_any", dense.alias("_d"))

    d, low = F.col("_d"), F.lit((1 << LOW_BITS) - 1).cast("bigint")

    def pack(k: Column) -> Column:
        word = F.lit(0).cast("bigint")
        for j in range(_PER_LONG):
            part = F.get(d, k * _PER_LONG + j).bitwiseAND(low)
            word = word.bitwiseOR(F.shiftleft(part, LOW_BITS * j))
        return word

    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), pack)
    none = F.array().cast("array<bigint>")
    return df.select(*columns, F.when(F.col("_any"), packed).otherwise(none).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for the bits not kept."""

    def differing(x: Column) -> Column:
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    counts = F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y)))
    unequal = F.aggregate(counts, F.lit(0), lambda s, c: s + c)
    chance = 2.0**-LOW_BITS
    estimate = F.greatest(F.lit(0.0), ((1 - unequal / BINS) - chance) / (1 - chance))
    same_emptiness = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(same_emptiness, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def as_text(fingerprint: Column) -> Column:
    parts = F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0")))
    return F.array_join(parts, "")


def next_documents(keys: DataFrame) -> DataFrame:
    """Adds (next_k, next_th) to distinct (k, th, ...): the row after, by descending k, in a circle.

    Rows are written once by ranges of the order; a range needs no other rows than its own
    and the first row of the range after it.
    """
    ranged = keys.repartitionByRange(F.desc("k"), F.asc("th")).withColumn("part", F.spark_partition_id())
    ranged = stage_table(ranged, "ranges")
    order = Window.partitionBy("part").orderBy(F.desc("k"), "th")
    follower = F.lead(F.struct("k", "th")).over(order)
    heads = ranged.groupBy("part").agg(F.min(F.struct(F.bitwise_not("k").alias("d"), "th")).alias("h"))
    heads = heads.select("part", F.struct(F.bitwise_not("h.d").alias("k"), F.col("h.th").alias("th")).alias("head"))
    along = Window.orderBy("part")  # one row per range
    heads = heads.select(
        "part",
        F.coalesce(
            F.lead("head").over(along),
            F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("head"),
    )
    found = ranged.withColumn("after", follower).join(F.broadcast(heads), "part")
    found = found.withColumn("after", F.coalesce("after", "head")).drop("part", "head")
    return found.select("*", F.col("after.k").alias("next_k"), F.col("after.th").alias("next_th")).drop("after")


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and three likenesses.

    The edited text has its last third replaced by as much of the beginning of the next
    document in descending order of ids.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    no_id = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), no_id).alias("k"), text.alias("t"))
    rows = rows.select("k", F.xxhash64("t").alias("th"), "t")
    keys = rows.select("k", "th", F.length("t").cast("bigint").alias("n")).distinct()
    links = next_documents(keys)

    # What a document gives to the one before it: its beginning and its fingerprint. No
    # column is renamed, so that both joins take the texts from one exchange.
    near = (F.col("l.next_k") == F.col("g.k")) & (F.col("l.next_th") == F.col("g.th"))
    given = links.alias("l").join(rows.alias("g"), near)
    given = given.select("l.k", "l.th", "l.n", F.col("g.t").alias("gt"))
    given = with_fingerprint(given, F.col("gt"), "next_fp", shingle)
    given = given.select(
        "k", "th", "n", "next_fp", F.expr("substring(gt, 1, cast(n div 3 as int))").alias("start")
    )
    given = given.dropDuplicates(["k", "th"])  # rows may repeat
    pair = rows.join(given, ["k", "th"])
    edited = F.concat(F.expr("substring(t, 1, cast(n - n div 3 as int))"), F.col("start"))
    pair = pair.select("k", "n", "t", "next_fp", edited.alias("e"))
    pair = with_fingerprint(pair, F.col("t"), "fp", shingle).drop("t")
    pair = with_fingerprint(pair, F.col("e"), "edited_fp", shingle)
    return pair.select(
        F.nullif("k", no_id).alias(id_col),
        F.col("n").alias("n_chars"),
        F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
