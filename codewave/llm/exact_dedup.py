"""Exact deduplication: a 128-bit content hash finds groups, a byte comparison confirms them.

Only ids and digests are grouped first. Rows of groups with several members then meet the
text of the member that stays and are compared with it; rows that differ from it in spite
of an equal hash form groups of their own, keyed by their text.

Defined cases: a null text is an empty text. A row that is repeated with its id is one more
member; exactly one row of each group is kept. A null id sorts below every other id. Extra
columns, of any name, are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewave.session import stage_table

MEMBERS_PER_TASK = 4096


def _content_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    The row with the largest id stays, or the smallest.
    """
    best = F.max if largest else F.min
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", "t", _content_hash(F.col("t")).alias("h")
    )
    # The digest moves with the narrow rows, the text does not.
    rows = hashed.select("id", "h", F.sha2(F.encode("t", "UTF-8"), 256).alias("s"))
    rows = rows.groupBy("h", "s", "id").agg(F.count("*").alias("m"))
    groups = rows.groupBy("h").agg(F.sum("m").alias("n"), best("id").alias("keep"))
    several = groups.filter("n > 1")

    # Members of a large group are dealt to several tasks, each with a copy of the text kept.
    parts = F.ceil(F.col("n") / MEMBERS_PER_TASK).cast("int")
    members = hashed.join(several, "h").withColumn(
        "part", F.pmod(F.xxhash64("id"), parts).cast("int")
    )
    members = stage_table(members, "members")  # used twice; the exchange of all texts is not
    first = (
        members.filter(F.col("id").eqNullSafe(F.col("keep")))
        .groupBy("h", "n")
        .agg(F.min("t").alias("kept_text"))
        .withColumn("kept_sha", F.sha2(F.encode("kept_text", "UTF-8"), 256))  # of this text, not of the hash
        .select("h", "kept_text", "kept_sha", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    odd = F.when(F.col("t") != F.col("kept_text"), F.col("t"))
    seen = (
        members.join(first, ["h", "part"])
        .select("h", "id", odd.alias("odd"), "kept_sha")
        .groupBy("h", "id", "odd", "kept_sha")
        .agg(F.count("*").alias("m"))
    )
    classes = seen.groupBy(F.col("h").alias("ch"), F.col("odd").alias("codd")).agg(
        F.sum("m").alias("n"), best("id").alias("keep")
    )
    confirmed = seen.join(
        classes, (F.col("h") == F.col("ch")) & F.col("odd").eqNullSafe(F.col("codd"))
    )
    digest = F.sha2(F.encode("odd", "UTF-8"), 256)
    digest = F.when(F.col("odd").isNull(), F.col("kept_sha")).otherwise(digest)
    grouped = confirmed.select("id", "keep", "n", "m", digest.alias("s"))
    single = rows.join(groups.filter("n = 1").select("h", "keep", "n"), "h")
    out = single.select("id", "keep", "n", "m", "s").unionByName(grouped)
    # A row repeated with its id comes back as often as it was there; its first copy is kept.
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m")))
    return out.withColumn("copy", copy).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").cast("bigint").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        F.col("s").alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that are alike in id and text one stays, whichever its other columns.
    """
    kept = exact_groups(docs, id_col, text_col, largest).filter("kept")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        key.alias("_k"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("_h"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )
    kept = kept.select(key.alias("_k"), F.col("text_sha256").alias("_h"))
    stay = keyed.join(kept, ["_k", "_h"], "left_semi")
    return stay.dropDuplicates(["_k", "_h"]).select("_row.*")
