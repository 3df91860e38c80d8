"""Bounded samples of labelled rows, chosen by a hash of the id and never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = float(1 << 63)


def bounded_sample(rows: DataFrame, key: str, group: str | None, most: int) -> DataFrame:
    """At most about ``most`` rows of each group, those with the smallest hash of ``key``.

    Counts per group are added up first; a group gets a threshold for the hash from its
    count, so nothing is sorted and a group with a third of all rows is no burden. The
    number kept varies around ``most`` by its square root where a group has more.
    """
    spread = F.abs(F.xxhash64(F.col(key))).cast("double") / _RANGE
    name = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    keyed = rows.withColumn("_g", name).withColumn("_h", spread)
    counts = keyed.groupBy("_g").agg(F.count("*").alias("_n"))
    chosen = keyed.join(counts, "_g").filter(F.col("_h") * F.col("_n") < most)
    return chosen.drop("_g", "_h", "_n")
