"""Text operators over whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.functions import text as T


def normalize_columns(
    df: DataFrame, cols: Sequence[str], suffix: str = "_proc", **flags
) -> DataFrame:
    """Add a normalised copy of each column; the originals stay."""
    return df.withColumns({f"{c}{suffix}": T.normalize_text(F.col(c), **flags) for c in cols})


def combine_text(df: DataFrame, out: str, cols: Sequence[str], sep: str = " ") -> DataFrame:
    """Paste columns; inputs stay, an empty part still gets its separator."""
    parts: list[Column] = [F.coalesce(F.col(c), F.lit("NA")) for c in cols]
    return df.withColumn(out, F.concat_ws(sep, *parts))


def keyword_select(df: DataFrame, col: str, include: str, exclude: str | None = None) -> DataFrame:
    return df.filter(T.keyword_match(F.col(col), include, exclude))


def token_lengths(df: DataFrame, cols: Sequence[str], suffix: str = "_len") -> DataFrame:
    """Words per answer of normalised text columns."""
    return df.withColumns({f"{c}{suffix}": F.size(T.blank_separated(F.col(c))) for c in cols})


def max_token_length(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The longest answer of each column, all in one pass."""
    return df.agg(*[F.max(F.size(T.blank_separated(F.col(c)))).alias(c) for c in cols])


def frequent_texts(df: DataFrame, group: str, col: str, k: int = 10) -> DataFrame:
    """The k most frequent texts per group; ties go by text.

    Texts are counted first; then each of many buckets keeps its own k best, so the
    last step sees at most k rows per bucket and group.
    """
    counts = df.groupBy(group, col).agg(F.count(F.lit(1)).alias("n"))
    best = [F.col("n").desc(), F.col(col).asc_nulls_last()]
    spread = counts.withColumn("_b", F.pmod(F.xxhash64(col), F.lit(1024)))
    local = Window.partitionBy(group, "_b").orderBy(*best)
    final = Window.partitionBy(group).orderBy(*best)
    return (
        spread.withColumn("_r", F.row_number().over(local))
        .filter(F.col("_r") <= k)
        .drop("_b", "_r")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )


def blank_specials(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: T.blank_special_codes(F.col(c)) for c in cols})
