"""A training corpus from raw documents: five stages, each written before the next one reads.

Quality classifier, exact deduplication, near-duplicate removal by SimHash, mixing of the
sources to target weights, BPE encoding. Every stage takes all rows that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewave.llm import bpe, exact_dedup, mixing, quality, simhash
from codewave.llm.queries import fold, table, word_bpe
from codewave.session import stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the held-out fold is never learned."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    return quality.keep_good(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs, largest=False)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's token budget draws them."""
    return mixing.mix(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digest and that of the decoded text."""
    return bpe.encode_decode(docs, word_bpe(), output=bpe.TOKEN_LISTS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trees, sketches and tokens can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
