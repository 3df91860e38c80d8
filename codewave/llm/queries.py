"""The registered queries of the operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewave.llm import (
    bpe,
    exact_dedup,
    langid,
    minhash,
    mixing,
    phrase_automata,
    pii,
    prefix_trie,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    whitening,
)
from codewave.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The JSON text of the public tokenizer whose path is the parameter here."""
    import public_tokenizers

    return bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe())


@query
def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"))
    return drawn.select(
        F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", F.col("pass").alias("pass_no"), "block_order"
    )


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query
def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words_per_shingle=4, bits=4)


def fold(column: str, folds: int) -> Column:
    """Remainder of the checksum of a column as text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % folds


@query
def op2_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 0
    model = langid.learn(docs.filter(~held).select(F.col("doc_id").alias("id"), "lang", "text"))
    scored = langid.predict(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4) == 2
    learned = labels.filter(~held).select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    scored = quality.classify(docs, learned)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.remove_phrases(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(table(spark, sf_dir, "conversations"))
