"""Word vectors: sub-words and pooling against plain versions."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewave.operators import features
from codewave.session import stage_table


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ (b if b < 128 else b + 0xFFFFFF00)) * 16777619) & 0xFFFFFFFF
    return h


def grams(word, low, high):
    marked = f"<{word}>"
    return [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]


WORDS = ["pan", "año", "a", "camión", "日本語", "x" * 30, "banana"]


def test_grams_and_buckets(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = {r[0]: r[1] for r in df.select("word", features.subword_grams(F.col("word"))).collect()}
    assert got == {w: grams(w, 3, 6) for w in WORDS}
    hashed = dict(df.select("word", features.gram_bucket(F.col("word"), 2_000_000)).collect())
    assert hashed == {w: fnv(w) % 2_000_000 for w in WORDS}


def test_words_without_a_vector_are_built_from_their_runs(spark):
    vocab = spark.createDataFrame([(i + 2, w) for i, w in enumerate(WORDS)], "idx int, word string")
    own = spark.createDataFrame([("pan", [9.0, 9.0])], "word string, embedding array<double>")
    rng = np.random.default_rng(3)
    table = {b: [float(x) for x in rng.normal(size=2)] for b in range(0, 50, 2)}  # odd buckets have none
    buckets = spark.createDataFrame(list(table.items()), "bucket long, embedding array<double>")
    got = {r["word"]: r for r in features.embedding_lookup(vocab, own, 2, buckets, 50).collect()}
    for w in WORDS:
        hits = [table[fnv(g) % 50] for g in grams(w, 3, 6) if fnv(g) % 50 in table]
        wanted = [9.0, 9.0] if w == "pan" else (np.mean(hits, axis=0) if hits else [0.0, 0.0])
        assert got[w]["embedding"] == pytest.approx(list(wanted))
        assert got[w]["covered"] == (w == "pan" or bool(hits))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pooling_in_blocks(spark, kind, monkeypatch):
    monkeypatch.setattr(features, "POOLED_ROWS", 3)
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=4) for i in range(2, 40)}
    tokens = {a: [int(i) for i in rng.integers(1, 45, rng.integers(1, 30))] for a in range(50)}
    ident = (lambda a: f"id {a}") if kind == "string" else (lambda a: a)
    rows = [(ident(a), p, i) for a, idx in tokens.items() for p, i in enumerate(idx)]
    df = spark.createDataFrame(rows, f"id {kind}, pos int, idx int")
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "idx int, embedding array<double>")
    got = {r["id"]: r["pooled"] for r in features.pool_embeddings(df, table, "id", 4).collect()}
    assert len(got) == 50
    for a, idx in tokens.items():
        each = np.array([vectors.get(i, np.zeros(4)) for i in idx])
        assert got[ident(a)] == pytest.approx([*each.max(axis=0), *each.mean(axis=0)])


def test_pooling_exchanges_words_not_dimensions(spark):
    df = spark.range(100).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("idx"))
    table = spark.range(10).select(F.col("id").cast("int").alias("idx"), F.array_repeat(F.lit(1.0), 4).alias("embedding"))
    plan = features.pool_embeddings(df, table, "id", 4)._jdf.queryExecution().executedPlan().toString()
    # Tokens are placed by block once; the other exchanges carry different words of a block.
    assert plan.count("REPARTITION_BY_NUM") == 2 and "FlatMapCoGroupsInArrow" in plan


def test_pooling_exchanges_vectors_as_they_are(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "id long, idx int")
    table = spark.createDataFrame([(2, [1.5, -1.0]), (3, [0.1, 3.0])], "idx int, embedding array<float>")
    pooled = features.pool_embeddings(df, table, "id", 2)
    assert "array<double>)" not in pooled._jdf.queryExecution().optimizedPlan().toString()
    tenth = float(np.float32(0.1))
    got = {r["id"]: r["pooled"] for r in pooled.collect()}
    assert got == {1: [1.5, 3.0, (1.5 + tenth) / 2, 1.0], 2: [0.0] * 4}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffles():
        return {p for d in folders for p in Path(d.toString()).rglob("shuffle_*.data")}

    df, before = spark.range(1000).repartition(4, "id"), shuffles()
    assert stage_table(df, "t").count() == 1000
    time.sleep(2)  # files are removed after the query has ended
    assert len({p.name.split("_")[1] for p in shuffles() - before}) <= 1  # that of the count


@pytest.mark.parametrize("numbers", [1 << 27, 30])
def test_subword_vectors_exchange_words_not_runs(spark, monkeypatch, numbers):
    monkeypatch.setattr(features, "SUBWORD_NUMBERS", numbers)  # 30: the buckets are dealt into ranges
    monkeypatch.setattr(features, "SUBWORD_ROWS", 2)
    words = [*WORDS, "", "é", "canción", "𝒜b"]
    vocab = spark.createDataFrame([(i + 2, w) for i, w in enumerate(words)], "idx int, word string")
    own = spark.createDataFrame([("pan", [9.0, 9.0])], "word string, embedding array<double>")
    rng = np.random.default_rng(6)
    table = {b: [float(x) for x in rng.normal(size=2)] for b in range(0, 50, 3)}
    buckets = spark.createDataFrame(list(table.items()), "bucket long, embedding array<double>")
    matrix = features.embedding_lookup(vocab, own, 2, buckets, 50)
    got = {r["word"]: r for r in matrix.collect()}
    assert len(got) == len(words)
    for i, w in enumerate(words):
        hits = [table[fnv(g) % 50] for g in grams(w, 3, 6) if fnv(g) % 50 in table]
        wanted = [9.0, 9.0] if w == "pan" else (np.mean(hits, axis=0) if hits else [0.0, 0.0])
        assert got[w]["embedding"] == pytest.approx(list(wanted)) and got[w]["idx"] == i + 2
        assert got[w]["covered"] == (w == "pan" or bool(hits))
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and "MapInArrow" in plan
