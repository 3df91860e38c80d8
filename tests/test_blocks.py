"""Words of answers by block: counts, sequences and features against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from codewave.operators import features, spaces

TEXTS = ["pan con pan", "", None, "vende pan", "Año, nuevo año", "日本 pan 𝒜b", "z" * 40, "  ", "con vende con"]


@pytest.fixture
def answers(spark):
    # Numbers fall with the rows, so that the first answer by number isn't the first of a batch.
    rows = [(900 - 7 * k, TEXTS[k % len(TEXTS)] if k < 60 else f"raro{k} pan") for k in range(80)]
    return spark.createDataFrame(rows, "id long, t string").repartition(5)


def tokens(text):
    return "".join(" " if c in ",." else c for c in text or "").lower().split()


def test_vocabulary_is_counted_in_batches(answers, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["word"]: (r["n"], r["n_docs"], r["idx"]) for r in features.fit_vocabulary(answers, "t", "id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, n_docs, first = Counter(), Counter(), {}
    for r in sorted(answers.collect()):
        words = tokens(r["t"])
        n.update(words)
        n_docs.update(set(words))
        for p, w in enumerate(words):
            first.setdefault(w, (r["id"], p))
    order = sorted(n, key=lambda w: (-n[w], first[w]))
    assert got == {w: (n[w], n_docs[w], i + 2) for i, w in enumerate(order)}


def test_answers_are_coded_in_blocks_without_a_row_per_word(answers):
    vocab = features.fit_vocabulary(answers.filter("id % 2 = 0"), "t", "id")
    index = {r["word"]: r["idx"] for r in vocab.collect()}
    coded = features.encode_sequences(answers, "t", "id", vocab)
    assert {r["id"]: r["seq"] for r in coded.collect()} == {
        r["id"]: [index.get(w, 1) for w in tokens(r["t"])] for r in answers.collect()
    }
    weights = features.tfidf(answers, answers, "t", "id", vocab)
    for frame in (coded, weights):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "collect_list" not in plan
    wanted = {(r["id"], index.get(w, 1)) for r in answers.collect() for w in tokens(r["t"])}
    assert {(r["id"], r["idx"]) for r in weights.collect()} == wanted


def test_fields_keep_their_own_words_and_unknowns(spark, answers):
    two = answers.withColumn("u", F.when(F.col("id") % 3 > 0, F.col("t")))
    space = spaces.fit_space(two.filter("id % 2 = 0"), ["t", spaces.Field("u", "sequence", 2)], "id", "counts")
    index = {(r["field"], r["word"]): r["idx"] for r in space.words.collect()}
    got = {r["id"]: dict(zip(r["idx"], r["weight"])) for r in space.weigh(space.counted(two, "id"), "id").collect()}
    assert len(got) == 80
    for r in two.collect():
        last = tokens(r["u"])[-2:]
        words = [(0, w) for w in tokens(r["t"])] + [(1, w) for w in [*last, *map(" ".join, zip(last, last[1:]))]]
        assert got[r["id"]] == Counter(index.get(w, space.unknown[w[0]]) for w in words)
    assert all(list(d) == sorted(d) for d in got.values())


def test_pooling_takes_counted_words(answers):
    vocab = features.fit_vocabulary(answers.filter("id % 2 = 0"), "t", "id")
    vectors = vocab.select("idx", F.array(F.col("idx") / 7, 1.0 - F.col("idx")).alias("embedding"))
    counts = features.encode_counts(answers, "t", "id", vocab)
    got = {r["id"]: r["pooled"] for r in features.pool_embeddings(counts, vectors, "id", 2, times="tf").collect()}
    tokens_of = features.encode_tokens(answers, "t", "id", vocab)
    wanted = {r["id"]: r["pooled"] for r in features.pool_embeddings(tokens_of, vectors, "id", 2).collect()}
    assert got.keys() == wanted.keys() and len(got) == 60
    assert all(got[i] == pytest.approx(wanted[i]) for i in got)
