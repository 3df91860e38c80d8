"""What the plans must and must not contain."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from codewave.operators import assemble, triage

SF = "/root/testdata/sf0.001"
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not [word for word in UNWANTED if word in text]


def test_wave_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5 + 78, "x") for i in range(50)], "id int, submuestra int, t string")
    df.write.partitionBy("submuestra").parquet(str(tmp_path / "by_wave"))
    text = plan(assemble.wave_window(spark.read.parquet(str(tmp_path / "by_wave")), "submuestra", 82))
    assert "PartitionFilters: [isnotnull(submuestra" in text
    df.write.parquet(str(tmp_path / "flat"))
    text = plan(assemble.wave_window(spark.read.parquet(str(tmp_path / "flat")), "submuestra", 82))
    assert "LessThan(submuestra,82)" in text and "GreaterThan(submuestra,24)" in text


def test_triage_is_a_filter_on_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    human, auto = triage.triage_split(orders, "o_totalprice", "o_orderkey")
    for part in (human, auto):
        text = plan(part)
        assert "Exchange" not in text and "PushedFilters: [" in text
    assert human.count() + auto.count() == orders.count()


def test_split_shuffles_no_rows(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(assemble.stratified_split(orders, "o_orderstatus", "o_orderkey"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_counts_are_summed_before_the_shuffle(spark):
    from codewave.operators.quality import agreement_summary, count_by

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert "partial_count" in plan(count_by(orders, ["o_orderstatus"]))
    assert agreement_summary(orders, "o_orderstatus").agg(F.sum("n")).first()[0] == orders.count()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_answers_are_exchanged_once(spark):
    from codewave.operators import features

    text = spark.createDataFrame([(1, "pan con pan"), (2, "vende pan"), (3, "")], "id long, t string")
    vocab = features.fit_vocabulary(text, "t", "id")
    assert exchanges(features.tfidf(text, text, "t", "id", vocab)) == 1
    tokens = features.encode_tokens(text, "t", "id", vocab)
    vectors = vocab.select("idx", F.array(F.lit(1.0), F.col("idx").cast("double")).alias("embedding"))
    pooled = plan(features.pool_embeddings(tokens, vectors, "id", 2))
    # The tokens by block, for both sides of the fetch; small vectors are broadcast to the words.
    assert pooled.count("REPARTITION_BY_NUM") == 2 and pooled.count("ENSURE_REQUIREMENTS") == 0


def test_cut_offs_leave_the_rows_where_they_are(spark):
    from codewave.operators.quality import cutoff_accuracy_grid, difficulty_bin

    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("hit", F.lit(1))
    names = ("o_orderstatus", "o_totalprice", "o_orderkey", "hit")
    grid = cutoff_accuracy_grid(orders, *names)
    assert plan(grid).count("orders.parquet") == 1 and exchanges(grid) == 1  # of the counts per wave
    assert "SortMergeJoin" not in plan(grid)
    assert exchanges(difficulty_bin(orders, *names)) == 0
