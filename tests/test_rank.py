"""Exact ranks and cuts against brute force, with ties, nulls and one hot group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codewave.operators import rank as R
from codewave.operators.assemble import stratified_split


def sort_key(value, descending):
    missing = value is None or math.isnan(value)
    return (missing, 0.0 if missing else (-value if descending else value))


def make_rows(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10 * n), n):
        value = rng.choice([None, math.nan, 7.0, 7.0, 7.0, float("inf"), rng.random() * 100])
        group = rng.choice(["hot", "hot", "hot", "a", None])
        rows.append((i, group, value))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(make_rows(), "id long, g string, v double").repartition(5).persist()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", ["1", "16", "200"])
def test_exact_rank(spark, frame, descending, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["id"]: r["rank"] for r in R.exact_rank(frame, "v", "id", descending=descending).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(make_rows(), key=lambda r: (*sort_key(r[2], descending), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, start=1)}


def test_exact_rank_per_group(frame):
    got = {r["id"]: r["rank"] for r in R.exact_rank(frame, "v", "id", group_by=["g"]).collect()}
    want = {}
    for group in ("hot", "a", None):
        members = sorted((r for r in make_rows() if r[1] == group), key=lambda r: (*sort_key(r[2], False), r[0]))
        want.update({r[0]: i for i, r in enumerate(members, start=1)})
    assert got == want


def test_no_row_is_lost_without_an_id(spark):
    df = spark.createDataFrame([(None, 1.0), (3, 1.0), (1, 1.0), (2, None)], "id long, v double")
    got = {(r["id"], r["rank"]) for r in R.exact_rank(df, "v", "id").collect()}
    assert got == {(1, 1), (3, 2), (None, 3), (2, 4)}


def test_hot_value_is_cut_into_many_buckets(spark, frame):
    bounds = R._boundaries(frame, F.col("v"), F.col("id"), 32)
    keyed = R._with_buckets(frame, F.col("v"), F.col("id"), bounds, False)
    largest = keyed.groupBy("_b", "_s").count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 32 * 3


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("k", [1, 2, 500, 1499, 2400, 2999, 3000])
def test_kth_smallest_narrows_down(frame, monkeypatch, descending, k):
    monkeypatch.setattr(R, "SELECT_ROWS", 50)
    cut = R.kth_smallest(frame, "v", "id", k, descending=descending)
    want = sorted(make_rows(), key=lambda r: (*sort_key(r[2], descending), r[0]))
    expected = want[k - 1][2]
    assert cut.ident == want[k - 1][0]
    assert cut.value == (None if sort_key(expected, False)[0] else expected)
    covered = {r["id"] for r in frame.filter(cut.covers(F.col("v"), F.col("id"))).collect()}
    assert covered == {r[0] for r in want[:k]}


@pytest.fixture(scope="module")
def folios(spark):
    """Text ids that share a beginning and do not sort as their numbers do."""
    rows = [(f"waves-{i}-{i % 7}", g, v) for i, g, v in make_rows()] + [("", "a", 7.0)]
    return rows, spark.createDataFrame(rows, "id string, g string, v double").persist()


@pytest.mark.parametrize("descending", [False, True])
def test_exact_rank_with_text_ids(folios, descending):
    rows, df = folios
    ranked = R.exact_rank(df, "v", "id", group_by=["g"], descending=descending, size_out="n").collect()
    for group in ("hot", "a", None):
        want = sorted((r for r in rows if r[1] == group), key=lambda r: (*sort_key(r[2], descending), r[0]))
        got = {r["id"]: r["rank"] for r in ranked if r["g"] == group}
        assert got == {r[0]: i for i, r in enumerate(want, start=1)}
        assert {r["n"] for r in ranked if r["g"] == group} == {len(want)}


@pytest.mark.parametrize("bound", [50, 1_000_000])
@pytest.mark.parametrize("k", [1, 700, 2999])
def test_cut_by_text_ids_on_both_sides_of_the_bound(folios, monkeypatch, bound, k):
    monkeypatch.setattr(R, "SELECT_ROWS", bound)
    rows, df = folios
    cut = R.kth_smallest(df, "v", "id", k)
    want = sorted(rows, key=lambda r: (*sort_key(r[2], False), r[0]))
    assert cut.ident == want[k - 1][0]
    covered = {r["id"] for r in df.filter(cut.covers(F.col("v"), F.col("id"))).collect()}
    assert covered == {r[0] for r in want[:k]}


def test_ids_that_share_a_beginning_are_cut_evenly(spark):
    df = spark.range(20_000).select(F.format_string("household-%06d", "id").alias("id"), F.lit(1.0).alias("v"))
    number = R._id_number(df, "id")
    bounds = R._boundaries(df, F.col("v"), number, 16)
    keyed = R._with_buckets(df, F.col("v"), number, bounds, False)
    assert keyed.groupBy("_b", "_s").count().agg(F.max("count")).first()[0] < 20_000 / 16 * 3


def test_no_rows_asked_for(frame):
    assert R.kth_smallest(frame, "v", "id", 0) is None


@pytest.mark.parametrize("p", [0.0, 0.5, 0.8, 1.0])
def test_stratified_split_sizes(frame, p):
    split = stratified_split(frame, "g", "id", p)
    counts = {(r["g"], r["split"]): r["count"] for r in split.groupBy("g", "split").count().collect()}
    sizes = {g: sum(1 for r in make_rows() if r[1] == g) for g in ("hot", "a", None)}
    for group, n in sizes.items():
        train = math.ceil(n * p)
        assert counts.get((group, "train"), 0) == train
        assert counts.get((group, "test"), 0) == n - train


def test_stratified_split_same_rows_every_time(spark, frame):
    first = {r["id"] for r in stratified_split(frame, "g", "id").filter("split = 'train'").collect()}
    again = {r["id"] for r in stratified_split(frame.repartition(16), "g", "id").filter("split = 'train'").collect()}
    other = {r["id"] for r in stratified_split(frame, "g", "id", seed=5).filter("split = 'train'").collect()}
    assert first == again and first != other


def test_singleton_class_goes_to_train(spark):
    df = spark.createDataFrame([(1, "only"), (2, "x"), (3, "x")], "id long, g string")
    got = {r["id"]: r["split"] for r in stratified_split(df, "g", "id").collect()}
    assert got[1] == "train"


@pytest.mark.parametrize("few", [200_000, 3000, 10])
def test_cut_points_of_groups(spark, monkeypatch, few):
    """Ties, hot values, missing values and small groups, against a sort."""
    random.seed(8)
    monkeypatch.setattr(R, "SMALL_GROUP", 50)
    monkeypatch.setattr(R, "SKETCH", 200)
    monkeypatch.setattr(R, "FEW_ROWS", few)
    rows = []
    for g, n in (("a", 3000), ("b", 700), ("c", 20), (None, 60), ("tied", 900)):
        for _ in range(n):
            value = random.choice([None, math.nan, random.random()] + [random.gauss(0, 9)] * 9)
            value = 5.0 if g == "tied" and random.random() < 0.7 else value
            rows.append((g, value, len(rows) * 7919 % 10007))
    df = spark.createDataFrame(rows, "g string, v double, i long")
    fractions = [0.95, 0.5, 0.1, 0.0]
    n = F.col("n")
    ranks = [F.floor(n * F.lit(f)) for f in fractions]
    found = {r["g"]: r for r in R.group_cut_points(df, "g", "v", "i", fractions, ranks).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(((v is None or v != v, 0 if v is None or v != v else v, i) for x, v, i in rows if x == g))
        assert found[g]["n"] == len(mine)
        for f, cut in zip(fractions, found[g]["cuts"]):
            k = int(len(mine) * f)
            if k == 0:
                assert cut is None
            else:
                missing, v, i = mine[k - 1]
                assert cut["i"] == i and cut["v"] == (math.inf if missing else v)
