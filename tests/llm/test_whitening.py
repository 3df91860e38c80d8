"""Whitening against a plain numpy version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewave.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components=4):
    kept = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, tuple(math.floor(256 * float(c)) for c in v)))
    fit = sorted({x for _, x in kept})
    n = len(fit)
    matrix = np.array(fit, float)
    sums = [sum(col) for col in zip(*fit)]
    centred = matrix - np.array([s / n for s in sums])
    covariance = centred.T @ centred / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = np.array(x, float) - np.array([s / n for s in sums])
        for c in range(min(components, len(x))):
            out[i, c + 1] = (n, deviation, z @ vector[:, c] / math.sqrt(value[c]), value[c] / value.sum())
    return out


def check(found, wanted):
    assert len(found) == len(wanted)
    signs = {}
    for r in found:
        n, deviation, white, explained = wanted[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(white), rel=1e-6, abs=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(white) > 1e-6:
            signs.setdefault(r["component"], set()).add(r["whitened"] * white > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    wanted = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    check(queries.QUERIES["op13_whitening"](spark, SF).collect(), wanted)


def test_nulls_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # a hot vector
    rows += [(200, None), (201, [None] * 6), (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"x": F.lit("x"), "weight": F.lit(1), "length": F.lit(None).cast("int"), "n": F.lit(0)}
    )
    check(whitening.whiten(df).collect(), brute(rows))
    counted = whitening.whiten(df, by_count=True).collect()
    assert {r["n"] for r in counted} == {70} and all(r["identity_error"] < 1e-9 for r in counted)


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [0.5, -0.5]), (1, [0.5, -0.5])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, None, None)
    ] * 4
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [])], schema)).collect()
    by = {(r["vec_id"], r["component"]): r for r in line}
    assert set(by) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert by[1, 1]["explained"] == pytest.approx(1) and by[1, 2]["whitened"] is None


def test_lengths_apart_and_entries_beyond_64_bits(spark):
    rows = [(i, [float(i), float(i * i), 1.0]) for i in range(5)] + [(10 + i, [float(i), -2.0 * i * i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, components=2).collect()
    assert {(r["vec_id"] >= 10, r["n"]) for r in got} == {(False, 5), (True, 5)} and len(got) == 20
    large = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(large).collect()
    assert len(got) == 4 and all(r["deviation"] is None for r in got)
