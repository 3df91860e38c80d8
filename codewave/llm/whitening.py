"""Whitening of embeddings, fitted on distinct vectors.

1. Every entry becomes a whole number x = floor(SCALE * entry). Equal x vectors are put
   together; each counts once in the fit, or as often as it occurs (``by_count``).
2. One pass sums x by dimension, exactly. A second centres x and multiplies it with itself
   (one product of matrices per batch of rows); Spark adds the products up. What reaches the
   driver is one row of dimension x dimension numbers, whatever the number of vectors.
3. Its unit eigenvectors, by falling eigenvalue, whiten each distinct vector once; the rows
   fetch the result by joining on x. A vector that a third of all rows share is one row on
   the right of that join, and adaptive execution splits the left.

Defined cases: a row whose vector is null or holds a null or a non-finite entry is left out;
rows that repeat an id are rows of their own, a null id stays null; vectors of another length
are another space with a fit of its own; a vector has min(components, length) rows, so an empty
one has none. An entry whose x does not fit 64 bits has the largest (smallest) one. A deviation
that does not fit 64 bits is null. A component without variance (or with less than rounding
leaves) has a null ``whitened``; ``explained`` is null if nothing varies, and
``identity_error`` if no component could be whitened. An empty table gives an empty result.
Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.session import stage_table

SCALE = 256
COMPONENTS = 4
_LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    #: length x components that can be whitened
    matrix: np.ndarray
    explained: list[float | None]


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.filter(F.col("v").isNotNull() & ~bad)
    return whole.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))


def _matrices(batch: pa.RecordBatch, column: str, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, places, rows) of a column of lists, one matrix per key; a key has one length."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    length = np.diff(lists.offsets.to_numpy())
    start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    keys = batch.column(key).to_numpy()
    for k in np.unique(keys):
        at = np.flatnonzero(keys == k)
        width = length[at[0]] if len(at) else 0
        yield int(k), at, flat[start[at][:, None] + np.arange(width)[None, :]]


def _exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Sums by dimension, in 64 bits where those suffice."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if largest * int(weight.sum()) < _LARGEST:
        return (x * weight[:, None]).sum(axis=0).tolist()
    return (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0).tolist()


def _dimension_sums(vectors: DataFrame) -> DataFrame:
    """(length, dim, total, n) of (x, length, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for k, at, x in _matrices(batch, "x", "length"):
                new = _exact_sums(x, weight[at])
                sums[k] = [a + b for a, b in zip(sums.get(k, [0] * len(new)), new)]
                sizes[k] = sizes.get(k, 0) + int(weight[at].sum())
        cells = [(k, d, Decimal(v), sizes[k]) for k, row in sums.items() for d, v in enumerate(row)]
        columns = list(zip(*cells)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["length", "dim", "total", "n"]
        )

    partial = vectors.mapInArrow(run, "length int, dim int, total decimal(38,0), n bigint")
    return partial.groupBy("length", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _centred_products(vectors: DataFrame, column: str, mean: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per key the weighted sum of the products of centred rows, as a square matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy().astype(float)
            for k, at, rows in _matrices(batch, column, "length"):
                centred = rows - mean[k]
                total[k] = total.get(k, 0.0) + (centred * weight[at][:, None]).T @ centred
        cells = [(k, i, row) for k, square in total.items() for i, row in enumerate(square)]
        columns = list(zip(*cells)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["length", "i", "row"])

    partial = vectors.mapInArrow(run, "length int, i int, row array<double>")
    added = partial.groupBy("length", "i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    found: dict[int, list] = {}
    for r in added.select("length", "i", vector_to_array("row").alias("row")).collect():
        found.setdefault(r["length"], []).append((r["i"], r["row"]))
    return {k: np.array([row for _, row in sorted(rows)]) for k, rows in found.items()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of (x, length, weight); dimension x dimension numbers each."""
    cells: dict[int, list] = {}
    for r in _dimension_sums(vectors).collect():
        cells.setdefault(r["length"], []).append((r["dim"], int(r["total"]), r["n"]))
    sums = {k: [total for _, total, _ in sorted(rows)] for k, rows in cells.items()}
    sizes = {k: rows[0][2] for k, rows in cells.items()}
    mean = {k: np.array([s / sizes[k] for s in row]) for k, row in sums.items()}
    fits = {}
    if not mean:
        return fits
    for k, products in _centred_products(vectors.filter("length > 0"), "x", mean).items():
        covariance = products / sizes[k]
        value, vector = np.linalg.eigh(covariance)
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
        trace = float(np.trace(covariance))
        sound = value > max(trace, 0.0) * k * np.finfo(float).eps
        # The sign that makes the largest entry positive, the same for all rows.
        sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])
        matrix = (vector * sign)[:, sound] / np.sqrt(value[sound])
        explained = [float(max(v, 0.0)) / trace if trace > 0 else None for v in value]
        fits[k] = Fit(sizes[k], sums[k], mean[k], matrix, explained)
    return fits


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums))
    if largest * largest * x.shape[1] < _LARGEST:
        return np.square(x * np.int64(n) - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v <= _LARGEST else None for v in exact.tolist()]


def apply(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(x, length, weight, deviation, w): each distinct vector whitened once."""
    schema = pa.schema(
        [
            ("x", pa.list_(pa.int64())), ("length", pa.int32()), ("weight", pa.int64()),
            ("deviation", pa.int64()), ("w", pa.list_(pa.float64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, x in _matrices(batch, "x", "length"):
                own, took = fits[k], batch.take(pa.array(at))
                white = (x - own.mean) @ own.matrix
                columns = [
                    took.column("x"), took.column("length"), took.column("weight"),
                    pa.array(_deviations(x, own.n, own.sums), pa.int64()), pa.array(list(white), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return vectors.filter("length > 0").mapInArrow(
        run, "x array<bigint>, length int, weight bigint, deviation bigint, w array<double>"
    )


def identity_errors(white: DataFrame) -> dict[int, float]:
    """Per length the largest entry of the whitened vectors' covariance minus the identity."""
    cells = white.select("length", "weight", F.posexplode("w").alias("i", "w"))
    weighted = F.sum(F.col("w") * F.col("weight")) / F.sum("weight")
    mean: dict[int, list] = {}
    for r in cells.groupBy("length", "i").agg(weighted.alias("m")).collect():
        mean.setdefault(r["length"], []).append((r["i"], r["m"]))
    centres = {k: np.array([m for _, m in sorted(rows)]) for k, rows in mean.items()}
    if not centres:
        return {}
    sizes = {r["length"]: r["n"] for r in white.groupBy("length").agg(F.sum("weight").alias("n")).collect()}
    squares = _centred_products(white.filter(F.size("w") > 0), "w", centres)
    return {k: float(np.abs(s / sizes[k] - np.eye(len(s))).max()) for k, s in squares.items()}


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    by_count: bool = False,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row per component.

    ``n`` is the size of the fit: distinct vectors, or with ``by_count`` all of them.
    """
    rows = whole_vectors(df, id_col, vector_col)
    weight = F.count(F.lit(1)) if by_count else F.lit(1).cast("bigint")
    distinct = rows.groupBy("x").agg(weight.alias("weight"))
    distinct = stage_table(distinct.select("x", F.size("x").alias("length"), "weight"), "vectors")
    fits = fit(distinct, components)
    white = stage_table(apply(distinct, fits), "white")
    errors = identity_errors(white)
    spark = df.sparkSession
    stats = [(k, f.n, f.explained, errors.get(k)) for k, f in fits.items()]
    known = spark.createDataFrame(stats, "length int, n bigint, explained array<double>, identity_error double")
    joined = rows.join(white.drop("weight"), "x").join(known, "length")
    each = joined.select("*", F.posexplode("explained").alias("_at", "_explained"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("_at") + 1).alias("component"),
        "n",
        "deviation",
        F.get("w", "_at").alias("whitened"),
        F.col("_explained").alias("explained"),
        "identity_error",
    )
