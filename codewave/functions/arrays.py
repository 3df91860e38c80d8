"""Array expressions: class probabilities and token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_index(proba: Column) -> Column:
    """Position from 0 of the highest probability, the first one on ties."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def top_probability(proba: Column) -> Column:
    return F.array_max(proba)


def difficulty_ratio(proba: Column) -> Column:
    """Highest over second-highest probability: large means easy; x/0 is infinite."""
    ranked = F.sort_array(proba, asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when(second == 0, F.when(first > 0, F.lit(float("inf")))).otherwise(first / second)


def best_k(proba: Column, k: int) -> Column:
    """The k best (index, probability) pairs, best first, lower index first on ties."""
    pairs = F.transform(proba, lambda p, i: F.struct((-p).alias("neg"), i.alias("codigo_int")))
    return F.transform(
        F.slice(F.array_sort(pairs), 1, k),
        lambda s: F.struct(s["codigo_int"].alias("codigo_int"), (-s["neg"]).alias("proba")),
    )


def pad_sequence(seq: Column, maxlen: int) -> Column:
    """Fixed length: zeros at the end, and the last ``maxlen`` items of a long one."""
    kept = F.when(F.size(seq) > maxlen, F.slice(seq, -maxlen, maxlen)).otherwise(seq)
    return F.concat(kept, F.array_repeat(F.lit(0), F.lit(maxlen) - F.size(kept)))
