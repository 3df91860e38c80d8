"""Joins in which a missing key matches a missing key, and lookups in written tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewave.session import stage_table

def _keys_equal(left: DataFrame, right: DataFrame, on: Sequence[str], nullable: bool) -> Column:
    pairs = [(left[k], right[f"_r_{k}"]) for k in on]
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) if nullable else l == r for l, r in pairs])


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    nullable_keys: bool = True,
) -> DataFrame:
    """Join on equally named keys, null matching null; each key appears once.

    Keys that are never missing can say so: plain equality keeps the partitioning of an
    earlier aggregate or of a bucketed table, which saves a shuffle per side.
    """
    on = [on] if isinstance(on, str) else list(on)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    joined = left.join(right, _keys_equal(left, right, on, nullable_keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(left[k], right[f"_r_{k}"]) for k in on})
    return joined.drop(*[f"_r_{k}" for k in on])


def lookup(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Null-safe join to a table that is usually small.

    The table is computed once and written, so Catalyst knows its size: below the session's
    broadcast threshold it is broadcast, above it the join is shuffled and adaptive
    execution splits hot keys. No row of it passes through Python.
    """
    return null_safe_join(df, stage_table(table, "lookup"), on, how)
