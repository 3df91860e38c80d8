"""Missing-value rules of the survey code, written as Spark expressions.

A missing value is never equal to a listed value, poisons a mean or a sum, and does
match another missing value in a join (see ``operators.joins``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_in(col: Column, values: Iterable) -> Column:
    """Membership test that is false, not null, for a missing value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def mean_or_null(col: Column, skip_nulls: bool = False) -> Column:
    """Mean that is null as soon as one input is null, unless ``skip_nulls``."""
    mean = F.avg(col)
    return mean if skip_nulls else F.when(F.count(col) == F.count(F.lit(1)), mean)


def sum_or_null(col: Column, skip_nulls: bool = False) -> Column:
    total = F.sum(col)
    return total if skip_nulls else F.when(F.count(col) == F.count(F.lit(1)), total)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def code_text(df: DataFrame, name: str) -> Column:
    """A class code as text; whole numbers lose their decimal part (3.0 -> '3')."""
    dtype = df.schema[name].dataType
    col = df[name]
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = col.cast("bigint")
        return F.when(whole == col, whole.cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def padded_code(code: Column, width: int = 2) -> Column:
    """Codes padded with zeros so that '3' and '03' compare as equal."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def as_number(col: Column) -> Column:
    """Text to whole number; text that is no number becomes null."""
    return col.try_cast("double").try_cast("bigint")
