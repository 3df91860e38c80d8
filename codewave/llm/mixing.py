"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p**a. The exponent
a is the largest one that reaches the target entropy, unless documents would then be
repeated more often than allowed: then it is the smallest one that keeps the limit. Both
bounds are found by bisection; a step adds up one row per source and brings back two
numbers. The weights become token budgets. A budget is realised as whole passes over the
source and one partial pass; every pass visits the source's blocks in a permutation of its
own, and the partial pass ends where the next document would exceed the budget.

Defined cases: a null source is a source of its own; null and blank texts have no tokens
and are taken along without using a budget, once if their source has no tokens at all;
repeated rows are mixed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.session import stage_table

BLOCKS = 256  # of each source
STEPS = 20  # halvings of the exponent's range
ENTROPY_SHARE = 0.95  # of the largest entropy possible
MAX_PASSES = 4.0
WORD = "[^\\x20\\x09-\\x0D]+"


def count_tokens(text: Column) -> Column:
    """Words between white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def solve_exponent(
    sources: DataFrame,
    budget: int,
    entropy_share: float = ENTROPY_SHARE,
    max_passes: float = MAX_PASSES,
    steps: int = STEPS,
) -> float:
    """The exponent for a table (tokens) with one row per source, all above zero."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    target, rate = entropy_share * math.log(n), budget / total

    def measure(a: float) -> list[Column]:
        return [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1)))]

    def entropy_reached(s0: float, s1: float, _: float, a: float) -> bool:
        return math.log(s0) - a * s1 / s0 >= target

    def limit_kept(s0: float, _: float, most: float, __: float) -> bool:
        return rate * most / s0 <= max_passes

    # by_entropy: reached at its low end, missed at its high end; by_limit: the other way round.
    by_entropy, by_limit = [0.0, 1.0], [0.0, 1.0]
    ends = sources.agg(*measure(0.0), *measure(1.0)).first()
    if entropy_reached(*ends[3:], 1.0):
        by_entropy = [1.0, 1.0]
    if limit_kept(*ends[:3], 0.0):
        by_limit = [0.0, 0.0]
    for _ in range(steps):
        a, b = sum(by_entropy) / 2, sum(by_limit) / 2
        got = sources.agg(*measure(a), *measure(b)).first()
        by_entropy[0 if entropy_reached(*got[:3], a) else 1] = a
        by_limit[1 if limit_kept(*got[3:], b) else 0] = b
    return max(by_entropy[0], by_limit[1])


def mix_weights(sources: DataFrame, exponent: float, budget: int) -> DataFrame:
    """Adds ``weight`` and ``budget`` to (src, tokens)."""
    total = sources.filter("tokens > 0").agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)))
    power = F.coalesce(power, F.lit(0.0))
    whole = sources.agg(F.sum(power)).first()[0] or 1.0
    out = sources.withColumn("weight", power / F.lit(whole))
    return out.withColumn("budget", F.floor(F.col("weight") * budget + 0.5).cast("bigint"))


def mix(
    docs: DataFrame,
    budget: int | None = None,
    entropy_share: float = ENTROPY_SHARE,
    max_passes: float = MAX_PASSES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(row, source, n_tokens, pass, block_order): every row of ``docs`` as often as it is drawn.

    ``row`` holds all columns of the document. ``budget`` is in tokens, by default as many
    as there are. The order of a pass is block_order, then the digests of the id and of the
    text, so texts under one id are drawn in the same order every time.
    """
    digest = F.md5(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _source_key(F.col(source_col)).alias("src"),
        count_tokens(F.col(text_col)).alias("tokens"),
        digest.alias("d"),
        F.md5(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")).alias("e"),
    )
    number = F.conv(F.substring("d", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("block", F.pmod(number, F.lit(BLOCKS)).cast("int")).withColumn(
        "sub", F.substring("d", 9, 2)
    )

    fine = stage_table(rows.groupBy("src", "block", "sub").agg(F.sum("tokens").alias("tokens")), "mix")
    sources = stage_table(fine.groupBy("src").agg(F.sum("tokens").alias("tokens")), "sources")
    if budget is None:
        budget = sources.agg(F.sum("tokens")).first()[0] or 0
    exponent = solve_exponent(sources.filter("tokens > 0"), budget, entropy_share, max_passes)
    plan = mix_weights(sources, exponent, budget).select(
        "src",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("int").alias("full"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(-1).alias("rest"),
    )

    # At most BLOCKS rows of a source in each pass.
    blocks = fine.groupBy("src", "block").agg(F.sum("tokens").alias("tokens")).join(plan, "src")
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full"))))
    place = F.md5(F.encode(F.concat_ws(":", "src", "pass", "block"), "UTF-8"))
    passes = passes.withColumn("place", place)
    order = Window.partitionBy("src", "pass").orderBy("place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("nth", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0).cast("bigint"))
    )
    orders = passes.groupBy("src", "block", "full", "rest").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "nth"))), lambda p: p["nth"]).alias("nths"),
        F.max(F.when(F.col("pass") == F.col("full"), F.col("start"))).alias("start"),
    )
    in_block = Window.partitionBy("src", "block").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = fine.withColumn("ahead", F.coalesce(F.sum("tokens").over(in_block), F.lit(0).cast("bigint")))
    starts = starts.drop("tokens").join(orders, ["src", "block"])

    key = ["src", "block", "sub"]
    up_to = Window.partitionBy(*key).orderBy("d", "e").rowsBetween(Window.unboundedPreceding, 0)
    drawn = rows.join(starts, key).withColumn("sum", F.sum("tokens").over(up_to))
    partial = F.col("start") + F.col("ahead") + F.col("sum") <= F.col("rest")
    times = F.col("full") + partial.cast("int")
    drawn = drawn.withColumn("times", times).filter("times > 0")
    drawn = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return drawn.select(
        "row",
        F.col(f"row.{source_col}").alias("source"),
        F.col("tokens").alias("n_tokens"),
        "pass",
        F.col("nths")[F.col("pass")].alias("block_order"),
    )
