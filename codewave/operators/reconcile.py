"""One code per answer out of several files, reviewers and late corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.functions.codes import agreement_text, pad_single_digit
from codewave.functions.nulls import code_text, count_if, is_in
from codewave.functions.text import SENTINEL_TEXTS
from codewave.operators.joins import lookup, null_safe_join
from codewave.session import stage_table

NO_CODE = 999
# Codes of the earlier classification that have no counterpart.
UNMAPPED_CODES = (101, 102)


def drop_sentinels(
    df: DataFrame,
    text_col: str,
    code_col: str | None = None,
    sentinels: Sequence[str] = SENTINEL_TEXTS,
    no_code: int = NO_CODE,
) -> DataFrame:
    """Drop rows whose text is a no-answer mark or whose code is 999; nulls are kept."""
    keep = ~is_in(F.col(text_col), sentinels)
    if code_col is not None:
        code = F.col(code_col)
        if df.schema[code_col].dataType.simpleString() == "string":
            no_code = str(no_code)
        keep = keep & F.coalesce(code != no_code, F.lit(True))
    return df.filter(keep)


def reconcile_sources(
    reviewed: DataFrame,
    complete: DataFrame,
    keys: Sequence[str],
    code_a: str,
    code_b: str,
    out: str = "aeciuo_2",
    reviewed_only: bool = False,
    nullable_keys: bool = True,
) -> DataFrame:
    """Full outer join; the reviewed code stands where there is one."""
    how = "left" if reviewed_only else "full"
    if reviewed_only:
        reviewed = reviewed.filter(F.col(code_a).isNotNull())
    joined = null_safe_join(reviewed, complete, keys, how, nullable_keys)
    joined = joined.withColumn(out, F.coalesce(F.col(code_a), F.col(code_b)))
    return joined.filter(~is_in(F.col(out), UNMAPPED_CODES))


def subset_audit(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys are only in A, only in B, or in both."""
    flags = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    per_key = flags.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    presence = (
        F.when(F.col("in_b") == 0, F.lit("only_a"))
        .when(F.col("in_a") == 0, F.lit("only_b"))
        .otherwise(F.lit("both"))
    )
    return per_key.groupBy(presence.alias("presence")).agg(F.count(F.lit(1)).alias("n"))


def repair_text(
    damaged: DataFrame,
    good: DataFrame,
    keys: Sequence[str],
    cols: Mapping[str, str],
    nullable_keys: bool = True,
) -> DataFrame:
    """Replace damaged columns by those of the raw file; ``cols`` maps damaged to good."""
    kept = damaged.drop(*cols)
    source = good.select(*keys, *[F.col(g).alias(d) for d, g in cols.items()])
    return null_safe_join(kept, source, keys, "inner", nullable_keys)


def _one_code(table: DataFrame, keys: Sequence[str], code: Column, name: str) -> DataFrame:
    """One correction per key, so that a row is never doubled: the lowest of several."""
    return table.groupBy(*keys).agg(F.min(code).alias(name))


def patch_codes(
    df: DataFrame,
    code: str,
    patches: Sequence[tuple[DataFrame, Sequence[str]]],
    new_code: str = "codigo_nuevo",
) -> DataFrame:
    """Overlay manual corrections; of several tables the first that matches wins."""
    candidates = []
    for i, (table, keys) in enumerate(patches):
        name = f"_patch_{i}"
        df = lookup(df, _one_code(table, keys, F.col(new_code), name), keys)
        candidates.append(name)
    chosen = F.coalesce(*[F.col(c) for c in candidates], F.col(code))
    return df.withColumn(code, chosen).drop(*candidates)


def overlay_recode(
    df: DataFrame,
    recodes: DataFrame,
    keys: Sequence[str],
    code: str,
    new_code: str = "codigo_final",
    when: Column | None = None,
) -> DataFrame:
    """Late recodes replace the code where they have one and ``when`` holds."""
    late = _one_code(recodes, keys, F.col(new_code).cast("string"), "_late")
    applies = F.col("_late").isNotNull()
    if when is not None:
        applies = applies & F.coalesce(when, F.lit(False))
    joined = lookup(df, late, keys)
    return joined.withColumn(
        code, F.when(applies, F.col("_late")).otherwise(F.col(code).cast("string"))
    ).drop("_late")


def recode_specials(df: DataFrame, code: str, dropped: Sequence[str] = ("-66", "-88")) -> DataFrame:
    """Codes fit for training: no missing, recovery or no-answer code; '3' is '03'."""
    text = code_text(df, code)
    return df.withColumn(code, text).filter(
        F.col(code).isNotNull() & ~F.col(code).isin(list(dropped))
    ).withColumn(code, pad_single_digit(F.col(code)))


def normalize_flag(df: DataFrame, flag: str, dropped: str = "66") -> DataFrame:
    """Agreement flags as 'si'/'no'; the no-answer mark and nulls are dropped."""
    return df.withColumn(flag, agreement_text(F.col(flag))).filter(F.col(flag) != dropped)


def min_support(df: DataFrame, label: str, n: int = 2) -> DataFrame:
    """Rows whose code was seen more than ``n`` times; no code counts as a code."""
    frequent = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n)
    return lookup(df, frequent.select(label), [label], "left_semi")


def label_keys(df: DataFrame, label: str, out: str = "codigo_int") -> DataFrame:
    """Distinct labels as text, sorted, numbered from 0 without gaps; null comes last.

    Only the distinct labels are numbered. They are counted per leading two characters, so
    that each task numbers one such group and adds the size of the earlier ones.
    """
    keys = df.select(code_text(df, label).alias(label)).distinct()
    keys = keys.withColumn("_initial", F.coalesce(F.substring(label, 1, 2), F.lit("\U0010ffff")))
    sizes = keys.groupBy("_initial").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_initial").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_initial", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_initial").orderBy(F.col(label).asc_nulls_last())
    return (
        keys.withColumn("_row", F.row_number().over(within))
        .join(offsets, "_initial")
        .select(label, (F.col("_before") + F.col("_row") - 1).cast("int").alias(out))
    )


def index_labels(df: DataFrame, label: str, out: str = "codigo_int") -> tuple[DataFrame, DataFrame]:
    """``(keys, df)``: the label index, computed once, and the rows with their index."""
    keys = stage_table(label_keys(df, label, out), "keys")
    return keys, null_safe_join(df.withColumn(label, code_text(df, label)), keys, [label], "left")


def label_coverage(
    df: DataFrame, label: str, arm: str, catalogue_size: int = 42, min_count: int = 5
) -> DataFrame:
    """Codes seen, their share of the catalogue, and codes above a count, overall and per arm.

    A missing code counts as a code, as in a frequency table.
    """
    counts = df.groupBy(arm, label).agg(F.count(F.lit(1)).alias("n"))
    per_arm = counts.groupBy(F.col(arm).alias("scope")).agg(
        F.count(F.lit(1)).alias("codes"), count_if(F.col("n") > min_count).alias("frequent_codes")
    )
    overall = counts.groupBy(label).agg(F.sum("n").alias("n"))
    overall = overall.agg(
        F.count(F.lit(1)).alias("codes"), count_if(F.col("n") > min_count).alias("frequent_codes")
    ).select(F.lit("all").alias("scope"), "codes", "frequent_codes")
    return overall.unionByName(per_arm).withColumn(
        "coverage", F.col("codes") / F.lit(float(catalogue_size))
    )


def missing_codes(keys: DataFrame, catalogue: DataFrame, code: str) -> DataFrame:
    """Catalogue codes that no label key carries."""
    return null_safe_join(catalogue, keys.select(code).distinct(), [code], "left_anti")


def filter_codes_worklist(
    df: DataFrame,
    code: str,
    codes: Sequence[str],
    wave: str,
    text: str,
    blank: str = "codigo_final",
    before_wave: int = 80,
) -> DataFrame:
    """Rows of some codes in waves before a bound, by text, with a column to fill in."""
    return (
        df.filter((F.col(wave) < before_wave) & F.col(code).isin(list(codes)))
        .withColumn(blank, F.lit(""))
        .orderBy(F.col(text).asc_nulls_last())
    )
