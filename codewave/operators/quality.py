"""Coding quality per wave, per code and per cut-off."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.functions.codes import agreement_text
from codewave.functions.nulls import count_if, is_in, mean_or_null, sum_or_null
from codewave.operators.assemble import floor_share, ordered_waves
from codewave.operators.joins import null_safe_join
from codewave.operators.rank import at_or_before, exact_rank, group_cut_points, kth_smallest
from codewave.operators.triage import exclude_listed
from codewave.session import stage_table

# Shares of a wave tried as cut-off, and the limits of the difficulty bins.
CUTS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
BIN_LIMITS = (0.0, *CUTS, 1.0)
BIN_LABELS = (
    "0,05", "0,1", "0,15", "0,2", "0,25", "0,3", "0,35", "0,4", "0,45", "0,5", "0,55", "0,6", "1",
)


# --- accuracy ---------------------------------------------------------------------


def accuracy_overall(df: DataFrame, hit: str, skip_nulls: bool = False) -> DataFrame:
    return df.agg(
        mean_or_null(F.col(hit), skip_nulls).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def accuracy_top_confidence(
    df: DataFrame, hit: str, confidence: str, ident: str, p: float = 0.3
) -> DataFrame:
    """Mean hit over the floor(n * p) most confident rows."""
    cut = kth_smallest(df, confidence, ident, lambda n: floor_share(n, p), descending=True)
    top = df.limit(0) if cut is None else df.filter(cut.covers(F.col(confidence), F.col(ident)))
    return accuracy_overall(top, hit)


def accuracy_by_code(df: DataFrame, code: str, hit: str, skip_nulls: bool = False) -> DataFrame:
    return (
        df.groupBy(code)
        .agg(mean_or_null(F.col(hit), skip_nulls).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.col(code).asc_nulls_last())
    )


def errors_by_class(
    df: DataFrame, truth: str, hit: str, confidence: str, min_n: int = 5
) -> DataFrame:
    """Mean confidence and number of misses per true class with more than ``min_n``."""
    return (
        df.filter(F.col(hit) == 0)
        .groupBy(truth)
        .agg(mean_or_null(F.col(confidence)).alias("mean_confidence"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > min_n)
    )


def low_confidence(
    df: DataFrame, confidence: str, threshold: float = 0.2, truth: str | None = None, value=None
) -> DataFrame:
    """Rows below a confidence bound, on request of one true class only."""
    low = df.filter(F.col(confidence) < F.lit(float(threshold)))
    return low if truth is None else low.filter(F.col(truth) == value)


def accuracy_by_wave(df: DataFrame, wave: str, hit: str, skip_nulls: bool = False) -> DataFrame:
    """Hits over rows per wave, in survey order."""
    per_wave = df.groupBy(wave).agg(
        sum_or_null(F.col(hit), skip_nulls).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    per_wave = per_wave.withColumn("accuracy", F.col("hits") / F.col("n")).drop("hits")
    return ordered_waves(per_wave, wave).orderBy(F.col("wave_order").asc_nulls_last())


def compare_models(df: DataFrame, a: str, b: str, truth: str, wave: str) -> DataFrame:
    """Hits and accuracy of two predictors, overall and per wave, in one pass."""
    hit_a = F.coalesce(F.col(a) == F.col(truth), F.lit(False)).cast("int")
    hit_b = F.coalesce(F.col(b) == F.col(truth), F.lit(False)).cast("int")
    return (
        df.rollup(wave)
        .agg(
            F.sum(hit_a).alias("hits_a"),
            F.sum(hit_b).alias("hits_b"),
            F.avg(hit_a).alias("accuracy_a"),
            F.avg(hit_b).alias("accuracy_b"),
            F.grouping(wave).alias("is_total"),
        )
        .withColumn("scope", F.when(F.col("is_total") == 1, F.lit("all")).otherwise(F.lit("wave")))
        .drop("is_total")
    )


# --- confusion --------------------------------------------------------------------


def _pairs_in_range(df: DataFrame, truth: str, predicted: str) -> tuple[DataFrame, DataFrame]:
    """Pair counts, and the range of true labels, from one aggregate of the rows."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = stage_table(pairs, "pairs")
    span = pairs.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return pairs, span


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, keys: DataFrame, index: str, label: str
) -> DataFrame:
    """Dense true x predicted counts over min..max of the true labels, with label names."""
    pairs, span = _pairs_in_range(df, truth, predicted)
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("t"), "lo", "hi").select(
        "t", F.explode(F.sequence("lo", "hi")).alias("p")
    )
    cells = grid.join(pairs, ["t", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    names = keys.select(F.col(index).cast("int").alias("k"), F.col(label).alias("name"))
    true_names = names.select(F.col("k").alias("t"), F.col("name").alias("real"))
    predicted_names = names.select(F.col("k").alias("p"), F.col("name").alias("predicho"))
    return (
        cells.join(true_names, "t", "left")
        .join(predicted_names, "p", "left")
        .select("t", "p", "real", "predicho", "n")
    )


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One-vs-rest metrics per class over min..max of the true labels, wide."""
    pairs, span = _pairs_in_range(df, truth, predicted)
    classes = span.select(F.explode(F.sequence("lo", "hi")).alias("codigo_int"))
    t, p = F.col("t"), F.col("p")
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    pairs = pairs.filter(t.between(lo, hi) & p.between(lo, hi))
    # Each pair counts once for its true and once for its predicted class.
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(t.alias("c"), F.lit(True).alias("is_true"), (t == p).alias("same")),
                F.struct(p.alias("c"), F.lit(False).alias("is_true"), (t == p).alias("same")),
            )
        ).alias("s"),
        "n",
    ).select("s.*", "n")
    per_class = sides.groupBy(F.col("c").alias("codigo_int")).agg(
        F.sum(F.when(F.col("is_true") & F.col("same"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("is_true") & ~F.col("same"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("is_true") & ~F.col("same"), F.col("n")).otherwise(0)).alias("fn"),
    )
    total = pairs.agg(F.sum("n").alias("total")).scalar()
    right = pairs.filter(t == p).agg(F.sum("n").alias("right")).scalar()
    counted = classes.join(per_class, "codigo_int", "left").fillna(0, ["tp", "fp", "fn"])
    counted = counted.withColumns({"total": total, "right": F.coalesce(right, F.lit(0))})
    counted = counted.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = F.try_divide
    rates = counted.withColumns(
        {
            "precision": div(tp, tp + fp),
            "recall": div(tp, tp + fn),
            "specificity": div(tn, tn + fp),
            "npv": div(tn, tn + fn),
            "error_rate": div(fp + fn, tp + fp + fn + tn),
            "jaccard": div(tp, tp + fp + fn),
            "dor": div(tp * tn, fp * fn),
            "mcc": div(
                tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
            ),
            "accuracy": div(F.col("right").cast("double"), F.col("total").cast("double")),
        }
    )
    prec, rec, spec, npv = (F.col(c) for c in ("precision", "recall", "specificity", "npv"))

    def f_beta(beta: float) -> Column:
        square = beta * beta
        return div((1 + square) * prec * rec, square * prec + rec)

    return rates.select(
        "codigo_int", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "specificity", "npv",
        "error_rate", "jaccard", "dor", "mcc",
        div(fp, fp + tn).alias("fpr"),
        div(fn, fn + tp).alias("fnr"),
        div(fp, fp + tp).alias("fdr"),
        div(fn, fn + tn).alias("for_rate"),
        f_beta(0.5).alias("f05"),
        f_beta(1.0).alias("f1"),
        f_beta(2.0).alias("f2"),
        ((rec + spec) / 2).alias("balanced_accuracy"),
        F.sqrt(rec * spec).alias("geometric_mean"),
        div(rec, 1 - spec).alias("lr_plus"),
        div(1 - rec, spec).alias("lr_minus"),
        (rec + spec - 1).alias("youden"),
        (prec + npv - 1).alias("mk"),
        (1 - F.col("error_rate") - div(F.abs(spec - rec), spec + rec)).alias("op"),
    )


# --- agreement --------------------------------------------------------------------


def _share_of(flag: str, value: str) -> tuple[Column, Column]:
    n = F.count(F.lit(1))
    return n, count_if(agreement_text(F.col(flag)) == value) / n


def agreement_by_code(
    df: DataFrame, code: str, flag: str, catalogue: DataFrame, label: str, value: str = "si"
) -> DataFrame:
    """Share and number of rows per catalogue code that carry the flag; 0 where none does.

    A code's share of one flag is a single conditional count, so the dense code x flag
    table is never built.
    """
    n, share = _share_of(flag, value)
    per_code = df.groupBy(code).agg(share.alias("prop"), n.alias("n"))
    return per_code.join(catalogue.select(code, label), code).orderBy(code)


def agreement_summary(df: DataFrame, flag: str) -> DataFrame:
    """Rows and share of all rows per flag."""
    counts = stage_table(df.groupBy(flag).agg(F.count(F.lit(1)).alias("n")), "flags")
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("prop", F.col("n") / total)


def agreement_across_waves(
    df: DataFrame,
    code: str,
    flag: str,
    wave: str,
    waves: Sequence[int],
    catalogue: DataFrame,
    value: str = "si",
) -> DataFrame:
    """Share and number per code side by side for some waves; null where a wave lacks it."""
    columns = []
    for w in waves:
        here = F.col(wave) == w
        n = count_if(here)
        hits = count_if(here & (agreement_text(F.col(flag)) == value))
        columns += [F.when(n > 0, hits / F.when(n > 0, n)).alias(f"prop{w}"), F.when(n > 0, n).alias(f"n{w}")]
    wide = df.filter(F.col(wave).isin(list(waves))).groupBy(code).agg(*columns)
    return wide.join(catalogue.select(code), code)


def percent_text(share: Column) -> Column:
    """A share as text in percent: two decimals, half to even, no trailing zeros."""
    rounded = F.bround(share * 100, 2).cast("decimal(7,2)").cast("string")
    return F.concat(F.regexp_replace(rounded, r"\.?0+$", ""), F.lit("%"))


def flag_share_by_wave(df: DataFrame, wave: str, flag: str) -> DataFrame:
    counts = df.groupBy(wave, flag).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(wave))
    return counts.withColumn("share", percent_text(share)).orderBy(wave, F.desc(flag))


# --- cut-offs ---------------------------------------------------------------------


def _cut_text(p: float) -> str:
    return f"{p:.2f}"


def _ranked_in_wave(df: DataFrame, wave: str, difficulty: str, ident: str, hit: str) -> DataFrame:
    """Position of a row in its wave, hardest first, and the size of the wave."""
    narrow = df.select(wave, difficulty, ident, hit)
    return exact_rank(narrow, difficulty, ident, group_by=[wave], size_out="wave_n")


def cutoff_accuracy_grid(
    df: DataFrame,
    wave: str,
    difficulty: str,
    ident: str,
    hit: str,
    cuts: Sequence[float] = CUTS,
) -> DataFrame:
    """Per wave and cut p, the share of hits in its floor(n * p) easiest rows.

    Unknown hits count as rows but not as hits, and a slice without hits is 0. The first
    row of every slice is found first, for all waves and cuts at once; the counts are then
    conditions on the rows where they are, which are not exchanged.
    """
    size = {p: F.floor(F.col("n") * F.lit(float(p))) for p in cuts}
    bounds = group_cut_points(df, wave, difficulty, ident, [1 - p for p in cuts], [F.col("n") - size[p] for p in cuts])
    marked = null_safe_join(df.select(wave, difficulty, ident, hit), bounds, [wave])
    hits = [
        count_if((F.col(hit) == 1) & ~at_or_before(F.col(difficulty), F.col(ident), F.col("cuts")[i])).alias(f"h{i}")
        for i in range(len(cuts))
    ]
    per_wave = marked.groupBy(wave, "n").agg(*hits)
    cells = F.array(
        *[
            F.struct(
                F.lit(_cut_text(p)).alias("cut"),
                F.lit(float(p)).alias("p"),
                size[p].alias("k"),
                F.col(f"h{i}").alias("hits"),
            )
            for i, p in enumerate(cuts)
        ]
    )
    return per_wave.select(wave, "n", F.explode(cells).alias("c")).select(
        wave, "n", "c.cut", "c.p", "c.k", "c.hits",
        F.when(F.col("c.k") > 0, F.col("c.hits") / F.when(F.col("c.k") > 0, F.col("c.k")))
        .otherwise(F.lit(0.0))
        .alias("accuracy"),
    )


def cutoff_loss_grid(grid: DataFrame, wave: str) -> DataFrame:
    """Expected miscoded rows (1 - accuracy) * n * p, half to even, and the wave size."""
    loss = F.bround((1 - F.col("accuracy")) * (F.col("n") * F.col("p")), 0).cast("bigint")
    losses = grid.select(wave, "cut", loss.alias("value"))
    totals = grid.groupBy(wave).agg(F.max("n").alias("value"))
    return losses.unionByName(totals.select(wave, F.lit("Total_sm").alias("cut"), "value"))


def cutoff_grid_excluding(
    df: DataFrame,
    listed: DataFrame,
    keys: Sequence[str],
    wave: str,
    difficulty: str,
    ident: str,
    hit: str,
    cuts: Sequence[float] = CUTS,
) -> DataFrame:
    """The accuracy grid without the rows of a listed subgroup."""
    return cutoff_accuracy_grid(exclude_listed(df, listed, keys), wave, difficulty, ident, hit, cuts)


def difficulty_bins(
    df: DataFrame, wave: str, difficulty: str, ident: str, hit: str, limits: Sequence[float] = BIN_LIMITS
) -> DataFrame:
    """Per wave, d = n - position, and its bin between quantiles of d.

    d runs through 0..n-1, so its type-7 quantile at p is p * (n - 1). Bins are closed
    on the left, the last on both sides; breaks that coincide leave the upper bin.
    """
    ranked = _ranked_in_wave(df, wave, difficulty, ident, hit)
    d = F.col("wave_n") - F.col("rank")
    breaks = [F.round(F.lit(float(p)) * (F.col("wave_n") - 1), 9) for p in limits]
    passed = reduce(lambda a, b: a + b, [(b <= d).cast("int") for b in breaks[:-1]])
    return ranked.select(wave, ident, hit, d.alias("d"), passed.alias("bin"))


def difficulty_bin(
    df: DataFrame, wave: str, difficulty: str, ident: str, hit: str, limits: Sequence[float] = BIN_LIMITS
) -> DataFrame:
    """The bins of ``difficulty_bins`` without the positions: rows are compared with the breaks
    of their wave where they are, and none is exchanged."""
    breaks = [F.round(F.lit(float(p)) * (F.col("n") - 1), 9) for p in limits[:-1]]
    ranks = [F.floor(F.col("n") - b) for b in breaks]  # d >= b for the rows up to this one
    bounds = group_cut_points(df, wave, difficulty, ident, [1 - p for p in limits[:-1]], ranks)
    marked = null_safe_join(df.select(wave, difficulty, ident, hit), bounds, [wave])
    passed = [
        at_or_before(F.col(difficulty), F.col(ident), F.col("cuts")[i]).cast("int") for i in range(len(ranks))
    ]
    return marked.select(wave, ident, hit, reduce(lambda a, b: a + b, passed).alias("bin"))


def cumulative_misses(bins: DataFrame, wave: str, hit: str, labels: Sequence[str] = BIN_LABELS) -> DataFrame:
    """Misses per wave, cumulated over the bins, one column per bin."""
    totals = [
        sum_or_null(
            F.when(F.col("bin") <= i, (F.col(hit) == 0).cast("int")).otherwise(0)
        ).alias(f"hasta_{label.replace(',', '_')}")
        for i, label in enumerate(labels, start=1)
    ]
    return bins.groupBy(wave).agg(*totals)


# --- tables -----------------------------------------------------------------------


def _listed(value: Column, values: Sequence) -> Column:
    """``value``, or an error in the running job where it is neither listed nor missing."""
    unlisted = F.raise_error(F.concat(F.lit("value without a column: "), value.cast("string")))
    return F.when(value.isNull() | value.isin(*values), value).otherwise(unlisted)


def code_by_wave(df: DataFrame, code: str, hit: str, wave: str, waves: Sequence[int]) -> DataFrame:
    """Rows per code and hit, one column per wave; null where there are none.

    A row of a wave that is not in ``waves`` is an error: the table would lack it.
    """
    df = df.withColumn(wave, _listed(F.col(wave), waves))
    return df.groupBy(code, hit).pivot(wave, list(waves)).agg(F.count(F.lit(1)))


def crosstab(df: DataFrame, a: str, b: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Counts of one column, or of two with ``values`` of the second as columns; no nulls.

    A value of ``b`` that is not in ``values`` is an error: the table would lack it.
    """
    if b is None:
        return df.filter(F.col(a).isNotNull()).groupBy(a).agg(F.count(F.lit(1)).alias("n"))
    kept = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    kept = kept.withColumn(b, _listed(F.col(b), values))
    return kept.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def count_by(df: DataFrame, cols: Sequence[str], sort: bool = True) -> DataFrame:
    """Frequency table in which missing is a value."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *[F.col(c).asc_nulls_last() for c in cols]) if sort else counts


def wave_totals(df: DataFrame, wave: str, waves: Sequence[int]) -> DataFrame:
    """Rows of some waves, in the order given."""
    totals = df.filter(is_in(F.col(wave), waves)).groupBy(wave).agg(F.count(F.lit(1)).alias("n"))
    return ordered_waves(totals, wave, waves, out="position").orderBy("position")


def unpivot_rates(df: DataFrame, ids: Sequence[str], cols: Sequence[str], wave: str = "wave") -> DataFrame:
    """One row per rate column, in percent."""
    long = df.unpivot(list(ids), list(cols), wave, "value")
    return long.select(*ids, wave, (F.col("value") * 100).alias("pct"))
