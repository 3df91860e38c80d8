"""Scoring a new wave with a trained classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.functions import arrays as A
from codewave.operators.joins import lookup, null_safe_join
from codewave.operators.reconcile import drop_sentinels
from codewave.operators.texts import blank_specials, combine_text, normalize_columns
from codewave.operators.train import Classifier


def prepare_wave(
    df: DataFrame, text_cols: Sequence[str] = ("oficio", "tareas"), out: str = "oficio_tarea"
) -> DataFrame:
    """Drop no-answers, normalise and paste the texts, blank special codes in the last."""
    first, last = text_cols[0], text_cols[-1]
    prepared = normalize_columns(drop_sentinels(df, first), text_cols)
    prepared = combine_text(prepared, out, [f"{c}_proc" for c in text_cols])
    return blank_specials(prepared, [f"{last}_proc"])


def score_wave(model: Classifier, df: DataFrame, text_cols: Sequence[str] = ("oficio", "tareas")) -> DataFrame:
    """Prepared rows with class probabilities, best index, difficulty and confidence.

    The state of training travels in the tables of the model; no training data is read.
    """
    scored = model.score(prepare_wave(df, text_cols)).withColumn("proba", F.col("probability"))
    return scored.select(
        *df.columns,
        "proba",
        A.best_index(F.col("proba")).alias("codigo_int"),
        A.difficulty_ratio(F.col("proba")).alias("dificultad"),
        A.top_probability(F.col("proba")).alias("pbb_caso"),
    )


def decode_prediction(
    df: DataFrame, proba: str, keys: DataFrame, catalogue: DataFrame, code: str = "aeciuo_2", index: str = "codigo_int"
) -> DataFrame:
    """Best index, its code and the code's label; both tables are broadcast if small.

    An index whose code is not in the catalogue has neither code nor label.
    """
    labelled = null_safe_join(keys, catalogue, [code], "inner")
    return lookup(df.withColumn(index, A.best_index(F.col(proba))), labelled, [index], "left")


def top_k_codes(
    df: DataFrame, proba: str, ident: str, k: int, keys: DataFrame | None = None, index: str = "codigo_int"
) -> DataFrame:
    """The k best codes of each row with their rank."""
    best = df.select(ident, F.posexplode(A.best_k(F.col(proba), k)).alias("pos", "best"))
    best = best.select(ident, (F.col("pos") + 1).alias("rank"), f"best.{index}", "best.proba")
    return best if keys is None else lookup(best, keys, [index])
