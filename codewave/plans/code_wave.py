"""The coding of a new wave: from a saved model to the sheets that people fill in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.functions import arrays as A
from codewave.operators.score import decode_prediction, score_wave
from codewave.operators.train import Classifier
from codewave.operators.triage import TECHNICAL_COLUMNS, assign_reviewers, make_worksheet, triage_split
from codewave.session import stage_table
from codewave.sources.writers import publish_tables

DIFFICULTY = "dificultad"


def sheets(
    scored: DataFrame,
    keys: DataFrame,
    catalogue: DataFrame,
    ident: str,
    reviewers: Sequence[str],
    p_auto: float = 0.6,
    proba: str = "proba",
) -> tuple[DataFrame, DataFrame]:
    """``(human, technical)``: the two sheets of a wave with class probabilities.

    Every row gets ``prediccion_modelo`` and ``glosa_prediccion``. The hardest part goes to
    human coders, the rest is dealt out to reviewers; together the sheets are the wave. The
    decoded wave is written once, so that scoring runs once for the cut and both sheets.
    """
    ready = scored.withColumn(DIFFICULTY, A.difficulty_ratio(F.col(proba)))
    decoded = decode_prediction(ready, proba, keys, catalogue).drop(proba, "codigo_int")
    decoded = decoded.withColumnsRenamed({"aeciuo_2": "prediccion_modelo", "glosa": "glosa_prediccion"})
    decoded = stage_table(decoded, "wave")
    human, automatic = triage_split(decoded, DIFFICULTY, ident, p_auto)
    dealt = assign_reviewers(automatic, DIFFICULTY, ident, reviewers)
    return (
        make_worksheet(human, scratch=[DIFFICULTY]),
        make_worksheet(dealt, TECHNICAL_COLUMNS, scratch=[DIFFICULTY]),
    )


def code_wave(
    model: Classifier,
    wave: DataFrame,
    catalogue: DataFrame,
    ident: str,
    reviewers: Sequence[str],
    p_auto: float = 0.6,
    text_cols: Sequence[str] = ("oficio", "tareas"),
) -> tuple[DataFrame, DataFrame]:
    """Both sheets of a wave: scored, decoded, ordered by difficulty, split and dealt out.

    ``ident`` is a unique column of the wave, numeric or text.
    """
    scored = score_wave(model, wave, text_cols).select(*wave.columns, "proba")
    return sheets(scored, model.keys, catalogue, ident, reviewers, p_auto)


HUMAN_SHEET, TECHNICAL_SHEET = "codificacion", "revision_tecnica"


def publish_wave(
    model: Classifier,
    wave: DataFrame,
    catalogue: DataFrame,
    ident: str,
    reviewers: Sequence[str],
    root: str,
    version: str,
    **options,
) -> bool:
    """Code a wave and deliver both sheets as one version; a version is delivered once."""
    human, technical = code_wave(model, wave, catalogue, ident, reviewers, **options)
    return publish_tables({HUMAN_SHEET: human, TECHNICAL_SHEET: technical}, root, version)
