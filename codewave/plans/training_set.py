"""The training set, from raw survey files to labelled, normalised rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.functions.codes import review_code
from codewave.operators.assemble import merge_origins, wave_window
from codewave.operators.reconcile import (
    drop_sentinels,
    min_support,
    patch_codes,
    reconcile_sources,
    recode_specials,
    repair_text,
)
from codewave.operators.score import prepare_wave
from codewave.operators.texts import blank_specials, combine_text, normalize_columns

CODE = "aeciuo_2"
TEXTS = ("oficio", "tareas")
MODES = ("viii", "piloto", "todo", "nuevos")


def earlier_survey(reviewed: DataFrame, complete: DataFrame, complete_file: bool = True) -> DataFrame:
    """The earlier survey with reviewed codes laid over the complete file."""
    verdict = review_code(F.col("conformidad"), F.col("ciuo_08cl"), F.col("codigo_nuevo"))
    reviewed = reviewed.select("folio", "n_linea", verdict.alias("ciuo_08cl_rev"))
    joined = reconcile_sources(
        reviewed, complete, ["folio", "n_linea"], "ciuo_08cl_rev", "ciuo_08cl", CODE, not complete_file
    )
    return normalize_columns(joined, TEXTS)


def pilot(
    control: DataFrame, raw: DataFrame, treatment: DataFrame, patches=(), raw_texts: Mapping[str, str] | None = None
) -> DataFrame:
    """Both arms of the pilot; the control arm's texts come from the raw file.

    A column that only one arm has is missing in the other.
    """
    raw_texts = raw_texts or {"oficio": "AE09A", "tareas": "AE09B"}
    repaired = repair_text(control, raw, ["folio", "nro_rph"], raw_texts)
    arms = repaired.unionByName(treatment, allowMissingColumns=True)
    rows = normalize_columns(drop_sentinels(arms, "oficio", CODE), TEXTS)
    return patch_codes(rows, CODE, patches) if patches else rows


def current_survey(coded: DataFrame, wave: int) -> DataFrame:
    """Coded rows of the waves before ``wave``."""
    rows = wave_window(coded, "submuestra", wave)
    return normalize_columns(drop_sentinels(rows, "oficio", CODE), TEXTS)


def _finish(df: DataFrame) -> DataFrame:
    """Frequent codes only, texts pasted, special codes blanked."""
    pasted = combine_text(min_support(df, CODE), "oficio_tarea", [f"{c}_proc" for c in TEXTS])
    return blank_specials(pasted, ["tareas_proc"])


def build_training_set(
    mode: str, sources: Mapping[str, object], wave: int, complete: bool = True
) -> DataFrame:
    """Rows ready for training (``viii``, ``piloto``, ``todo``) or scoring (``nuevos``).

    ``sources`` holds the frames a mode needs: reviewed, complete, control, raw,
    treatment, patches, coded, new.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode == "nuevos":
        return prepare_wave(sources["new"], TEXTS)
    parts = {}
    if mode in ("viii", "todo"):
        parts["viii"] = earlier_survey(sources["reviewed"], sources["complete"], complete)
    if mode in ("piloto", "todo"):
        parts["piloto"] = pilot(
            sources["control"], sources["raw"], sources["treatment"], sources.get("patches", ())
        )
    if mode != "todo":
        return _finish(parts[mode])
    parts["ix"] = current_survey(sources["coded"], wave)
    # One text form of a code ('3' and '03') before rows per code are counted.
    merged = recode_specials(merge_origins(parts, CODE), CODE)
    return _finish(merged)
