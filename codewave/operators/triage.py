"""Which answers people look at, and what comes back from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.functions.codes import (
    backfill_agreement,
    final_code_from_review,
    missing_to_special,
    recover_code,
)
from codewave.functions.nulls import as_number, is_in
from codewave.operators.assemble import floor_share, wave_number
from codewave.operators.joins import lookup, null_safe_join
from codewave.operators.rank import exact_rank, kth_smallest
from codewave.operators.reconcile import overlay_recode

# Columns of the sheet that human coders fill in.
HUMAN_COLUMNS = (
    "Codificacion_manual_Codificador_A",
    "Codificacion_manual_Codificador_B",
    "Revisión cruzada-> comparación de códigos asignados por Codificador A y B ",
    "Revisión de contraste",
    "CODIGO",
)
TECHNICAL_COLUMNS = ("predice_bien", "codigo_final")


def triage_split(
    df: DataFrame, difficulty: str, ident: str, p_auto: float = 0.6
) -> tuple[DataFrame, DataFrame]:
    """``(human, automatic)``: the hardest floor(n * (1 - p_auto)) rows go to people.

    A small ratio of the two best probabilities means hard. The last row of the human
    part is located first; both parts are then plain filters on the source.
    """
    cut = kth_smallest(df, difficulty, ident, lambda n: floor_share(n, 1 - p_auto))
    if cut is None:
        return df.limit(0), df
    human = cut.covers(F.col(difficulty), F.col(ident))
    return df.filter(human), df.filter(~human)


def remaining_rows(df: DataFrame, taken: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` that are not in ``taken``, by ``keys`` or by all shared columns."""
    on = list(keys) if keys else [c for c in df.columns if c in taken.columns]
    return null_safe_join(df, taken.select(*on).distinct(), on, "left_anti")


def assign_reviewers(
    df: DataFrame,
    difficulty: str,
    ident: str,
    reviewers: Sequence[str],
    out: str = "persona_codifica",
) -> DataFrame:
    """Deal rows out in difficulty order; row r goes to reviewer r modulo their number."""
    ranked = exact_rank(df, difficulty, ident, out="_rank")
    names = F.array(*[F.lit(name) for name in reviewers])
    turn = F.pmod(F.col("_rank"), F.lit(len(reviewers))).cast("int")
    return ranked.withColumn(out, F.get(names, turn)).drop("_rank")


def make_worksheet(
    df: DataFrame, blanks: Sequence[str] = HUMAN_COLUMNS, scratch: Sequence[str] = ()
) -> DataFrame:
    """Add empty columns to fill in and drop working columns."""
    return df.drop(*scratch).withColumns({name: F.lit("") for name in blanks})


def human_reviews(
    df: DataFrame, code: str = "codigo", flag: str = "predice", tag: str = "codificación"
) -> DataFrame:
    """The coders' file in common form: code as a number, agreement flag, origin."""
    typed = df.withColumns({code: recover_code(F.col(code)), "origen": F.lit(tag)})
    return typed.withColumnsRenamed({code: "CODIGO", flag: "PREDICE"})


def technical_reviews(
    df: DataFrame,
    flag: str = "predice_bien",
    model_code: str = "prediccion_modelo",
    final_code: str = "codigo_final",
    scratch: Sequence[str] = ("persona_codifica",),
    tag: str = "técnica",
) -> DataFrame:
    """The technical file in common form; the accepted model code or the correction."""
    code = final_code_from_review(F.col(flag), F.col(model_code), F.col(final_code).cast("string"))
    return df.withColumns({"CODIGO": code, "origen": F.lit(tag)}).drop(flag, final_code, *scratch)


def integrate_reviews(
    human: DataFrame,
    technical: DataFrame,
    recodes: DataFrame | None = None,
    keys: Sequence[str] = ("interview_id", "interview_key", "submuestra", "nro_rph"),
    model_code: str = "prediccion_modelo",
    wave: str = "submuestra",
    last_recoded_wave: int = 8,
) -> DataFrame:
    """Both review files as one table: no missing code, every agreement that can be told."""
    both = human_reviews(human).unionByName(technical_reviews(technical), allowMissingColumns=True)
    both = both.withColumn("CODIGO", missing_to_special(F.col("CODIGO")))
    both = both.withColumn("PREDICE", backfill_agreement(F.col("PREDICE"), F.col("CODIGO"), F.col(model_code)))
    both = both.withColumn("CODIGO", F.col("CODIGO").cast("string"))
    if recodes is None:
        return both
    return overlay_recode(both, recodes, keys, "CODIGO", when=F.col(wave) <= last_recoded_wave)


def exclude_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not on a list."""
    return lookup(df, listed.select(*keys).distinct(), keys, "left_anti")


def attach_predictions(
    predictions: DataFrame,
    human: DataFrame,
    keys: Sequence[str],
    predicted: str = "pred_nueva",
    code: str = "codigo_cod",
    flag: str = "predice",
    wave: str = "submuestra",
    excluded_waves: Sequence[int] = (11, 12),
    nullable_keys: bool = True,
) -> DataFrame:
    """Earlier predictions with the human code, the hit flag and the agreement flag.

    The hit flag compares the codes as text, before they become numbers.
    """
    joined = null_safe_join(predictions, human.drop(wave), keys, "left", nullable_keys)
    joined = joined.withColumn("predice2", (F.col(predicted) == F.col(code)).cast("int"))
    joined = joined.withColumns(
        {
            flag: F.lower(F.col(flag)),
            wave: wave_number(joined, wave),
            code: as_number(F.col(code).cast("string")),
        }
    )
    return joined.filter(
        ~is_in(F.col(wave), excluded_waves) & F.col(code).isNotNull() & (F.col(code) >= 0)
    )
