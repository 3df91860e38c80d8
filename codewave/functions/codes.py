"""Which code stands when several coders disagree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewave.functions.nulls import as_number, padded_code

# Code texts and numbers with a special meaning.
RECOVER_MARK, RECOVER_CODE = "Recuperar", -66
MISSING_CODE = -77
AGREES, DISAGREES = "si", "no"


def audited_code(section: Column, auditor: Column) -> Column:
    """The auditor's code, or the section's where the auditor wrote 0; null stays null."""
    return F.when(auditor == "0", section).otherwise(auditor)


def review_code(verdict: Column, code: Column, new_code: Column) -> Column:
    """The code that stands after a review; null where there was no verdict."""
    return F.when(verdict == "CONFORME", code.cast("bigint")).when(
        verdict == "NO CONFORME", as_number(new_code.cast("string"))
    )


def final_code_from_review(flag: Column, model_code: Column, reviewer_code: Column) -> Column:
    """The model's code where the reviewer accepted it, else the reviewer's own."""
    chosen = F.when(flag.isNotNull(), F.when(flag == 1, model_code).otherwise(reviewer_code))
    return as_number(chosen.cast("string"))


def recover_code(code: Column) -> Column:
    """A human coder's entry as a number; the recovery mark is -66."""
    return F.when(code == RECOVER_MARK, F.lit(RECOVER_CODE).cast("bigint")).otherwise(as_number(code))


def missing_to_special(code: Column) -> Column:
    return F.coalesce(code, F.lit(MISSING_CODE).cast("bigint"))


def pad_single_digit(code: Column) -> Column:
    """The one code that lost its leading zero ('3' -> '03')."""
    return F.when(code == "3", F.lit("03")).otherwise(code)


def backfill_agreement(flag: Column, code: Column, model_code: Column) -> Column:
    """Keep a given flag; otherwise derive it from the two codes where both exist."""
    same = padded_code(code.cast("string")) == padded_code(model_code.cast("string"))
    return F.coalesce(flag, F.when(same, F.lit(AGREES)).when(~same, F.lit(DISAGREES)))


def agreement_text(flag: Column) -> Column:
    """Flags as typed by hand in one form: 'SI' and ' Si. ' are 'si', and so is 1; accents stay."""
    typed = F.regexp_replace(F.lower(flag.cast("string")), r"[\p{P}\s]+", "")
    return F.when(typed == "1", F.lit(AGREES)).otherwise(typed)
