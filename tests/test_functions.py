import string
import unicodedata

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from codewave.functions import arrays as A
from codewave.functions import codes as C
from codewave.functions import nulls as N
from codewave.functions import text as X


def one(spark, value, expr, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(expr(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("", ""),
        ("de la el", ""),
        ("x/z", "xz"),
        ("¿Qué?  Vende PAN", "vende pan"),
        ("$5 más", "$5"),
        ("no vende", "no vende"),
        ("año  2020\t fin", "año 2020 fin"),
        ("de-la", ""),
        ("delantal de la casa", "delantal casa"),
        (" hola mundo\n", "hola mundo"),
        ("«cita»…", "cita"),
    ],
)
def test_normalize_text(spark, raw, clean):
    assert one(spark, raw, X.normalize_text) == clean


def test_normalize_flags(spark):
    assert one(spark, "La Casa 12, azul", lambda c: X.normalize_text(c, lower=False)) == "La Casa 12 azul"
    assert one(spark, "La Casa 12", lambda c: X.normalize_text(c, stopwords=False)) == "la casa 12"
    assert one(spark, "casa 12", lambda c: X.normalize_text(c, digits=True)) == "casa"
    assert one(spark, "a, b", lambda c: X.normalize_text(c, punct=False, stoplist=["b"])) == "a,"


def test_stoplist_is_the_public_list_without_no(spark):
    public = set(StopWordsRemover.loadDefaultStopWords("spanish"))
    assert set(X.default_stoplist()) == public - {"no"}
    assert len(X.default_stoplist()) == len(public) - 1


def test_fold_accents_maps_letter_by_letter(spark):
    assert len(X.ACCENTED) == len(X.UNACCENTED)
    assert one(spark, "Ñandú áéíóú çÜ", X.fold_accents) == "Nandu aeiou cU"


def test_special_codes_and_keywords(spark):
    assert one(spark, "66", X.blank_special_codes) == ""
    assert one(spark, "166", X.blank_special_codes) == "166"
    assert one(spark, None, X.blank_special_codes) is None
    include, exclude = r"\bpesca", r"\b(con|sin) redes\b|turist"
    for text, hit in [("pescador de altura", True), ("pesca con redes", False), ("repesca", False), ("pesca turistica", False)]:
        assert one(spark, text, lambda c: X.keyword_match(c, include, exclude)) is hit


def test_vocabulary_tokens(spark):
    assert one(spark, "Uno,dos  TRES_cuatro 'x'", X.vocabulary_tokens) == ["uno", "dos", "tres", "cuatro", "'x'"]
    assert one(spark, None, X.vocabulary_tokens) == []


@pytest.mark.parametrize(
    "seq, padded",
    [([], [0, 0, 0]), ([5, 6], [5, 6, 0]), ([5, 6, 7], [5, 6, 7]), ([4, 5, 6, 7], [5, 6, 7])],
)
def test_pad_sequence(spark, seq, padded):
    assert one(spark, seq, lambda c: A.pad_sequence(c, 3), "array<int>") == padded


def test_probabilities(spark):
    assert one(spark, [0.2, 0.4, 0.4], A.best_index, "array<double>") == 1
    assert one(spark, [0.2, 0.5, 0.25], A.difficulty_ratio, "array<double>") == 2.0
    assert one(spark, [1.0, 0.0, 0.0], A.difficulty_ratio, "array<double>") == float("inf")
    best = one(spark, [0.25, 0.25, 0.5], lambda c: A.best_k(c, 2), "array<double>")
    assert [(b["codigo_int"], b["proba"]) for b in best] == [(2, 0.5), (0, 0.25)]


def test_membership_is_never_null(spark):
    assert one(spark, None, lambda c: N.is_in(c, ["a"])) is False
    assert one(spark, None, lambda c: ~N.is_in(c, ["a"])) is True


def test_code_text_drops_decimals(spark):
    df = spark.createDataFrame([(3.0,), (None,), (52.0,)], "c double")
    assert [r[0] for r in df.select(N.code_text(df, "c")).collect()] == ["3", None, "52"]
    assert one(spark, "abc", N.as_number) is None
    assert one(spark, "3", N.padded_code) == "03"
    assert one(spark, "123", N.padded_code) == "123"


def test_mean_with_a_missing_value_is_missing(spark):
    df = spark.createDataFrame([(1,), (None,), (0,)], "c int")
    strict = df.agg(N.mean_or_null(F.col("c")), N.sum_or_null(F.col("c"))).first()
    loose = df.agg(N.mean_or_null(F.col("c"), True), N.sum_or_null(F.col("c"), True)).first()
    assert tuple(strict) == (None, None) and tuple(loose) == (0.5, 1)


def test_codes(spark):
    df = spark.createDataFrame(
        [("A", "0"), ("A", "7"), ("A", None)], "section string, auditor string"
    )
    got = [r[0] for r in df.select(C.audited_code(F.col("section"), F.col("auditor"))).collect()]
    assert got == ["A", "7", None]
    df = spark.createDataFrame(
        [("CONFORME", 10, "20"), ("NO CONFORME", 10, "20"), (None, 10, "20"), ("NO CONFORME", 10, "x")],
        "v string, a long, b string",
    )
    got = [r[0] for r in df.select(C.review_code(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert got == [10, 20, None, None]


def test_backfill_compares_padded_codes(spark):
    df = spark.createDataFrame(
        [(None, 3, "03"), (None, 4, "03"), (None, None, "03"), ("no", 3, "03")], "f string, c long, m string"
    )
    got = [r[0] for r in df.select(C.backfill_agreement(F.col("f"), F.col("c"), F.col("m"))).collect()]
    assert got == ["si", "no", None, "no"]


def test_tables_shared_with_the_check_sql_have_these_values():
    from codewave.functions import text
    from codewave.operators import quality

    assert dict(zip(text.ACCENTED, text.UNACCENTED))["ñ"] == "n"
    assert len(text.ACCENTED) == len(text.UNACCENTED) == 53  # 27 small, 26 capital letters
    for marked, plain in zip(text.ACCENTED, text.UNACCENTED):
        assert unicodedata.normalize("NFD", marked)[0] == plain
    assert set(text.TOKEN_SEPARATORS) == set(string.punctuation) - {"'"} | {"\t", "\n"}
    assert [round(100 * p) for p in quality.CUTS] == list(range(5, 65, 5))
    assert quality.BIN_LIMITS == (0.0, *quality.CUTS, 1.0)
    assert [float(x.replace(",", ".")) for x in quality.BIN_LABELS] == [*quality.CUTS, 1.0]
