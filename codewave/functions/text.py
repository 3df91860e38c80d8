"""Text normalisation as Catalyst expressions; no UDF is involved."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from codewave.functions.nulls import is_in

# Marks for an answer that was not given, and the same without the sign.
SENTINEL_TEXTS = ("-66", "-77", "-88", "-99", "")
SPECIAL_CODES = ("66", "77", "88", "99")

# Symbols that separate tokens when a vocabulary is fitted.
TOKEN_SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# Accented letters and their plain forms.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüñçýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

# A text is the concatenation of its runs of word characters and of other characters.
RUNS = r"(?U)\w+|\W+"


# Spanish function words of the public Snowball list, without 'no', which
# carries meaning in an answer.
FUNCTION_WORDS = """
de la que el en y a los del se las por un para con una su al lo como más pero sus le ya o este
sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante
todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras
otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo
nosotros mi mis tú te ti tu tus ellas nosotras vosostros vosostras os mío mía míos mías tuyo tuya
tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros
vuestras esos esas
"""
# Forms of estar, haber, ser, sentir and tener that follow no common ending.
VERB_FORMS = """
estoy estás está estamos estáis están esté estés estemos estéis estén estaba estabas estábamos
estabais estaban estando estado estada estados estadas estad he has ha hemos habéis han haya
hayas hayamos hayáis hayan había habías habíamos habíais habían habiendo habido habida habidos
habidas soy eres es somos sois son sea seas seamos seáis sean era eras éramos erais eran fui
fuiste fue fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran fuese fueses fuésemos
fueseis fuesen sintiendo sentido sentida sentidos sentidas siente sentid tengo tienes tiene
tenemos tenéis tienen tenga tengas tengamos tengáis tengan tenía tenías teníamos teníais tenían
teniendo tenido tenida tenidos tenidas tened
"""
# Stems and endings of the forms that follow a rule.
FUTURE = ("estar habr ser tendr", "é ás á emos éis án ía ías íamos íais ían")
PAST = (
    "estuv hub tuv",
    "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen",
)


@lru_cache(maxsize=1)
def default_stoplist() -> tuple[str, ...]:
    """The Spanish stop words that are removed by default; any other list can be given."""
    ruled = [
        stem + ending
        for stems, endings in (FUTURE, PAST)
        for stem in stems.split()
        for ending in endings.split()
    ]
    return (*FUNCTION_WORDS.split(), *VERB_FORMS.split(), *ruled)


@lru_cache(maxsize=8)
def _literals(words: tuple[str, ...], application: str) -> tuple[Column, ...]:
    """Literal columns of a word list, made once per application: a list has hundreds."""
    return tuple(F.lit(word) for word in words)


def remove_stopwords(col: Column, stoplist: Sequence[str] | None = None) -> Column:
    """Delete whole words of ``stoplist``; everything between words stays as it is."""
    stoplist = default_stoplist() if stoplist is None else tuple(stoplist)
    if not stoplist:
        return col
    application = SparkContext.getOrCreate().applicationId
    words = _literals(stoplist, application)
    runs = F.regexp_extract_all(col, F.lit(RUNS), F.lit(0))
    return F.array_join(F.filter(runs, lambda run: ~run.isin(*words)), "")


def squish(col: Column) -> Column:
    """Collapse every run of white space to one blank and trim both ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalize_text(
    col: Column,
    lower: bool = True,
    stopwords: bool = True,
    punct: bool = True,
    digits: bool = False,
    stoplist: Sequence[str] | None = None,
) -> Column:
    """Lower-case, drop stop words, punctuation and (on request) digits, squish."""
    out = F.lower(col) if lower else col
    if stopwords:
        out = remove_stopwords(out, stoplist)
    if punct:
        out = F.regexp_replace(out, r"\p{P}", "")
    if digits:
        out = F.regexp_replace(out, r"\d+", "")
    return F.coalesce(squish(out), F.lit(""))


def fold_accents(col: Column) -> Column:
    return F.translate(col, ACCENTED, UNACCENTED)


def blank_special_codes(col: Column) -> Column:
    return F.when(is_in(col, SPECIAL_CODES), F.lit("")).otherwise(col)


def keyword_match(col: Column, include: str, exclude: str | None = None) -> Column:
    """True where ``include`` matches and ``exclude`` does not."""
    hit = col.rlike(include)
    return hit if exclude is None else hit & ~col.rlike(exclude)


def blank_separated(col: Column) -> Column:
    """Words of a normalised text: split at blanks, empties dropped."""
    return F.filter(F.split(col, " "), lambda word: word != "")


def vocabulary_tokens(col: Column) -> Column:
    """Tokens as the vocabulary sees them: separators become blanks, lower case."""
    blanks = " " * len(TOKEN_SEPARATORS)
    return blank_separated(F.lower(F.translate(F.coalesce(col, F.lit("")), TOKEN_SEPARATORS, blanks)))
