"""Survey-shaped views over the supplied tables, as DataFrame code.

``views_sql`` has the same views as DuckDB SQL. Every row of the source table is kept;
modulo rules only plant sentinels, nulls and disagreements among the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewave.functions import arrays as A
from codewave.functions.codes import review_code
from codewave.operators.assemble import stratified_split
from codewave.operators.texts import combine_text, normalize_columns
from codewave.session import spread_small, stage_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def two_digits(col: Column) -> Column:
    return F.lpad(col.cast("string"), 2, "0")


def f_resp(spark: SparkSession, sf: str) -> DataFrame:
    """Survey answers: the first words of a document as occupation, the rest as tasks.

    Where a mark or a null takes the place of one field, the other has all words.
    """
    doc = spread_small(table(spark, sf, "documents"), "doc_id")
    i, n = F.col("doc_id"), F.substring("source", 4, 10).cast("int")
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")
    no_oficio = (i % 89 == 3) | (i % 97 == 5)
    no_tareas = (i % 50 == 7) & ~no_oficio
    many = F.lit(1_000_000_000)
    return doc.select(
        i.alias("id"),
        "text",
        n.alias("n"),
        F.when(n < 3, n + 80).otherwise(n - 2).alias("submuestra"),
        F.when(i % 89 == 3, F.lit("-99"))
        .when(i % 97 != 5, F.array_join(F.slice(words, 1, F.when(no_tareas, many).otherwise(6)), " "))
        .alias("oficio"),
        F.when(no_tareas, F.lit("-88"))
        .otherwise(F.array_join(F.slice(words, F.when(no_oficio, 1).otherwise(7), many), " "))
        .alias("tareas"),
        F.when(i % 61 != 9, F.col("lang")).alias("aeciuo_2"),
        F.element_at(F.array(F.lit("viii"), F.lit("piloto"), F.lit("ix")), n % 3 + 1).alias("origen"),
    )


def f_text(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with normalised texts, pasted together as well."""
    df = normalize_columns(f_resp(spark, sf), ["oficio", "tareas"])
    return combine_text(df, "oficio_tarea", ["oficio_proc", "tareas_proc"])


def f_split(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Normalised answers with their split, written once for the passes of a fit; ``cols`` are
    those that it needs."""
    split = stratified_split(f_text(spark, sf), "aeciuo_2", "id")
    cols = cols or ("id", "aeciuo_2", "oficio_proc", "tareas_proc", "oficio_tarea", "split")
    return stage_table(split.select(*cols), "split")


def f_audit(spark: SparkSession, sf: str) -> DataFrame:
    doc, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return doc.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("seccion"),
        F.when(F.col("quality") == 1, F.lit("0"))
        .when(F.col("quality") == 0, F.concat(F.lit("Q"), F.col("toxic").cast("string")))
        .alias("codigo_nomenclaturas"),
    )


def f_person(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("folio"),
        F.col("turn").alias("orden"),
        F.col("role").alias("AE09A"),
        F.col("text").alias("AE09B"),
    )


def f_review_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of an order under a number of its own, with both codes and a verdict."""
    line = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    verdict = F.when(F.col("l_returnflag") == "A", F.lit("CONFORME")).when(
        F.col("l_returnflag") == "R", F.lit("NO CONFORME")
    )
    return line.select(
        F.col("l_orderkey").alias("folio"),
        F.row_number().over(order).cast("bigint").alias("n_linea"),
        verdict.alias("conformidad"),
        (F.col("l_suppkey") % 40 + 90).alias("ciuo_08cl"),
        (F.col("l_partkey") % 40 + 90).alias("codigo_nuevo"),
    )


def f_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """The reviewed side: all lines, some under numbers that only this side has."""
    rev = review_code(F.col("conformidad"), F.col("ciuo_08cl"), F.col("codigo_nuevo"))
    own = F.when(F.col("n_linea") % 3 == 1, F.col("n_linea") + 1000).otherwise(F.col("n_linea"))
    return f_review_all(spark, sf).select("folio", own.alias("n_linea"), rev.alias("ciuo_08cl_rev"))


def f_complete(spark: SparkSession, sf: str) -> DataFrame:
    """The complete side: all lines, some under numbers that only this side has."""
    own = F.when(F.col("n_linea") % 3 == 2, F.col("n_linea") + 2000).otherwise(F.col("n_linea"))
    return f_review_all(spark, sf).select("folio", own.alias("n_linea"), "ciuo_08cl")


def f_codings(spark: SparkSession, sf: str) -> DataFrame:
    """Model predictions and human codes of seven waves."""
    order = table(spark, sf, "orders")
    k, c, y = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    pred = two_digits(k % 12 + 1)
    human = F.when(k % 211 != 0, F.when(c % 10 < 7, pred).otherwise(two_digits(c % 12 + 1)))
    return order.select(
        k.alias("interview_id"),
        c.cast("string").alias("interview_key"),
        (c % 5 + 1).cast("int").alias("nro_rph"),
        F.when(y <= 1997, y - 1915).otherwise(y - 1997).alias("submuestra"),
        pred.alias("pred"),
        human.alias("human"),
        F.when(k % 101 == 0, F.lit("66"))
        .when(human == pred, F.when(k % 17 == 0, F.lit("1")).otherwise(F.lit("si")))
        .when(human != pred, F.lit("no"))
        .alias("predice"),
        F.col("o_totalprice").alias("dificultad"),
        F.col("o_orderpriority").alias("oficio"),
        F.col("o_orderstatus").alias("arm"),
    )


def f_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Codings that have a human code, with the hit flag."""
    df = f_codings(spark, sf).filter(F.col("human").isNotNull())
    return df.withColumn("predice2", (F.col("pred") == F.col("human")).cast("int"))


IDS = ["interview_id", "interview_key", "submuestra", "nro_rph"]


HARD = 200_000.0


def f_human_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every coding as the human coders' file would have it."""
    df, k = f_codings(spark, sf), F.col("interview_id")
    entry = F.when(k % 41 != 0, F.when(k % 37 == 0, F.lit("Recuperar")).otherwise(F.col("human")))
    return df.select(
        *IDS, F.col("pred").alias("prediccion_modelo"), entry.alias("codigo"), "predice", "dificultad"
    )


def f_technical_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every coding as the technical file would have it."""
    return f_codings(spark, sf).select(
        *IDS,
        F.col("pred").alias("prediccion_modelo"),
        (F.col("pred") == F.col("human")).cast("int").alias("predice_bien"),
        F.col("human").cast("int").alias("codigo_final"),
        F.lit("A").alias("persona_codifica"),
        "dificultad",
    )


def f_human_file(spark: SparkSession, sf: str) -> DataFrame:
    """The hard codings, which people looked at; the technical file has all others."""
    return f_human_rows(spark, sf).filter(F.col("dificultad") < HARD).drop("dificultad")


def f_technical_file(spark: SparkSession, sf: str) -> DataFrame:
    return f_technical_rows(spark, sf).filter(F.col("dificultad") >= HARD).drop("dificultad")


def f_recodes(spark: SparkSession, sf: str) -> DataFrame:
    """Late recodes of two codes."""
    df = f_codings(spark, sf).filter(F.col("pred").isin("03", "09"))
    return df.select(*IDS, F.when(F.col("nro_rph") != 2, F.lit("77")).alias("codigo_final"))


def f_catalogue_file(spark: SparkSession, sf: str) -> DataFrame:
    """A nomenclature file: fourteen two-digit rows among many deeper ones."""
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    top = k.between(1, 14)
    return part.select(
        two_digits(F.pmod(k - 1, F.lit(14)) + 1).alias("codigo_2"),
        F.when(~top, F.col("p_brand")).alias("subgrupo"),
        F.when(~top & (k % 2 == 0), F.col("p_type")).alias("grupo"),
        F.col("p_name").alias("nombre"),
    )


def f_codes(spark: SparkSession, sf: str) -> DataFrame:
    df = f_catalogue_file(spark, sf).filter(F.col("subgrupo").isNull() & F.col("grupo").isNull())
    return df.select(F.col("codigo_2").alias("aeciuo_2"), F.col("nombre").alias("glosa"))


def f_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Label index 0..13 of the catalogue's codes."""
    codes = f_codes(spark, sf).withColumn("codigo_int", F.col("aeciuo_2").cast("int") - 1)
    return codes.select("codigo_int", "aeciuo_2")


CLASSES, DIMENSIONS = 10, 64


def f_proba(spark: SparkSession, sf: str) -> DataFrame:
    """Soft-max over ten classes, each the sum of every tenth dimension."""
    emb = table(spark, sf, "embeddings")
    sums = [
        reduce(add, [F.col("embedding")[d].cast("double") for d in range(c, DIMENSIONS, CLASSES)])
        for c in range(CLASSES)
    ]
    exps = F.array(*[F.exp(x) for x in sums])
    df = emb.select("vec_id", F.col("label").alias("y_test"), exps.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    df = df.withColumn("total", total)
    return df.select("vec_id", "y_test", F.transform("e", lambda v: F.round(v / F.col("total"), 6)).alias("proba"))


def f_predictions(spark: SparkSession, sf: str) -> DataFrame:
    df = f_proba(spark, sf).withColumns(
        {
            "codigo_int": A.best_index(F.col("proba")),
            "pbb_caso": A.top_probability(F.col("proba")),
            "dificultad": A.difficulty_ratio(F.col("proba")),
        }
    )
    return df.withColumn("predice", (F.col("codigo_int") == F.col("y_test")).cast("int"))
