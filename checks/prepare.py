"""Sources, text preparation, reconciliation and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views as V
from checks import views_sql as S
from checks.registry import query
from codewave.functions import codes as C
from codewave.functions import text as X
from codewave.operators import assemble, reconcile, texts
from codewave.plans.training_set import build_training_set
from codewave.session import scratch_path
from codewave.sources import readers, writers

# --- sources and sinks ------------------------------------------------------------

WAVE_SCHEMA = T.StructType(
    [
        T.StructField("submuestra", T.StringType()),
        T.StructField("oficio", T.StringType()),
        T.StructField("aeciuo_2", T.StringType()),
        T.StructField("folio", T.LongType()),
        T.StructField("nro_rph", T.IntegerType()),
    ]
)


@query(
    "load_union",
    """SELECT CAST(submuestra AS VARCHAR) AS submuestra, oficio, human AS aeciuo_2,
         interview_id AS folio, nro_rph FROM f_codings""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).withColumnsRenamed({"interview_id": "folio"})
    first = df.filter(F.col("submuestra") == 80).select("oficio", F.col("human").alias("codigo_cod"), "folio", "nro_rph")
    rest = df.filter(F.col("submuestra") != 80).select(
        "submuestra", "oficio", F.col("human").alias("codigo"), "folio", "nro_rph"
    )
    return readers.load_union(
        [first, rest], WAVE_SCHEMA, {"aeciuo_2": "codigo(_cod)?"}, {"submuestra": "80"}
    )


@query(
    "load_person_waves",
    """SELECT "AE09A" AS ae09a, "AE09B" AS ae09b, folio,
         row_number() OVER (PARTITION BY folio ORDER BY orden) AS nro_rph FROM f_person""",
)
def _(spark, sf):
    df = V.f_person(spark, sf)
    turn = F.col("orden")
    waves = [df.filter(turn == 0), df.filter(turn == 1), df.filter(turn >= 2)]
    numbered = readers.load_person_waves(waves, ["AE09A", "AE09B"], "folio", "orden")
    return numbered.select(F.col("AE09A").alias("ae09a"), F.col("AE09B").alias("ae09b"), "folio", "nro_rph")


def _person_files(spark, sf) -> list[str]:
    """Persons in three folders of several files, the last ones of a household first."""
    paths = []
    for i in range(3):
        path = scratch_path(spark, "persons")
        part = V.f_person(spark, sf).filter(F.col("folio") % 3 == i)
        placed = part.repartitionByRange(4, F.desc("orden"), "folio").sortWithinPartitions(F.desc("orden"), "folio")
        placed.write.parquet(path)
        paths.append(path)
    return paths


@query(
    "load_person_files",
    """SELECT "AE09A" AS ae09a, "AE09B" AS ae09b, folio,
         row_number() OVER (PARTITION BY folio ORDER BY orden DESC) AS nro_rph FROM f_person""",
)
def _(spark, sf):
    numbered = readers.load_person_files(spark, _person_files(spark, sf), ["AE09A", "AE09B"], "folio")
    return numbered.select(F.col("AE09A").alias("ae09a"), F.col("AE09B").alias("ae09b"), "folio", "nro_rph")


@query(
    "file_row_id",
    "SELECT folio, orden, row_number() OVER (ORDER BY folio % 3, orden DESC, folio) AS id_fila FROM f_person",
)
def _(spark, sf):
    rows = readers.read_in_order(spark, _person_files(spark, sf))
    return assemble.file_row_id(rows).select("folio", "orden", "id_fila")


@query(
    "load_union_checked",
    """SELECT CASE WHEN codigo = 'Recuperar' THEN codigo END AS valor, count(*) AS n FROM f_human_rows GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "human")
    V.f_human_rows(spark, sf).write.parquet(path)
    schema = T.StructType([T.StructField("interview_id", T.LongType()), T.StructField("codigo", T.IntegerType())])
    loaded = readers.load_union_checked([path], schema, spark=spark)
    kept = loaded.rows.select(F.lit(None).cast("string").alias("valor"))
    return kept.union(loaded.rejected.select("value")).groupBy("valor").agg(F.count(F.lit(1)).alias("n"))


@query("load_tagged_arms", "SELECT interview_id, submuestra, human, arm AS tipo FROM f_codings")
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", "submuestra", "human", "arm")
    per_arm = {
        arm: [
            df.filter((F.col("arm") == arm) & (F.col("submuestra") >= 80)).drop("arm"),
            df.filter((F.col("arm") == arm) & (F.col("submuestra") < 80)).drop("arm"),
        ]
        for arm in ("F", "O", "P")
    }
    arms = readers.load_tagged_arms(per_arm)
    return arms["F"].unionByName(arms["O"]).unionByName(arms["P"])


@query(
    "load_catalogue",
    "SELECT codigo_2 AS aeciuo_2, nombre AS glosa FROM f_catalogue_file WHERE codigo_2 IS NOT NULL AND subgrupo IS NULL AND grupo IS NULL",
)
def _(spark, sf):
    return readers.load_catalogue(V.f_catalogue_file(spark, sf), "codigo_2", ["subgrupo", "grupo"], "nombre")


@query(
    "clean_column_names",
    """SELECT interview_id, interview_key AS codigo_nuevo, dificultad AS percent_dificultad,
         pred AS prediccion_modelo, human AS prediccion_modelo_2, submuestra AS x2_submuestra FROM f_codings""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", "interview_key", "dificultad", "pred", "human", "submuestra")
    return readers.clean_column_names(
        df.toDF("InterviewId", "Código  Nuevo", "% Dificultad", "Predicción.modelo", "prediccion_modelo", "2 submuestra")
    )


@query("rename_by_pattern", "SELECT interview_id, human AS codigo_final, dificultad FROM f_codings")
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", F.col("human").alias("codigo_revisado"), "dificultad")
    return readers.rename_by_pattern(df, "^codigo", "codigo_final")


@query("drop_all_null_columns", "SELECT interview_id, human, dificultad FROM f_codings")
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", "human", "dificultad")
    return readers.drop_all_null_columns(df.withColumns({"vacia": F.lit(None).cast("string")}))


@query(
    "select_reorder",
    "SELECT interview_id, oficio, predice, prediccion_modelo FROM (SELECT *, pred AS prediccion_modelo FROM f_codings)",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", F.col("pred").alias("prediccion_modelo"), "dificultad", "oficio", "predice")
    return readers.select_reorder(df, ["oficio", "predice"], before="prediccion_modelo", drop=["dificultad"])


@query("write_semicolon_csv", "SELECT vec_id, y_test, codigo_int, pbb_caso, round(dificultad, 6) AS dificultad FROM f_predictions")
def _(spark, sf):
    df = V.f_predictions(spark, sf).select(
        "vec_id", "y_test", "codigo_int", "pbb_caso", F.round("dificultad", 6).alias("dificultad")
    )
    path = scratch_path(spark, "csv")
    writers.write_semicolon_csv(df, path)
    return readers.read_semicolon_csv(spark, path, df.schema)


@query("write_table", "SELECT interview_id, submuestra, pred, human, dificultad FROM f_codings")
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", "submuestra", "pred", "human", "dificultad")
    path = scratch_path(spark, "waves")
    writers.write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


# --- text -------------------------------------------------------------------------


@query("normalize_text", f"SELECT id, {S.normalize('text')} AS texto, {S.normalize('text', digits=True)} AS sin_digitos FROM f_resp")
def _(spark, sf):
    text = F.col("text")
    return V.f_resp(spark, sf).select(
        "id",
        X.normalize_text(text).alias("texto"),
        X.normalize_text(text, digits=True).alias("sin_digitos"),
    )


@query("normalize_columns", f"SELECT id, oficio, tareas, {S.normalize('oficio')} AS oficio_proc, {S.normalize('tareas')} AS tareas_proc FROM f_resp")
def _(spark, sf):
    return texts.normalize_columns(V.f_resp(spark, sf).select("id", "oficio", "tareas"), ["oficio", "tareas"])


@query("fold_accents", f"SELECT id, {S.fold_accents('text')} AS texto FROM f_resp")
def _(spark, sf):
    return V.f_resp(spark, sf).select("id", X.fold_accents(F.col("text")).alias("texto"))


CUSTOM_STOPS = ["the", "la", "der", "und", "les", "no"]


@query("remove_stopwords", f"SELECT id, {S.remove_stopwords('text', CUSTOM_STOPS)} AS texto FROM f_resp")
def _(spark, sf):
    return V.f_resp(spark, sf).select("id", X.remove_stopwords(F.col("text"), CUSTOM_STOPS).alias("texto"))


@query("combine_text", "SELECT id, oficio_proc, tareas_proc, oficio_proc || ' ' || tareas_proc AS oficio_tarea FROM f_text")
def _(spark, sf):
    df = texts.normalize_columns(V.f_resp(spark, sf), ["oficio", "tareas"])
    return texts.combine_text(df, "oficio_tarea", ["oficio_proc", "tareas_proc"]).select(
        "id", "oficio_proc", "tareas_proc", "oficio_tarea"
    )


@query(
    "blank_special_codes",
    """SELECT id, oficio_tarea, CASE WHEN tareas_proc IN ('66', '77', '88', '99') THEN '' ELSE tareas_proc END AS tareas_proc
       FROM f_text""",
)
def _(spark, sf):
    return texts.blank_specials(V.f_text(spark, sf), ["tareas_proc"]).select("id", "oficio_tarea", "tareas_proc")


@query(
    "drop_sentinels",
    """SELECT id, oficio, aeciuo_2 FROM f_resp
       WHERE (oficio IS NULL OR oficio NOT IN ('-66', '-77', '-88', '-99', '')) AND (aeciuo_2 IS NULL OR aeciuo_2 <> '999')""",
)
def _(spark, sf):
    return reconcile.drop_sentinels(V.f_resp(spark, sf).select("id", "oficio", "aeciuo_2"), "oficio", "aeciuo_2")


@query(
    "keyword_select",
    r"""SELECT id, lang FROM (SELECT doc_id AS id, text, lang FROM documents)
       WHERE regexp_matches(text, '(in|de|on)g') AND NOT regexp_matches(text, '(nder?)|(tion)')""",
)
def _(spark, sf):
    df = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return texts.keyword_select(df, "text", "(in|de|on)g", "(nder?)|(tion)").drop("text")


def _words(expr: str) -> str:
    return f"CAST(len([w for w in string_split({expr}, ' ') if w <> '']) AS INTEGER)"


@query("token_lengths", f"SELECT id, {_words('oficio_proc')} AS oficio_proc_len, {_words('tareas_proc')} AS tareas_proc_len FROM f_text")
def _(spark, sf):
    df = V.f_text(spark, sf).select("id", "oficio_proc", "tareas_proc")
    return texts.token_lengths(df, ["oficio_proc", "tareas_proc"]).drop("oficio_proc", "tareas_proc")


@query("max_token_length", f"SELECT max({_words('oficio_proc')}) AS oficio_proc, max({_words('tareas_proc')}) AS tareas_proc FROM f_text")
def _(spark, sf):
    return texts.max_token_length(V.f_text(spark, sf), ["oficio_proc", "tareas_proc"])


@query(
    "frequent_texts",
    """SELECT origen, oficio_proc, n, rank FROM (
         SELECT origen, oficio_proc, count(*) AS n,
           CAST(row_number() OVER (PARTITION BY origen ORDER BY count(*) DESC, oficio_proc) AS INTEGER) AS rank
         FROM f_text GROUP BY origen, oficio_proc) WHERE rank <= 10""",
)
def _(spark, sf):
    return texts.frequent_texts(V.f_text(spark, sf), "origen", "oficio_proc", 10)


# --- reconciliation ---------------------------------------------------------------


@query(
    "audited_code",
    """SELECT id, CASE WHEN codigo_nomenclaturas IS NULL THEN NULL WHEN codigo_nomenclaturas = '0' THEN seccion
         ELSE codigo_nomenclaturas END AS codigo_final FROM f_audit""",
)
def _(spark, sf):
    final = C.audited_code(F.col("seccion"), F.col("codigo_nomenclaturas"))
    return V.f_audit(spark, sf).select("id", final.alias("codigo_final"))


@query(
    "review_code",
    """SELECT folio, n_linea, CASE conformidad WHEN 'CONFORME' THEN ciuo_08cl WHEN 'NO CONFORME' THEN codigo_nuevo END AS ciuo_08cl_rev
       FROM f_review_all""",
)
def _(spark, sf):
    verdict = C.review_code(F.col("conformidad"), F.col("ciuo_08cl"), F.col("codigo_nuevo"))
    return V.f_review_all(spark, sf).select("folio", "n_linea", verdict.alias("ciuo_08cl_rev"))


@query(
    "reconcile_sources",
    """SELECT folio, n_linea, aeciuo_2, ciuo_08cl_rev, ciuo_08cl FROM (
         SELECT coalesce(a.folio, b.folio) AS folio, coalesce(a.n_linea, b.n_linea) AS n_linea,
           coalesce(ciuo_08cl_rev, ciuo_08cl) AS aeciuo_2, ciuo_08cl_rev, ciuo_08cl
         FROM f_reviewed a FULL JOIN f_complete b ON a.folio = b.folio AND a.n_linea = b.n_linea)
       WHERE aeciuo_2 IS NULL OR aeciuo_2 NOT IN (101, 102)""",
)
def _(spark, sf):
    a, b = V.f_reviewed(spark, sf), V.f_complete(spark, sf)
    return reconcile.reconcile_sources(
        a, b, ["folio", "n_linea"], "ciuo_08cl_rev", "ciuo_08cl", nullable_keys=False
    )


@query(
    "subset_audit",
    """SELECT presence, count(*) AS n FROM (
         SELECT CASE WHEN b.folio IS NULL THEN 'only_a' WHEN a.folio IS NULL THEN 'only_b' ELSE 'both' END AS presence
         FROM f_reviewed a FULL JOIN f_complete b ON a.folio = b.folio AND a.n_linea = b.n_linea) GROUP BY presence""",
)
def _(spark, sf):
    return reconcile.subset_audit(V.f_reviewed(spark, sf), V.f_complete(spark, sf), ["folio", "n_linea"])


@query("repair_text", 'SELECT folio, orden, "AE09A" AS rol, "AE09B" AS tareas FROM f_person')
def _(spark, sf):
    good = V.f_person(spark, sf)
    damaged = good.select("folio", "orden", F.col("AE09A").alias("rol"), F.translate("AE09B", "éè", "??").alias("tareas"))
    return reconcile.repair_text(damaged, good, ["folio", "orden"], {"tareas": "AE09B"})


@query(
    "patch_codes",
    """SELECT interview_id, submuestra,
           CASE WHEN interview_id % 97 = 5 THEN lpad((interview_id % 9 + 1)::VARCHAR, 2, '0')
           WHEN human = '05' AND nro_rph = 1 AND submuestra = 80 THEN '03' ELSE human END AS human FROM f_codings""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", "submuestra", "nro_rph", "human")
    digit = (F.col("interview_id") % 9 + 1).cast("string")
    by_id = df.filter("interview_id % 97 = 5").select("interview_id", F.lpad(digit, 2, "0").alias("codigo_nuevo")).distinct()
    by_key = spark.createDataFrame(
        [("05", 1, 80, "03")], "human string, nro_rph int, submuestra int, codigo_nuevo string"
    )
    patches = [(by_id, ["interview_id"]), (by_key, ["human", "nro_rph", "submuestra"])]
    return reconcile.patch_codes(df, "human", patches).drop("nro_rph")


@query(
    "final_code_from_review",
    """SELECT interview_id, CASE WHEN predice_bien IS NULL THEN NULL WHEN predice_bien = 1 THEN CAST(prediccion_modelo AS BIGINT)
         ELSE CAST(codigo_final AS BIGINT) END AS codigo FROM f_technical_rows""",
)
def _(spark, sf):
    code = C.final_code_from_review(F.col("predice_bien"), F.col("prediccion_modelo"), F.col("codigo_final").cast("string"))
    return V.f_technical_rows(spark, sf).select("interview_id", code.alias("codigo"))


@query(
    "recode_specials",
    """SELECT interview_id, CASE WHEN c = '3' THEN '03' ELSE c END AS codigo FROM (
         SELECT interview_id, CAST(CASE WHEN codigo = 'Recuperar' THEN -66 WHEN codigo IS NULL THEN -77
           ELSE CAST(codigo AS BIGINT) END AS VARCHAR) AS c FROM f_human_rows) WHERE c NOT IN ('-66', '-88')""",
)
def _(spark, sf):
    code = C.missing_to_special(C.recover_code(F.col("codigo")))
    return reconcile.recode_specials(V.f_human_rows(spark, sf).select("interview_id", code.alias("codigo")), "codigo")


@query(
    "overlay_recode",
    """SELECT c.interview_id, c.submuestra, CASE WHEN c.submuestra <= 8 AND r.codigo_final IS NOT NULL THEN r.codigo_final ELSE c.human END AS human
       FROM f_codings c LEFT JOIN f_recodes r ON c.interview_id = r.interview_id AND c.interview_key = r.interview_key
         AND c.submuestra = r.submuestra AND c.nro_rph = r.nro_rph""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf)
    out = reconcile.overlay_recode(df, V.f_recodes(spark, sf), V.IDS, "human", when=F.col("submuestra") <= 8)
    return out.select("interview_id", "submuestra", "human")


@query(
    "backfill_agreement",
    """SELECT interview_id, coalesce(predice, CASE WHEN human = pred THEN 'si' WHEN human <> pred THEN 'no' END) AS predice
       FROM (SELECT interview_id, pred, human, CASE WHEN nro_rph > 2 THEN predice END AS predice FROM f_codings)""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).withColumn("predice", F.when(F.col("nro_rph") > 2, F.col("predice")))
    number = F.col("human").cast("int")
    return df.select("interview_id", C.backfill_agreement(F.col("predice"), number, F.col("pred")).alias("predice"))


@query(
    "normalize_flag",
    """SELECT interview_id, CASE WHEN predice = '1' THEN 'si' ELSE predice END AS predice FROM f_codings
       WHERE predice IS NOT NULL AND predice <> '66'""",
)
def _(spark, sf):
    return reconcile.normalize_flag(V.f_codings(spark, sf).select("interview_id", "predice"), "predice")


@query(
    "min_support",
    """SELECT interview_id, grupo FROM (SELECT interview_id, grupo, count(*) OVER (PARTITION BY grupo) AS n
         FROM (SELECT interview_id, human || substr(interview_key, 1, 2) AS grupo FROM f_codings)) WHERE n > 2""",
)
def _(spark, sf):
    group = F.concat("human", F.substring("interview_key", 1, 2))
    return reconcile.min_support(V.f_codings(spark, sf).select("interview_id", group.alias("grupo")), "grupo")


@query(
    "index_labels",
    """SELECT interview_id, human, codigo_int FROM f_codings JOIN (
         SELECT label, CAST(row_number() OVER (ORDER BY label NULLS LAST) - 1 AS INTEGER) AS codigo_int
         FROM (SELECT DISTINCT human AS label FROM f_codings)) ON human IS NOT DISTINCT FROM label""",
)
def _(spark, sf):
    return reconcile.index_labels(V.f_codings(spark, sf).select("interview_id", "human"), "human")[1]


@query(
    "label_coverage",
    """WITH c AS (SELECT arm, human, count(*) AS n FROM f_codings GROUP BY arm, human)
       SELECT scope, codes, frequent_codes, codes / CAST(42 AS DOUBLE) AS coverage FROM (
         SELECT arm AS scope, count(*) AS codes, count(*) FILTER (n > 5) AS frequent_codes FROM c GROUP BY arm
         UNION ALL SELECT 'all', count(*), count(*) FILTER (n > 5)
         FROM (SELECT human, count(*) AS n FROM f_codings GROUP BY human))""",
)
def _(spark, sf):
    return reconcile.label_coverage(V.f_codings(spark, sf), "human", "arm")


@query(
    "missing_codes",
    "SELECT aeciuo_2, glosa FROM f_codes WHERE aeciuo_2 NOT IN (SELECT human FROM f_codings WHERE human IS NOT NULL)",
)
def _(spark, sf):
    keys = reconcile.label_keys(V.f_codings(spark, sf), "human").withColumnRenamed("human", "aeciuo_2")
    return reconcile.missing_codes(keys, V.f_codes(spark, sf), "aeciuo_2")


@query(
    "filter_codes_worklist",
    """SELECT interview_id, oficio, human, '' AS codigo_final FROM f_codings
       WHERE submuestra < 80 AND human IN ('05', '09')""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf)
    out = reconcile.filter_codes_worklist(df, "human", ["05", "09"], "submuestra", "oficio")
    return out.select("interview_id", "oficio", "human", "codigo_final")


# --- assembly ---------------------------------------------------------------------


@query(
    "wave_window",
    """SELECT 'trial' AS ventana, id, submuestra FROM f_resp WHERE submuestra > 24 AND submuestra < 82
       UNION ALL SELECT 'regular', id, submuestra FROM f_resp WHERE submuestra >= 80 OR submuestra < 9""",
)
def _(spark, sf):
    df = V.f_resp(spark, sf).select("id", F.col("submuestra").cast("string").alias("submuestra"))
    trial = assemble.wave_window(df, "submuestra", 82).withColumn("ventana", F.lit("trial"))
    return trial.unionByName(assemble.wave_window(df, "submuestra", 9).withColumn("ventana", F.lit("regular")))


@query("ordered_waves", f"SELECT id, submuestra, {S.wave_position('submuestra')} AS wave_order FROM f_resp")
def _(spark, sf):
    df = assemble.ordered_waves(V.f_resp(spark, sf).select("id", "submuestra"), "submuestra")
    return df.orderBy(F.col("wave_order").asc_nulls_last(), "id")


@query("seq_in_group", "SELECT folio, orden, row_number() OVER (PARTITION BY folio ORDER BY orden) AS nro_rph FROM f_person")
def _(spark, sf):
    return assemble.seq_in_group(V.f_person(spark, sf).select("folio", "orden"), "folio", "orden")


@query("global_row_id", "SELECT id, oficio, row_number() OVER (ORDER BY id) AS id_fila FROM f_resp")
def _(spark, sf):
    return assemble.global_row_id(V.f_resp(spark, sf).select("id", "oficio"), "id")


@query(
    "merge_origins",
    """SELECT id, oficio, aeciuo_2, NULL AS submuestra, 'piloto' AS origen FROM f_resp
       UNION ALL SELECT interview_id, NULL, CAST(CAST(human AS INTEGER) AS VARCHAR), submuestra, 'ix' FROM f_codings""",
)
def _(spark, sf):
    a = V.f_resp(spark, sf).select("id", "oficio", "aeciuo_2")
    code = F.col("human").cast("double").alias("aeciuo_2")
    b = V.f_codings(spark, sf).select(F.col("interview_id").alias("id"), code, "submuestra")
    return assemble.merge_origins({"piloto": a, "ix": b})


def _training_sources(spark, sf):
    """All answers as one earlier survey, both pilot arms and a current survey."""
    df = V.f_resp(spark, sf)
    number = F.expr("CASE aeciuo_2 WHEN 'de' THEN 3 WHEN 'en' THEN 52 WHEN 'es' THEN 91 WHEN 'fr' THEN 11 END")
    df = df.withColumn("num", number.cast("bigint"))
    viii = df.filter(F.col("origen") == "viii")
    piloto = df.filter(F.col("origen") == "piloto")
    ix = df.filter(F.col("origen") == "ix")
    reviewed = viii.filter(F.col("n") < 10).select(
        F.col("id").alias("folio"), F.lit(1).alias("n_linea"), F.col("num").alias("ciuo_08cl"),
        (F.col("num") + 1).cast("string").alias("codigo_nuevo"),
        F.when(F.col("n") == 0, F.lit("CONFORME")).when(F.col("n") == 3, F.lit("NO CONFORME")).alias("conformidad"),
    )
    complete = viii.select(
        F.col("id").alias("folio"), F.lit(1).alias("n_linea"), "submuestra", "oficio", "tareas", F.col("num").alias("ciuo_08cl")
    )
    persons = piloto.select(
        F.col("id").alias("folio"), F.lit(1).alias("nro_rph"), "oficio", "tareas", F.col("num").alias("aeciuo_2"), "submuestra"
    )
    is_control = F.col("submuestra") < 80
    return {
        "reviewed": reviewed,
        "complete": complete,
        "control": persons.filter(is_control).withColumn("oficio", F.translate("oficio", "é", "?")),
        "raw": persons.select("folio", "nro_rph", F.col("oficio").alias("AE09A"), F.col("tareas").alias("AE09B")),
        "treatment": persons.filter(~is_control),
        "coded": ix.select("submuestra", "oficio", "tareas", F.col("num").cast("string").alias("aeciuo_2"), F.col("id").alias("folio")),
        "new": df.select("id", "submuestra", "oficio", "tareas"),
    }


_NUM = "CASE aeciuo_2 WHEN 'de' THEN 3 WHEN 'en' THEN 52 WHEN 'es' THEN 91 WHEN 'fr' THEN 11 END"


@query(
    "build_training_set",
    f"""WITH base AS (SELECT *, {_NUM} AS num FROM f_text),
       rows_ AS (
         SELECT id, origen, oficio_tarea, tareas_proc, CASE WHEN n = 3 THEN num + 1 ELSE num END AS num FROM base WHERE origen = 'viii'
         UNION ALL SELECT id, origen, oficio_tarea, tareas_proc, num FROM base
           WHERE origen = 'piloto' AND (oficio IS NULL OR oficio NOT IN ('-66', '-77', '-88', '-99', ''))
         UNION ALL SELECT id, origen, oficio_tarea, tareas_proc, num FROM base
           WHERE origen = 'ix' AND (submuestra >= 80 OR submuestra < 9)
             AND (oficio IS NULL OR oficio NOT IN ('-66', '-77', '-88', '-99', ''))),
       coded AS (SELECT *, CASE WHEN num = 3 THEN '03' ELSE CAST(num AS VARCHAR) END AS aeciuo_2 FROM rows_ WHERE num IS NOT NULL)
       SELECT id AS folio, origen, aeciuo_2, oficio_tarea,
         CASE WHEN tareas_proc IN ('66', '77', '88', '99') THEN '' ELSE tareas_proc END AS tareas_proc
       FROM (SELECT *, count(*) OVER (PARTITION BY aeciuo_2) AS n FROM coded) WHERE n > 2""",
)
def _(spark, sf):
    out = build_training_set("todo", _training_sources(spark, sf), wave=9)
    return out.select("folio", "origen", "aeciuo_2", "oficio_tarea", "tareas_proc")


@query("stratified_split", "SELECT id, aeciuo_2, split FROM f_split")
def _(spark, sf):
    return assemble.stratified_split(V.f_resp(spark, sf).select("id", "aeciuo_2"), "aeciuo_2", "id")


@query(
    "temporal_split",
    """SELECT id, origen, submuestra, split FROM (SELECT *, CASE WHEN origen <> 'ix' OR submuestra IN (80, 81, 82) THEN 'train'
         WHEN submuestra >= 6 AND submuestra < 80 THEN 'test' END AS split FROM f_resp) WHERE split IS NOT NULL""",
)
def _(spark, sf):
    return assemble.temporal_split(V.f_resp(spark, sf).select("id", "origen", "submuestra"), cut=6)
