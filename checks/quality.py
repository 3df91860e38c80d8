"""Triage, the human-coding round trip and quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query
from codewave.functions.codes import agreement_text
from codewave.operators import quality, triage
from codewave.operators.reconcile import normalize_flag
from codewave.plans.code_wave import sheets
from codewave.session import scratch_path
from codewave.sources import writers

WAVES = (80, 81, 82, 1, 2, 3, 4)

# --- triage -----------------------------------------------------------------------

_HUMAN = """(SELECT *, row_number() OVER (ORDER BY dificultad NULLS LAST, interview_id)
               <= floor((SELECT count(*) FROM f_codings) * (1 - CAST(0.6 AS DOUBLE))) AS humano FROM f_codings)"""


def _triage(spark, sf):
    return triage.triage_split(V.f_codings(spark, sf), "dificultad", "interview_id")


@query("triage_split", f"SELECT interview_id, oficio, dificultad, CASE WHEN humano THEN 'humano' ELSE 'auto' END AS parte FROM {_HUMAN}")
def _(spark, sf):
    human, auto = _triage(spark, sf)
    both = human.withColumn("parte", F.lit("humano")).unionByName(auto.withColumn("parte", F.lit("auto")))
    return both.select("interview_id", "oficio", "dificultad", "parte")


@query("publish_tables", f"SELECT interview_id, CASE WHEN humano THEN 'humano' ELSE 'auto' END AS parte FROM {_HUMAN}")
def _(spark, sf):
    human, auto = _triage(spark, sf)
    root = scratch_path(spark, "published")
    writers.publish_tables({"humano": human, "auto": auto}, root, "01")
    parts = [writers.read_published(spark, root, name).select("interview_id", F.lit(name).alias("parte")) for name in ("humano", "auto")]
    return parts[0].union(parts[1])


@query(
    "remaining_rows",
    f"""WITH t AS (SELECT pred, human, submuestra, nro_rph, oficio, arm, humano FROM {_HUMAN})
        SELECT pred, human, submuestra, nro_rph, oficio, arm FROM t WHERE NOT EXISTS (
          SELECT 1 FROM t u WHERE u.humano AND u.pred = t.pred AND u.human IS NOT DISTINCT FROM t.human
            AND u.submuestra = t.submuestra AND u.nro_rph = t.nro_rph AND u.oficio = t.oficio AND u.arm = t.arm)""",
)
def _(spark, sf):
    cols = ["pred", "human", "submuestra", "nro_rph", "oficio", "arm"]
    human, _auto = _triage(spark, sf)
    return triage.remaining_rows(V.f_codings(spark, sf).select(*cols), human.select(*cols))


@query(
    "assign_reviewers",
    f"""SELECT interview_id, dificultad, ['Primera', 'Segunda'][CAST(r % 2 AS INTEGER) + 1] AS persona_codifica FROM (
          SELECT interview_id, dificultad, row_number() OVER (ORDER BY dificultad NULLS LAST, interview_id) AS r
          FROM {_HUMAN} WHERE NOT humano)""",
)
def _(spark, sf):
    _human, auto = _triage(spark, sf)
    dealt = triage.assign_reviewers(auto, "dificultad", "interview_id", ["Primera", "Segunda"])
    return dealt.select("interview_id", "dificultad", "persona_codifica")


@query(
    "code_wave",
    """WITH r AS (SELECT p.vec_id, k.aeciuo_2, k.glosa, row_number() OVER (ORDER BY p.dificultad NULLS LAST, p.vec_id) AS pos,
                  CAST(floor(count(*) OVER () * (1 - 0.6)) AS BIGINT) AS cut
                FROM f_predictions p LEFT JOIN (SELECT f_keys.codigo_int, f_keys.aeciuo_2, glosa
                  FROM f_keys JOIN f_codes ON f_keys.aeciuo_2 = f_codes.aeciuo_2) k ON p.codigo_int = k.codigo_int)
       SELECT vec_id, aeciuo_2 AS prediccion_modelo, glosa AS glosa_prediccion, pos <= cut AS humano,
         CASE WHEN pos > cut THEN ['Primera', 'Segunda'][CAST((pos - cut) % 2 AS INTEGER) + 1] END AS persona_codifica
       FROM r""",
)
def _(spark, sf):
    scored = V.f_proba(spark, sf).select("vec_id", "proba")
    human, technical = sheets(scored, V.f_keys(spark, sf), V.f_codes(spark, sf), "vec_id", ["Primera", "Segunda"])
    cols = ["vec_id", "prediccion_modelo", "glosa_prediccion"]
    human = human.select(*cols, F.lit(True).alias("humano"), F.lit(None).cast("string").alias("persona_codifica"))
    return human.unionByName(technical.select(*cols, F.lit(False).alias("humano"), "persona_codifica"))


@query(
    "make_worksheet",
    """SELECT interview_id, submuestra, pred AS prediccion_modelo,
         '' AS "Codificacion_manual_Codificador_A", '' AS "Codificacion_manual_Codificador_B",
         '' AS "Revisión cruzada-> comparación de códigos asignados por Codificador A y B ",
         '' AS "Revisión de contraste", '' AS "CODIGO" FROM f_codings""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).select("interview_id", "submuestra", F.col("pred").alias("prediccion_modelo"), "dificultad")
    return triage.make_worksheet(df, scratch=["dificultad"])


@query(
    "integrate_reviews",
    """WITH b AS (
         SELECT interview_id, interview_key, submuestra, nro_rph, prediccion_modelo,
           CASE WHEN codigo = 'Recuperar' THEN -66 ELSE CAST(codigo AS BIGINT) END AS c, predice, 'codificación' AS origen FROM f_human_file
         UNION ALL SELECT interview_id, interview_key, submuestra, nro_rph, prediccion_modelo,
           CASE WHEN predice_bien IS NULL THEN NULL WHEN predice_bien = 1 THEN CAST(prediccion_modelo AS BIGINT) ELSE codigo_final END,
           NULL, 'técnica' FROM f_technical_file),
       d AS (SELECT * REPLACE (coalesce(c, -77) AS c) FROM b)
       SELECT d.interview_id, d.submuestra, d.origen, d.prediccion_modelo,
         coalesce(d.predice, CASE WHEN d.c = CAST(d.prediccion_modelo AS BIGINT) THEN 'si' ELSE 'no' END) AS "PREDICE",
         CASE WHEN d.submuestra <= 8 AND r.codigo_final IS NOT NULL THEN r.codigo_final ELSE CAST(d.c AS VARCHAR) END AS "CODIGO"
       FROM d LEFT JOIN f_recodes r ON d.interview_id = r.interview_id AND d.interview_key = r.interview_key
         AND d.submuestra = r.submuestra AND d.nro_rph = r.nro_rph""",
)
def _(spark, sf):
    out = triage.integrate_reviews(
        V.f_human_file(spark, sf), V.f_technical_file(spark, sf), V.f_recodes(spark, sf)
    )
    return out.select("interview_id", "submuestra", "origen", "prediccion_modelo", "PREDICE", "CODIGO")


@query(
    "exclude_listed",
    "SELECT interview_id, nro_rph, pred FROM f_codings WHERE NOT (pred = '05' AND oficio LIKE '%URGENT%')",
)
def _(spark, sf):
    df = V.f_codings(spark, sf)
    listed = df.filter((F.col("pred") == "05") & F.col("oficio").contains("URGENT"))
    return triage.exclude_listed(df.select("interview_id", "nro_rph", "pred"), listed, ["interview_id", "nro_rph"])


@query(
    "attach_predictions",
    """SELECT interview_id, nro_rph, pred AS pred_nueva, submuestra, CAST(pred = human AS INTEGER) AS predice2,
         lower(predice) AS predice, CAST(human AS BIGINT) AS codigo_cod FROM f_codings WHERE human IS NOT NULL""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf)
    pred = df.select("interview_id", "nro_rph", F.col("pred").alias("pred_nueva"), F.col("submuestra").cast("string").alias("submuestra"))
    human = df.select("interview_id", "nro_rph", "submuestra", F.upper("predice").alias("predice"), F.col("human").alias("codigo_cod"))
    return triage.attach_predictions(pred, human, ["interview_id", "nro_rph"])


# --- accuracy ---------------------------------------------------------------------


@query("accuracy_overall", "SELECT avg(predice) AS accuracy, count(*) AS n FROM f_predictions")
def _(spark, sf):
    return quality.accuracy_overall(V.f_predictions(spark, sf), "predice")


@query(
    "accuracy_top_confidence",
    """SELECT avg(predice) AS accuracy, count(*) AS n FROM (
         SELECT predice, row_number() OVER (ORDER BY pbb_caso DESC, vec_id) AS r FROM f_predictions)
       WHERE r <= floor((SELECT count(*) FROM f_predictions) * CAST(0.3 AS DOUBLE))""",
)
def _(spark, sf):
    return quality.accuracy_top_confidence(V.f_predictions(spark, sf), "predice", "pbb_caso", "vec_id")


@query("accuracy_by_code", "SELECT codigo_int, avg(predice) AS accuracy, count(*) AS n FROM f_predictions GROUP BY codigo_int")
def _(spark, sf):
    return quality.accuracy_by_code(V.f_predictions(spark, sf), "codigo_int", "predice")


@query(
    "errors_by_class",
    """SELECT y_test, round(avg(pbb_caso), 6) AS mean_confidence, count(*) AS n FROM f_predictions
       WHERE predice = 0 GROUP BY y_test HAVING count(*) > 5""",
)
def _(spark, sf):
    out = quality.errors_by_class(V.f_predictions(spark, sf), "y_test", "predice", "pbb_caso")
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "low_confidence",
    "SELECT vec_id, y_test, pbb_caso FROM f_predictions WHERE pbb_caso < CAST(0.13 AS DOUBLE)",
)
def _(spark, sf):
    return quality.low_confidence(V.f_predictions(spark, sf), "pbb_caso", 0.13).select("vec_id", "y_test", "pbb_caso")


@query(
    "accuracy_by_wave",
    """SELECT submuestra, CASE WHEN count(hit) = count(*) THEN CAST(sum(hit) AS DOUBLE) / count(*) END AS accuracy, count(*) AS n,
         CASE WHEN submuestra >= 80 THEN submuestra - 79 ELSE submuestra + 3 END AS wave_order
       FROM (SELECT submuestra, CASE WHEN submuestra = 82 OR human IS NOT NULL THEN coalesce(CAST(pred = human AS INTEGER), 0) END AS hit FROM f_codings)
       GROUP BY submuestra""",
)
def _(spark, sf):
    hit = (F.col("pred") == F.col("human")).cast("int")
    hit = F.when((F.col("submuestra") == 82) | F.col("human").isNotNull(), F.coalesce(hit, F.lit(0)))
    return quality.accuracy_by_wave(V.f_codings(spark, sf).withColumn("hit", hit), "submuestra", "hit")


@query(
    "compare_models",
    """SELECT submuestra, CASE WHEN submuestra IS NULL THEN 'all' ELSE 'wave' END AS scope,
         CAST(sum(a) AS BIGINT) AS hits_a, CAST(sum(b) AS BIGINT) AS hits_b, avg(a) AS accuracy_a, avg(b) AS accuracy_b
       FROM (SELECT submuestra, coalesce(CAST(pred = human AS INTEGER), 0) AS a,
               coalesce(CAST(lpad(CAST(nro_rph AS VARCHAR), 2, '0') = human AS INTEGER), 0) AS b FROM f_codings)
       GROUP BY ROLLUP (submuestra)""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).withColumn("otra", V.two_digits(F.col("nro_rph")))
    return quality.compare_models(df, "pred", "otra", "human", "submuestra")


# --- confusion --------------------------------------------------------------------


@query(
    "confusion_matrix",
    """WITH g AS (SELECT CAST(unnest(range(min(y_test), max(y_test) + 1)) AS INTEGER) AS k FROM f_predictions)
       SELECT a.k AS t, b.k AS p, ka.aeciuo_2 AS real, kb.aeciuo_2 AS predicho,
         (SELECT count(*) FROM f_predictions f WHERE f.y_test = a.k AND f.codigo_int = b.k) AS n
       FROM g a CROSS JOIN g b LEFT JOIN f_keys ka ON ka.codigo_int = a.k LEFT JOIN f_keys kb ON kb.codigo_int = b.k""",
)
def _(spark, sf):
    return quality.confusion_matrix(
        V.f_predictions(spark, sf), "y_test", "codigo_int", V.f_keys(spark, sf), "codigo_int", "aeciuo_2"
    )


_METRICS = """
  SELECT codigo_int, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall,
    round(sp, 6) AS specificity, round(np, 6) AS npv, round(er, 6) AS error_rate,
    round(tp / nullif(tp + fp + fn, 0), 6) AS jaccard, round(tp * tn / nullif(fp * fn, 0), 6) AS dor,
    round((tp * tn - fp * fn) / nullif(sqrt(CAST((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS DOUBLE)), 0), 6) AS mcc,
    round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr,
    round(fp / nullif(fp + tp, 0), 6) AS fdr, round(fn / nullif(fn + tn, 0), 6) AS for_rate,
    round(1.25 * pr * re / nullif(CAST(0.25 AS DOUBLE) * pr + re, 0), 6) AS f05, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1,
    round(5 * pr * re / nullif(4 * pr + re, 0), 6) AS f2, round((re + sp) / 2, 6) AS balanced_accuracy,
    round(sqrt(re * sp), 6) AS geometric_mean, round(re / nullif(1 - sp, 0), 6) AS lr_plus,
    round((1 - re) / nullif(sp, 0), 6) AS lr_minus, round(re + sp - 1, 6) AS youden, round(pr + np - 1, 6) AS mk,
    round(1 - er - abs(sp - re) / nullif(sp + re, 0), 6) AS op
  FROM (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, tn / nullif(tn + fp, 0) AS sp,
      tn / nullif(tn + fn, 0) AS np, (fp + fn) / (tp + fp + fn + tn) AS er FROM (
    SELECT k AS codigo_int, count(*) FILTER (y_test = k AND codigo_int = k) AS tp, count(*) FILTER (y_test <> k AND codigo_int = k) AS fp,
      count(*) FILTER (y_test = k AND codigo_int <> k) AS fn, count(*) FILTER (y_test <> k AND codigo_int <> k) AS tn,
      avg(CAST(y_test = codigo_int AS INTEGER)) AS accuracy
    FROM f_predictions, (SELECT CAST(unnest(range(min(y_test), max(y_test) + 1)) AS INTEGER) AS k FROM f_predictions)
    WHERE codigo_int BETWEEN (SELECT min(y_test) FROM f_predictions) AND (SELECT max(y_test) FROM f_predictions) GROUP BY k))
"""


def _metrics(spark, sf):
    metrics = quality.class_metrics(V.f_predictions(spark, sf), "y_test", "codigo_int")
    rates = [c for c in metrics.columns if c not in ("codigo_int", "tp", "fp", "fn", "tn")]
    return metrics.withColumns({c: F.round(c, 6) for c in rates})


@query("class_metrics", _METRICS)
def _(spark, sf):
    return _metrics(spark, sf)


# --- agreement --------------------------------------------------------------------


@query(
    "agreement_by_code",
    """SELECT human AS codigo_cod, CAST(count(*) FILTER (flag = 'si') AS DOUBLE) / count(*) AS prop, count(*) AS n, glosa
       FROM (SELECT human, CASE WHEN predice = '1' THEN 'si' ELSE predice END AS flag FROM f_codings) c
       JOIN f_codes ON c.human = f_codes.aeciuo_2 GROUP BY human, glosa""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).select(F.col("human").alias("codigo_cod"), agreement_text(F.col("predice")).alias("flag"))
    codes = V.f_codes(spark, sf).withColumnRenamed("aeciuo_2", "codigo_cod")
    return quality.agreement_by_code(df, "codigo_cod", "flag", codes, "glosa")


@query("agreement_summary", "SELECT predice, count(*) AS n, count(*) / (SELECT count(*) FROM f_codings) AS prop FROM f_codings GROUP BY predice")
def _(spark, sf):
    return quality.agreement_summary(V.f_codings(spark, sf), "predice")


def _per_wave(wave: int) -> str:
    return f"""(SELECT human, count(*) AS n, CAST(count(*) FILTER (flag = 'si') AS DOUBLE) / count(*) AS prop
                FROM (SELECT human, submuestra, CASE WHEN predice = '1' THEN 'si' ELSE predice END AS flag FROM f_codings)
                JOIN f_codes ON human = f_codes.aeciuo_2 WHERE submuestra = {wave} GROUP BY human)"""


@query(
    "agreement_across_waves",
    f"""SELECT coalesce(a.human, b.human, c.human) AS human, a.prop AS prop80, a.n AS n80, b.prop AS prop81, b.n AS n81,
          c.prop AS prop82, c.n AS n82
        FROM {_per_wave(80)} a FULL JOIN {_per_wave(81)} b ON a.human = b.human
          FULL JOIN {_per_wave(82)} c ON coalesce(a.human, b.human) = c.human""",
)
def _(spark, sf):
    df = V.f_codings(spark, sf).withColumn("flag", agreement_text(F.col("predice")))
    codes = V.f_codes(spark, sf).withColumnRenamed("aeciuo_2", "human")
    return quality.agreement_across_waves(df, "human", "flag", "submuestra", [80, 81, 82], codes)


@query(
    "flag_share_by_wave",
    r"""SELECT submuestra, flag, n, regexp_replace(CAST(CAST(round_even(n / sum(n) OVER (PARTITION BY submuestra) * 100, 2)
          AS DECIMAL(7, 2)) AS VARCHAR), '\.?0+$', '') || '%' AS share FROM (
         SELECT submuestra, flag, count(*) AS n FROM (SELECT submuestra, CASE WHEN predice = '1' THEN 'si' ELSE predice END AS flag
           FROM f_codings WHERE predice <> '66') GROUP BY submuestra, flag)""",
)
def _(spark, sf):
    df = normalize_flag(V.f_codings(spark, sf), "predice").withColumnRenamed("predice", "flag")
    return quality.flag_share_by_wave(df, "submuestra", "flag")


# --- cut-offs ---------------------------------------------------------------------

_CUTS = "(SELECT unnest([" + ", ".join(f"CAST({p:.2f} AS DOUBLE)" for p in quality.CUTS) + "]) AS p)"


def _grid_sql(source: str) -> str:
    return f"""SELECT submuestra, n, printf('%.2f', p) AS cut, p, CAST(floor(n * p) AS BIGINT) AS k,
        (SELECT count(*) FROM r WHERE r.submuestra = w.submuestra AND r.predice2 = 1 AND r.pos > w.n - floor(w.n * p)) AS hits
      FROM (SELECT submuestra, count(*) AS n FROM {source} GROUP BY submuestra) w, {_CUTS}"""


def _ranked_sql(source: str) -> str:
    return f"""WITH r AS (SELECT submuestra, predice2, interview_id, count(*) OVER (PARTITION BY submuestra) AS wave_n,
        row_number() OVER (PARTITION BY submuestra ORDER BY dificultad, interview_id) AS pos FROM {source})"""


_GRID = f"{_ranked_sql('f_hits')} SELECT *, CASE WHEN k > 0 THEN hits / k ELSE 0 END AS accuracy FROM ({_grid_sql('f_hits')})"


def _grid(spark, sf):
    return quality.cutoff_accuracy_grid(V.f_hits(spark, sf), "submuestra", "dificultad", "interview_id", "predice2")


@query("cutoff_accuracy_grid", _GRID)
def _(spark, sf):
    return _grid(spark, sf)


@query(
    "cutoff_loss_grid",
    f"""{_ranked_sql('f_hits')}, g AS ({_grid_sql('f_hits')})
        SELECT submuestra, cut, CAST(round_even((1 - CASE WHEN k > 0 THEN hits / k ELSE 0 END) * (n * p), 0) AS BIGINT) AS value FROM g
        UNION ALL SELECT submuestra, 'Total_sm', max(n) FROM g GROUP BY submuestra""",
)
def _(spark, sf):
    return quality.cutoff_loss_grid(_grid(spark, sf), "submuestra")


_KEPT = "(SELECT * FROM f_hits WHERE NOT (pred = '05' AND oficio LIKE '%URGENT%'))"


@query(
    "cutoff_grid_excluding",
    f"{_ranked_sql(_KEPT)} SELECT *, CASE WHEN k > 0 THEN hits / k ELSE 0 END AS accuracy FROM ({_grid_sql(_KEPT)})",
)
def _(spark, sf):
    df = V.f_hits(spark, sf)
    listed = df.filter((F.col("pred") == "05") & F.col("oficio").contains("URGENT"))
    return quality.cutoff_grid_excluding(
        df, listed, ["interview_id", "nro_rph"], "submuestra", "dificultad", "interview_id", "predice2"
    )


_LIMITS = "[" + ", ".join(f"CAST({p:.2f} AS DOUBLE)" for p in quality.BIN_LIMITS) + "]"
_BINS = f"""{_ranked_sql('f_hits')},
  b AS (SELECT submuestra, [round(q, 9) for q in quantile_cont(wave_n - pos, {_LIMITS})] AS breaks FROM r GROUP BY submuestra),
  bins AS (SELECT r.submuestra, interview_id, predice2, wave_n - pos AS d,
      CAST(len([x for x in breaks[1:13] if x <= wave_n - pos]) AS INTEGER) AS bin FROM r JOIN b ON r.submuestra = b.submuestra)"""


def _bins(spark, sf):
    return quality.difficulty_bins(V.f_hits(spark, sf), "submuestra", "dificultad", "interview_id", "predice2")


@query("difficulty_bins", f"{_BINS} SELECT * FROM bins")
def _(spark, sf):
    return _bins(spark, sf)


@query(
    "cumulative_misses",
    f"{_BINS} SELECT submuestra, "
    + ", ".join(
        f"count(*) FILTER (predice2 = 0 AND bin <= {i}) AS hasta_{label.replace(',', '_')}"
        for i, label in enumerate(quality.BIN_LABELS, start=1)
    )
    + " FROM bins GROUP BY submuestra",
)
def _(spark, sf):
    bins = quality.difficulty_bin(V.f_hits(spark, sf), "submuestra", "dificultad", "interview_id", "predice2")
    return quality.cumulative_misses(bins, "submuestra", "predice2")


# --- tables -----------------------------------------------------------------------


@query(
    "code_by_wave",
    "SELECT human, predice2, "
    + ", ".join(f'nullif(count(*) FILTER (submuestra = {w}), 0) AS "{w}"' for w in WAVES)
    + " FROM f_hits GROUP BY human, predice2",
)
def _(spark, sf):
    return quality.code_by_wave(V.f_hits(spark, sf), "human", "predice2", "submuestra", WAVES)


@query(
    "crosstab",
    "SELECT predice, "
    + ", ".join(f'count(*) FILTER (submuestra = {w}) AS "{w}"' for w in WAVES)
    + " FROM f_codings WHERE predice IS NOT NULL GROUP BY predice",
)
def _(spark, sf):
    return quality.crosstab(V.f_codings(spark, sf), "predice", "submuestra", WAVES)


@query("count_by", "SELECT human, predice, count(*) AS n FROM f_codings GROUP BY human, predice")
def _(spark, sf):
    return quality.count_by(V.f_codings(spark, sf), ["human", "predice"])


@query(
    "wave_totals",
    """SELECT submuestra, count(*) AS n, list_position([80, 81, 82, 1, 2], submuestra) AS position
       FROM f_codings WHERE submuestra IN (80, 81, 82, 1, 2) GROUP BY submuestra""",
)
def _(spark, sf):
    return quality.wave_totals(V.f_codings(spark, sf), "submuestra", [80, 81, 82, 1, 2])


@query(
    "unpivot_rates",
    """SELECT arm, 'sm' || CAST(submuestra AS VARCHAR) AS wave, round(100 * avg(predice2), 6) AS pct
       FROM f_hits GROUP BY arm, submuestra""",
)
def _(spark, sf):
    rates = V.f_hits(spark, sf).groupBy("arm").pivot("submuestra", list(WAVES)).agg(F.avg("predice2"))
    wide = rates.withColumnsRenamed({str(w): f"sm{w}" for w in WAVES})
    return quality.unpivot_rates(wide, ["arm"], [f"sm{w}" for w in WAVES]).withColumn("pct", F.round("pct", 6))
