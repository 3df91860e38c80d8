"""The views of ``views`` as DuckDB SQL, and the text rules as SQL expressions."""

from __future__ import annotations

import re

from codewave.functions.text import ACCENTED, TOKEN_SEPARATORS, UNACCENTED, default_stoplist

WORD = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}"
RUNS = f"[{WORD}]+|[^{WORD}]+"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def remove_stopwords(expr: str, words: list[str] | None = None) -> str:
    listed = ", ".join(quote(w) for w in (default_stoplist() if words is None else words))
    return (
        f"coalesce(array_to_string([t for t in regexp_extract_all({expr}, {quote(RUNS)}) "
        f"if t NOT IN ({listed})], ''), CASE WHEN {expr} IS NOT NULL THEN '' END)"
    )


def squish(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '[\s\x{{0b}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def normalize(expr: str, stop: bool = True, digits: bool = False) -> str:
    out = f"lower({expr})"
    if stop:
        out = remove_stopwords(out)
    out = rf"regexp_replace({out}, '\p{{P}}', '', 'g')"
    if digits:
        out = rf"regexp_replace({out}, '\d+', '', 'g')"
    return f"coalesce({squish(out)}, '')"


def tokens(expr: str) -> str:
    seps = quote(TOKEN_SEPARATORS)
    blanks = quote(" " * len(TOKEN_SEPARATORS))
    return f"[w for w in string_split(lower(translate(coalesce({expr}, ''), {seps}, {blanks})), ' ') if w <> '']"


def fold_accents(expr: str) -> str:
    return f"translate({expr}, {quote(ACCENTED)}, {quote(UNACCENTED)})"


def wave_position(expr: str, order: list[int] | None = None) -> str:
    order = order or [80, 81, 82, *range(1, 25)]
    cases = " ".join(f"WHEN {w} THEN {i}" for i, w in enumerate(order, start=1))
    return f"CASE {expr} {cases} END"


def class_sum(first: int) -> str:
    """The exponential of every tenth of 64 dimensions, added up."""
    return "exp(" + " + ".join(f"CAST(embedding[{d}] AS DOUBLE)" for d in range(first, 65, 10)) + ")"


def views() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Name -> (body, views it reads)."""
    return {
        "f_resp": (
            r"""
            SELECT id, text, n, submuestra,
              CASE WHEN id % 89 = 3 THEN '-99' WHEN id % 97 <> 5
                   THEN coalesce(array_to_string(words[1:(CASE WHEN no_tareas THEN 1000000000 ELSE 6 END)], ' '), '') END AS oficio,
              CASE WHEN no_tareas THEN '-88'
                   ELSE coalesce(array_to_string(words[(CASE WHEN no_oficio THEN 1 ELSE 7 END):], ' '), '') END AS tareas,
              CASE WHEN id % 61 <> 9 THEN lang END AS aeciuo_2,
              ['viii', 'piloto', 'ix'][n % 3 + 1] AS origen
            FROM (SELECT doc_id AS id, text, lang, n, doc_id % 89 = 3 OR doc_id % 97 = 5 AS no_oficio,
                    doc_id % 50 = 7 AND NOT (doc_id % 89 = 3 OR doc_id % 97 = 5) AS no_tareas, CASE WHEN n < 3 THEN n + 80 ELSE n - 2 END AS submuestra,
                    [w for w in string_split_regex(text, '[ \t\n\r\f]+') if w <> ''] AS words
                  FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS n FROM documents))""",
            (),
        ),
        "f_text": (
            f"""SELECT *, concat_ws(' ', oficio_proc, tareas_proc) AS oficio_tarea FROM (
                SELECT *, {normalize('oficio')} AS oficio_proc, {normalize('tareas')} AS tareas_proc FROM f_resp)""",
            ("f_resp",),
        ),
        "f_split": (
            """SELECT * EXCLUDE (rn, cn), CASE WHEN rn <= ceil(cn * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
               FROM (SELECT *, row_number() OVER (PARTITION BY aeciuo_2 ORDER BY md5('1234|' || CAST(id AS VARCHAR)), id) AS rn,
                       count(*) OVER (PARTITION BY aeciuo_2) AS cn FROM f_text)""",
            ("f_text",),
        ),
        "f_audit": (
            """SELECT d.doc_id AS id, d.lang AS seccion,
                 CASE WHEN l.quality = 1 THEN '0' WHEN l.quality = 0 THEN 'Q' || CAST(l.toxic AS VARCHAR) END AS codigo_nomenclaturas
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
            (),
        ),
        "f_person": (
            'SELECT conv_id AS folio, turn AS orden, role AS "AE09A", text AS "AE09B" FROM conversations',
            (),
        ),
        "f_review_all": (
            """SELECT l_orderkey AS folio,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n_linea,
                 CASE l_returnflag WHEN 'A' THEN 'CONFORME' WHEN 'R' THEN 'NO CONFORME' END AS conformidad,
                 l_suppkey % 40 + 90 AS ciuo_08cl, l_partkey % 40 + 90 AS codigo_nuevo
               FROM lineitem""",
            (),
        ),
        "f_reviewed": (
            """SELECT folio, CASE WHEN n_linea % 3 = 1 THEN n_linea + 1000 ELSE n_linea END AS n_linea,
                 CASE conformidad WHEN 'CONFORME' THEN ciuo_08cl WHEN 'NO CONFORME' THEN codigo_nuevo END AS ciuo_08cl_rev
               FROM f_review_all""",
            ("f_review_all",),
        ),
        "f_complete": (
            """SELECT folio, CASE WHEN n_linea % 3 = 2 THEN n_linea + 2000 ELSE n_linea END AS n_linea, ciuo_08cl
               FROM f_review_all""",
            ("f_review_all",),
        ),
        "f_codings": (
            """SELECT *, CASE WHEN interview_id % 101 = 0 THEN '66'
                   WHEN human = pred THEN CASE WHEN interview_id % 17 = 0 THEN '1' ELSE 'si' END
                   WHEN human <> pred THEN 'no' END AS predice
               FROM (SELECT *, CASE WHEN interview_id % 211 <> 0 THEN
                     CASE WHEN c % 10 < 7 THEN pred ELSE lpad(CAST(c % 12 + 1 AS VARCHAR), 2, '0') END END AS human
                 FROM (SELECT o_orderkey AS interview_id, CAST(o_custkey AS VARCHAR) AS interview_key, o_custkey AS c,
                   CAST(o_custkey % 5 + 1 AS INTEGER) AS nro_rph,
                   CAST(CASE WHEN year(o_orderdate) <= 1997 THEN year(o_orderdate) - 1915 ELSE year(o_orderdate) - 1997 END AS INTEGER) AS submuestra,
                   lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') AS pred,
                   o_totalprice AS dificultad, o_orderpriority AS oficio, o_orderstatus AS arm FROM orders))""",
            (),
        ),
        "f_hits": (
            "SELECT *, CAST(pred = human AS INTEGER) AS predice2 FROM f_codings WHERE human IS NOT NULL",
            ("f_codings",),
        ),
        "f_human_rows": (
            """SELECT interview_id, interview_key, submuestra, nro_rph, pred AS prediccion_modelo,
                 CASE WHEN interview_id % 41 <> 0 THEN CASE WHEN interview_id % 37 = 0 THEN 'Recuperar' ELSE human END END AS codigo,
                 predice, dificultad FROM f_codings""",
            ("f_codings",),
        ),
        "f_technical_rows": (
            """SELECT interview_id, interview_key, submuestra, nro_rph, pred AS prediccion_modelo,
                 CAST(pred = human AS INTEGER) AS predice_bien, CAST(human AS INTEGER) AS codigo_final, dificultad FROM f_codings""",
            ("f_codings",),
        ),
        "f_human_file": ("SELECT * FROM f_human_rows WHERE dificultad < 200000", ("f_human_rows",)),
        "f_technical_file": ("SELECT * FROM f_technical_rows WHERE dificultad >= 200000", ("f_technical_rows",)),
        "f_recodes": (
            """SELECT interview_id, interview_key, submuestra, nro_rph, CASE WHEN nro_rph <> 2 THEN '77' END AS codigo_final
               FROM f_codings WHERE pred IN ('03', '09')""",
            ("f_codings",),
        ),
        "f_catalogue_file": (
            """SELECT lpad(CAST((p_partkey + 13) % 14 + 1 AS VARCHAR), 2, '0') AS codigo_2,
                 CASE WHEN NOT p_partkey BETWEEN 1 AND 14 THEN p_brand END AS subgrupo,
                 CASE WHEN NOT p_partkey BETWEEN 1 AND 14 AND p_partkey % 2 = 0 THEN p_type END AS grupo,
                 p_name AS nombre FROM part""",
            (),
        ),
        "f_codes": (
            "SELECT codigo_2 AS aeciuo_2, nombre AS glosa FROM f_catalogue_file WHERE subgrupo IS NULL AND grupo IS NULL",
            ("f_catalogue_file",),
        ),
        "f_keys": (
            "SELECT CAST(aeciuo_2 AS INTEGER) - 1 AS codigo_int, aeciuo_2 FROM f_codes",
            ("f_codes",),
        ),
        "f_proba": (
            f"""SELECT vec_id, y_test, [round(v / list_sum(e), 6) for v in e] AS proba FROM (
                 SELECT vec_id, label AS y_test, [{", ".join(map(class_sum, range(1, 11)))}] AS e FROM embeddings)""",
            (),
        ),
        "f_predictions": (
            """SELECT *, CAST(codigo_int = y_test AS INTEGER) AS predice FROM (
                 SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS codigo_int,
                   list_max(proba) AS pbb_caso,
                   list_reverse_sort(proba)[1] / list_reverse_sort(proba)[2] AS dificultad FROM f_proba)""",
            ("f_proba",),
        ),
        "f_train_tokens": (
            f"""SELECT id, unnest(toks) AS word, generate_subscripts(toks, 1) AS p FROM (
                SELECT id, {tokens('oficio_tarea')} AS toks FROM f_split WHERE split = 'train')""",
            ("f_split",),
        ),
        "f_tokens": (
            f"""SELECT id, unnest(toks) AS word, generate_subscripts(toks, 1) AS p FROM (
                SELECT id, {tokens('oficio_tarea')} AS toks FROM f_split)""",
            ("f_split",),
        ),
        "f_vocab": (
            """SELECT word, n, n_docs, CAST(row_number() OVER (ORDER BY n DESC, fid, fp) + 1 AS INTEGER) AS idx FROM (
                 SELECT word, count(*) AS n, count(DISTINCT id) AS n_docs, min((id, p))[1] AS fid, min((id, p))[2] AS fp FROM f_train_tokens GROUP BY word)""",
            ("f_train_tokens",),
        ),
        "f_vectors": (
            "SELECT v.word, v.idx, e.embedding FROM f_vocab v JOIN embeddings e ON v.idx - 2 = e.vec_id",
            ("f_vocab",),
        ),
    }


def with_views(sql: str) -> str:
    """``sql`` behind the definitions of every view that it names."""
    defs = views()
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for parent in defs[name][1]:
                add(parent)
            needed.append(name)

    for name in defs:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({defs[name][0]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
