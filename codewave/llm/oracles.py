"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP9 = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP3 = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens,
           md5(coalesce(doc_id::VARCHAR, '')) AS d, md5(coalesce(text, '')) AS e,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 256)::INT AS block
    FROM documents),
sources AS (SELECT src, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY src),
known AS (
    SELECT list(tokens / total) AS p, count(*) AS n
    FROM (SELECT tokens::DOUBLE AS tokens, sum(tokens) OVER ()::DOUBLE AS total FROM sources WHERE tokens > 0)),
ends AS (
    SELECT *, 0.95 * ln(n) AS target,
           list_sum(list_transform(p, lambda x: -x * ln(x))) >= 0.95 * ln(n) AS natural_is_enough,
           list_max(list_transform(p, lambda x: 1 / x)) / n <= 4 AS even_is_allowed
    FROM known),
halving AS (
    SELECT 0 AS step, p, target,
           CASE WHEN natural_is_enough THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e0, 1.0::DOUBLE AS e1,
           0.0::DOUBLE AS l0, CASE WHEN even_is_allowed THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS l1
    FROM ends
    UNION ALL
    SELECT step + 1, p, target,
           CASE WHEN high THEN (e0 + e1) / 2 ELSE e0 END, CASE WHEN high THEN e1 ELSE (e0 + e1) / 2 END,
           CASE WHEN fits THEN l0 ELSE (l0 + l1) / 2 END, CASE WHEN fits THEN (l0 + l1) / 2 ELSE l1 END
    FROM (
        SELECT *,
               ln(list_sum(list_transform(p, lambda x: pow(x, (e0 + e1) / 2))))
               - (e0 + e1) / 2 * list_sum(list_transform(p, lambda x: pow(x, (e0 + e1) / 2) * ln(x)))
                 / list_sum(list_transform(p, lambda x: pow(x, (e0 + e1) / 2))) >= target AS high,
               list_max(list_transform(p, lambda x: pow(x, (l0 + l1) / 2 - 1)))
                 / list_sum(list_transform(p, lambda x: pow(x, (l0 + l1) / 2))) <= 4 AS fits
        FROM halving WHERE step < 20)),
solved AS (SELECT greatest(e0, l1) AS a FROM halving WHERE step = 20),
powers AS (
    SELECT src, tokens, sum(tokens) OVER ()::BIGINT AS total,
           CASE WHEN tokens > 0 THEN pow(tokens / (sum(tokens) OVER ())::DOUBLE, a) ELSE 0 END AS power
    FROM sources, solved),
budgets AS (
    SELECT src, tokens, floor(power / sum(power) OVER () * total + 0.5)::BIGINT AS budget FROM powers),
plan AS (
    SELECT src, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole,
           CASE WHEN tokens > 0 THEN budget % tokens ELSE -1 END AS rest FROM budgets),
blocks AS (SELECT src, block, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
passes AS (
    SELECT src, block, pass,
           row_number() OVER w AS block_order,
           (sum(tokens) OVER w - tokens)::BIGINT AS start
    FROM blocks JOIN plan USING (src), LATERAL (SELECT unnest(range(0, whole + 1)) AS pass)
    WINDOW w AS (PARTITION BY src, pass ORDER BY md5(src || ':' || pass || ':' || block))),
placed AS (
    SELECT docs.*, sum(tokens) OVER (PARTITION BY src, block ORDER BY d, e ROWS UNBOUNDED PRECEDING) AS up_to FROM docs)
SELECT doc_id, source, tokens AS n_tokens, pass::INT AS pass_no, block_order::INT AS block_order
FROM placed JOIN plan USING (src) JOIN passes USING (src, block)
WHERE pass < whole OR start + up_to <= rest
"""

OP11 = r"""
WITH docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM docs),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS w FROM starts),
again AS (
    SELECT doc_id, s AS i, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1 AS again FROM windows),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
marked AS (
    SELECT doc_id, i, word,
           max(coalesce(again, false)) OVER (
               PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM each LEFT JOIN again USING (doc_id, i)),
counted AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
    FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (doc_id)
"""

OP12 = """
WITH turns AS (
    SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS u,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
    SELECT c, c - c % 5 AS head,
           xor(list_reduce(
               range(8 * len(c::VARCHAR)),
               lambda crc, j: xor(
                   xor(crc, CASE WHEN j % 8 = 0 THEN ascii((c::VARCHAR)[j // 8 + 1]) ELSE 0 END) >> 1,
                   CASE WHEN xor(crc, CASE WHEN j % 8 = 0 THEN ascii((c::VARCHAR)[j // 8 + 1]) ELSE 0 END) % 2 = 1
                        THEN 3988292384 ELSE 0 END),
               4294967295::BIGINT), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
    SELECT heads.c, 0 AS part, p, u FROM heads JOIN turns ON turns.c = head AND p <= h
    UNION ALL SELECT heads.c, 1, p, u FROM heads JOIN turns ON turns.c = heads.c AND p > h),
paths AS (
    SELECT c, coalesce(path, []) AS path
    FROM heads LEFT JOIN (SELECT c, list(u ORDER BY part, p) AS path FROM rebuilt GROUP BY c) USING (c)),
members AS (
    SELECT c, d, len(path) = d AS ends, CASE WHEN d > 0 THEN strlen(path[d].text) ELSE 0 END AS bytes,
           sha256(to_json(path[1:d])::VARCHAR) AS node,
           CASE WHEN d > 0 THEN sha256(to_json(path[1:d - 1])::VARCHAR) END AS parent
    FROM paths, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)),
nodes AS (
    SELECT node, any_value(parent) AS parent, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
below AS (
    SELECT above.node, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
           sum((n - 1) * nodes.bytes)::BIGINT AS saved_tokens
    FROM nodes LEFT JOIN children USING (node)
    JOIN members AS above ON above.c = nodes.c AND above.d <= nodes.d
    GROUP BY above.node)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes AS up ON nodes.parent = up.node
"""

ORACLES = {
    "op3_temperature_mixing": OP3,
    "op9_exact_dedup": OP9,
    "op11_phrase_automata": OP11,
    "op12_prefix_trie": OP12,
}
