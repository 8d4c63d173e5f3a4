"""Expected results in DuckDB SQL, where SQL can express an operator."""

from __future__ import annotations

_OP3 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE r <= 5
"""

_OP4 = r"""
WITH lines AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), keyed AS (
    SELECT doc_id, l, list_transform(l, lambda x:
        translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k
    FROM lines
), shared AS (
    SELECT key FROM (SELECT unnest(list_distinct(k)) AS key FROM keyed)
    WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10
), common AS (
    SELECT coalesce(list(key), []) AS keys FROM shared
), kept AS (
    SELECT doc_id, l, list_filter(list_zip(l, k), lambda p: NOT list_contains(keys, p[2])) AS left_
    FROM keyed, common
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(left_) AS BIGINT) AS n_dropped,
    sha256(array_to_string(list_transform(left_, lambda p: p[1]), chr(10))) AS kept_sha256
FROM kept
"""

_OP9 = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mix,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM per_source
), weighed AS (
    SELECT *, [5, 2, 1][CAST(k % 3 + 1 AS INTEGER)] AS weight, 3 * source_size AS room,
        CAST(sum(source_size) OVER () AS BIGINT) AS total
    FROM ranked
), levels AS (
    SELECT *,
        CAST(total - coalesce(CAST(sum(room) OVER before AS BIGINT), 0) AS DOUBLE)
            / CAST(sum(weight) OVER after AS DOUBLE) AS level
    FROM weighed
    WINDOW before AS (ORDER BY room / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (ORDER BY room / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(CAST(room AS DOUBLE),
        max(CASE WHEN room >= level * weight THEN level END) OVER () * weight) END AS target
    FROM levels
), queued AS (
    SELECT d.*, t.source_size, t.target, t.k, t.total,
        CAST(sum(size) OVER (PARTITION BY t.k ORDER BY mix, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queued
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), turns AS (
    SELECT *, CAST(queued + source_size * (turn - 1) AS DOUBLE) / target AS time
    FROM queued, (VALUES (1), (2), (3)) AS e(turn) WHERE target > 0
), taken AS (
    SELECT doc_id, mix, size, turn,
        sum(size) OVER (ORDER BY time, k, mix, doc_id, size, turn ROWS UNBOUNDED PRECEDING) <= total AS within
    FROM turns
), copies AS (
    SELECT doc_id, mix, size, count(*) FILTER (within) AS n FROM taken GROUP BY doc_id, mix, size
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(c.n, 0) AS BIGINT) AS taken,
    CAST(coalesce(c.n, 0) AS INTEGER) AS copies
FROM queued q LEFT JOIN copies c ON q.doc_id = c.doc_id AND q.size = c.size
"""

# CRC-32 of a text of digits: its bytes come in one after the other, eight shifts each.
_OP13 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({'mark': md5(length(role) || ':' || role || text), 'chars': length(text)}
        ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM turns GROUP BY conv_id
), hashed AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 6 AS h
    FROM own
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
    FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), paths AS (
    SELECT conv_id, len(turns) AS whole, d AS depth,
        md5(array_to_string(list_transform(turns[1:d], lambda t: t.mark), ',')) AS node,
        CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda t: t.mark), ',')) END AS parent,
        CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars
    FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM rebuilt)
), nodes AS (
    SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '')) AS ends_sha256
    FROM paths GROUP BY depth, node
), children AS (
    SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, node)
), sums AS (
    -- a node's first member walks up to the root
    SELECT p.depth, p.node, sum((c.n_convs - 1) * c.chars) AS saved, count(*) FILTER (c.n_children = 0) AS leaves
    FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.depth, p.node
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, c.n_convs, c.n_children,
    s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (depth, node) LEFT JOIN nodes a ON a.depth = c.depth - 1 AND a.node = c.parent
"""

ORACLE_SQL = {"op3_topk": _OP3, "op4_line_dedup": _OP4, "op9_mixing": _OP9, "op13_trie": _OP13}
