"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import mixing

#: Links by the sizes of shingle sets' intersections, groups by the links' closure.
JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
    FROM documents
), shingled AS (
    SELECT doc_id, CASE WHEN len(w) >= 5
        THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
        ELSE [array_to_string(w, ' ')] END AS s
    FROM words WHERE len(w) > 0
), sets AS (
    SELECT min(doc_id) AS rep, count(*) AS copies, len(s) AS n, s FROM shingled GROUP BY s
), grams AS (
    SELECT rep, unnest(s) AS g FROM sets
), shared AS (
    SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL
), pairs AS (
    SELECT x, y FROM shared JOIN sets p ON p.rep = x JOIN sets q ON q.rep = y WHERE 5 * c >= 4 * (p.n + q.n - c)
), links AS (
    SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
    SELECT rep AS x, rep AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), groups AS (
    SELECT x, min(y) AS class_id FROM reach GROUP BY x
), counts AS (
    SELECT l.x, sum(s.copies) AS n FROM links l JOIN sets s ON s.rep = l.y GROUP BY l.x
)
SELECT d.doc_id, coalesce(g.class_id, d.doc_id) AS class_id, CAST(coalesce(s.copies - 1 + coalesce(c.n, 0), 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN shingled h ON h.doc_id = d.doc_id LEFT JOIN sets s ON s.s = h.s
LEFT JOIN groups g ON g.x = s.rep LEFT JOIN counts c ON c.x = s.rep
"""


def _step(margin: str, before: str) -> str:
    total = f"sum(weight) OVER (PARTITION BY {margin})"
    return f"SELECT * REPLACE (CASE WHEN {total} > 0 THEN weight * share_{margin} / {total} ELSE 0 END AS weight) FROM ({before})"


def mix() -> str:
    """Raking by a recursive query, then the calibrated sample."""
    topic = "".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{pattern}') THEN '{name}' " for name, pattern in mixing.TOPICS.items())
    margins = ", ".join(mixing.MARGINS)
    raw = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}), {mixing.EVENNESS}) AS raw_{m}, count(*) OVER (PARTITION BY {m}) AS n_{m}" for m in mixing.MARGINS)
    shares = ", ".join(f"raw_{m} / sum(raw_{m} / n_{m}) OVER () AS share_{m}" for m in mixing.MARGINS)
    columns = f"{margins}, tokens, {', '.join(f'share_{m}' for m in mixing.MARGINS)}"
    turn = f"SELECT * FROM rake WHERE turn < {mixing.MOST_ROUNDS}"
    for m in mixing.MARGINS:
        turn = _step(m, turn)
    order = f"rate DESC NULLS LAST, {', '.join(f'{m} NULLS FIRST' for m in mixing.MARGINS)}"
    before = f"OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same = " AND ".join(f"o.{m} IS NOT DISTINCT FROM c.{m}" for m in mixing.MARGINS)
    return f"""
WITH RECURSIVE own AS (
    SELECT doc_id, source, lang, CASE {topic}ELSE 'prose' END AS topic, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS n_tokens
    FROM documents
), cells AS (
    SELECT {margins}, sum(n_tokens) AS tokens FROM own GROUP BY ALL
), shares AS (
    SELECT {margins}, tokens, {shares} FROM (SELECT *, {raw} FROM cells)
), rake AS (
    SELECT {columns}, 0 AS turn, CAST(tokens AS DOUBLE) AS weight FROM shares
    UNION ALL SELECT {columns}, turn + 1, weight FROM ({turn})
), rated AS (
    SELECT *, CASE WHEN tokens > 0 THEN weight / tokens END AS rate FROM rake WHERE turn = {mixing.MOST_ROUNDS}
), tried AS (
    SELECT *, row_number() OVER (ORDER BY {order}) AS place,
        ({mixing.KEEP} * sum(tokens) OVER () - coalesce(sum(tokens) {before}, 0)) / nullif(greatest(sum(weight) OVER () - coalesce(sum(weight) {before}, 0), 0), 0) AS scale
    FROM rated
), chances AS (
    SELECT *, (SELECT arg_min(scale, place) FROM tried WHERE rate > 0 AND scale * rate <= 1) AS chosen FROM tried
), sampled AS (
    SELECT o.*, CASE WHEN n_tokens = 0 OR rate IS NULL OR chosen IS NULL THEN 1.0 ELSE least(1.0, chosen * rate) END AS p
    FROM own o JOIN chances c ON {same}
)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, round(1 / p, 4) AS token_weight
FROM sampled WHERE CAST('0x' || substr(md5('mixing:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / pow(16, 12) < p
"""


#: Equal payloads of at least 100 bytes: the smallest page_id responds, the others refer to it.
WARC = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
    CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


#: CRC-32 of the ASCII text {0}, bit by bit.
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, skip: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

#: The state after each batch of a user built anew, sessions by the gaps in it.
SESSIONS = f"""
WITH turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv, CAST(turn AS BIGINT) AS t,
        {CRC.format("CAST(conv_id AS VARCHAR)")} AS c, {CRC.format("CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)")} AS h
    FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL
), placed AS (
    SELECT 2 * CAST(floor(conv / 8) AS BIGINT) + c % 2 AS u, (c // 2) % 7200 + 300 * t + h % 600 AS s, h, h // 600 AS g FROM turns
), events AS (
    SELECT u, s, h, CAST(floor(s / 3600) AS BIGINT) + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS b FROM placed
), states AS (
    SELECT k.u, k.b AS upto, e.b, e.s, e.h FROM (SELECT DISTINCT u, b FROM events) k JOIN events e ON e.u = k.u AND e.b <= k.b
), gaps AS (
    SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, upto ORDER BY s) <= 420 THEN 0 ELSE 1 END AS breaks FROM states
), runs AS (
    SELECT *, sum(breaks) OVER (PARTITION BY u, upto ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM gaps
), versions AS (
    SELECT u, upto, min(s) AS first, max(s) AS last, count(*) AS n, count(*) FILTER (b = upto) AS fresh, CAST(sum(h) AS BIGINT) AS total
    FROM runs GROUP BY u, upto, run HAVING max(b) = upto
), log AS (
    SELECT v.u, v.upto, v.first, min(w.upto) AS by_batch, arg_min(w.first, w.upto) AS by_start
    FROM versions v JOIN versions w ON w.u = v.u AND w.upto > v.upto AND v.first BETWEEN w.first AND w.last GROUP BY ALL
), swallowed AS (
    SELECT u, by_batch, by_start, count(*) AS n FROM log GROUP BY ALL
)
SELECT v.u AS "user", v.upto AS batch, v.first AS start_s, v.last AS end_s, v.n AS n_events, v.fresh AS n_new, coalesce(r.n, 0) AS n_retracted,
    v.total AS h_sum, l.by_batch AS retracted_batch, l.by_start AS retracted_start_s
FROM versions v LEFT JOIN log l ON l.u = v.u AND l.upto = v.upto AND l.first = v.first
LEFT JOIN swallowed r ON r.u = v.u AND r.by_batch = v.upto AND r.by_start = v.first
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_lsh_forest": JOIN, "op7_mixing": mix(), "op9_warc": WARC, "op13_late_sessions": SESSIONS}
