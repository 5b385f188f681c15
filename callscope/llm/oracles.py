"""DuckDB SQL for the operators that it can express, written from the definitions of their results."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: reach(a, b): b can be reached from a by links(a, b), which holds both directions.
_REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links(a, b) AS (SELECT x.vec_id, y.vec_id FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.98), {_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON r.a = vec_id"""

NGRAM_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links(a, b) AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON r.a = doc_id"""

SUBSTRING_DEDUP = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM win WHERE g IN (SELECT g FROM win GROUP BY 1 HAVING count(*) > 1)),
word AS (SELECT doc_id, j, ws[j] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT doc_id, count(*) AS n_words, count(g.j) AS n_removed, string_agg(x, ' ' ORDER BY word.j) FILTER (WHERE g.j IS NULL) AS t FROM word LEFT JOIN gone g USING (doc_id, j) GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


#: Base32 from the bits of a digest, five at a time.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
f AS (SELECT s, n, min(page_id) AS first FROM d GROUP BY 1, 2)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 5 * i + 1, 5)) AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM (SELECT *, CAST(CAST(unhex(s) AS BIT) AS VARCHAR) AS bits FROM d) JOIN f USING (s, n)"""


def crc32(text: str) -> str:
    """SQL: the unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))"
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}))"


#: lightest(conv_id, i, st, cost, audit): the best prefix of i rows for each state of the grammar; at most one insertion between rows can be in a lightest repair.
REPAIR = f"""WITH RECURSIVE fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("k")} % 20 AS fate FROM (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations)),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid FROM damaged),
seen AS (SELECT *, solid = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
r AS (SELECT *, blank OR again AS must, CASE WHEN NOT blank AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late FROM seen),
facts AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, sum(late) AS truncated, count_if(before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
go(a, x, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
maybe(a, b, cost, letter) AS (SELECT s, s, 0, '' FROM range(4) t(s) UNION ALL SELECT a, b, 2, 'I' FROM go WHERE x <> 's'),
edits AS (SELECT conv_id, i, a, b, late AS cost, 'K' AS letter FROM r JOIN go USING (x) WHERE NOT must UNION ALL SELECT conv_id, i, a, b, 2 + late, 'R' FROM r CROSS JOIN go WHERE NOT must AND go.x <> 's' UNION ALL SELECT conv_id, i, s, s, 3, 'D' FROM r CROSS JOIN range(4) t(s)),
steps AS (SELECT e.conv_id, e.i, m.a, e.b, m.cost + e.cost AS cost, m.letter || e.letter AS letters FROM edits e JOIN maybe m ON m.b = e.a),
best(conv_id, i, st, cost, audit) AS (SELECT conv_id, 0, 0, 0, '' FROM facts UNION ALL
 SELECT conv_id, i, st, cost, audit FROM (SELECT s.conv_id, s.i, s.b AS st, p.cost + s.cost AS cost, p.audit || s.letters AS audit FROM best p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1 AND s.a = p.st) QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
goal AS (SELECT f.conv_id, p.cost + m.cost AS cost, p.audit || m.letter AS audit FROM best p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.rows = p.i JOIN maybe m ON m.a = p.st AND m.b IN (0, 3) QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY p.cost + m.cost, p.audit || m.letter) = 1),
letters AS (SELECT conv_id, k, audit[k] AS letter, k - length(replace(audit[1:k], 'I', '')) AS inserted FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM goal)),
kept AS (SELECT l.conv_id, l.k, l.letter, r.role, r.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS o, max(CASE WHEN l.letter = 'K' AND r.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.k - l.inserted AND l.letter <> 'I' WHERE l.letter <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM kept GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(goal.cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN goal ON goal.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id"""

#: Bytes as pairs of hexadecimal digits, so that a byte's place is the same in every text; windows from short parts, as DuckDB counts a string's characters from its start.
SUFFIX_DEDUP = """WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT r, o, substr(h, 2 * o + 1, 1310) AS b, n FROM (SELECT r, h, n, unnest(range(0, n - 399, 256)) AS o FROM t)),
win AS (SELECT r, o + i AS i, md5(substr(b, 2 * i + 1, 800)) AS g FROM (SELECT r, o, b, unnest(range(0, least(256, n - 399 - o))) AS i FROM part)),
hit AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY 1 HAVING count(*) > 1)),
run AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit)) GROUP BY r, k),
edge AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM run),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM edge JOIN t USING (r) GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN cut USING (r)"""

_RUN = "'[A-Za-z\\x{C0}-\\x{FF}]+'"
#: parts(word, i, rest): words without one letter. Near words share a part at one place, or one is a part of the other.
SPELLING = f"""WITH RECURSIVE run AS (SELECT d, x, count(*) AS times FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), {_RUN})), '{_UPPER}', '{_UPPER.lower()}') AS x FROM documents) WHERE length(x) >= 5 GROUP BY 1, 2),
hashed AS (SELECT x, times, {crc32("k")} AS h FROM (SELECT *, concat(d, ':', x) AS k FROM run)),
spoilt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
parts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links(a, b, bn) AS (SELECT p.word, q.word, q.n FROM parts p JOIN parts q ON p.i = q.i AND p.rest = q.rest AND p.word <> q.word UNION SELECT p.word, w.word, w.n FROM parts p JOIN words w ON w.word = p.rest UNION SELECT w.word, p.word, p.n FROM parts p JOIN words w ON w.word = p.rest),
best AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, bn FROM links QUALIFY row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) = 1),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n FROM words LEFT JOIN best ON a = word),
walk(word, last) AS (SELECT word, word FROM known UNION ALL SELECT w.word, k.form FROM walk w JOIN known k ON k.word = w.last WHERE k.form IS NOT NULL),
ends AS (SELECT w.word, w.last FROM walk w JOIN known k ON k.word = w.last WHERE k.form IS NULL)
SELECT word, form, last AS root, n, n_near, form_n FROM known JOIN ends USING (word)"""
