"""DuckDB SQL of the operator queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
    SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
counts AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
windows AS (
  SELECT rid, p, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words
  WINDOW o AS (PARTITION BY rid ORDER BY p)),
twice AS (
  SELECT rid, p FROM (
    SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows
    WHERE c IS NOT NULL) WHERE n > 1),
repeats AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (
    SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
-- fixed values: the function words of the rule table
stop AS (
  SELECT rid, count(*) AS n_stop FROM words WHERE lower(w) IN (
    SELECT unnest(string_split('{stop_words}', ' '))) GROUP BY rid),
line_totals AS (
  SELECT rid, count(*) AS n_lines FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
merged AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
    coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_stop, 0) AS n_stop, greatest(coalesce(n_lines, 0), 1) AS n_lines
  FROM docs d LEFT JOIN counts USING (rid) LEFT JOIN repeats USING (rid)
  LEFT JOIN lines USING (rid) LEFT JOIN stop USING (rid) LEFT JOIN line_totals USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_symbols > 0.25 * n_words
    OR n_stop < 0.02 * n_words OR n_dup_lines > 0.5 * n_lines) AS kept
FROM merged
"""

OP1 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS s FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
arcs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION SELECT reach.a, arcs.b FROM reach JOIN arcs ON reach.b = arcs.a),
least_reached AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d JOIN least_reached USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT item_id, least(len(ws), 13) AS n, list_slice(ws, i, i + 12) AS win FROM (
    SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items
    WHERE len(ws) > 0)),
starts AS (
  SELECT rid, i, n, list_slice(ws, i, i + n - 1) AS win FROM (
    SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
hits AS (SELECT rid, i, s.n, item_id FROM starts s JOIN windows w ON s.win = w.win),
words_hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (
    SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items_hit AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid)
"""

OP11 = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL),
components AS MATERIALIZED (
  SELECT rid, vec_id, len(embedding) AS width, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) - 1 AS pos FROM vectors),
broken AS (SELECT rid FROM components WHERE x IS NULL OR NOT isfinite(x)),
ints AS MATERIALIZED (
  SELECT rid, vec_id, pos // (width // 16) AS part, pos % (width // 16) AS k, floor(256 * x)::BIGINT AS v
  FROM components WHERE rid NOT IN (SELECT rid FROM broken)),
seeds AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (
    SELECT DISTINCT rid, vec_id FROM ints ORDER BY vec_id LIMIT 64)),
book0 AS MATERIALIZED (SELECT part, entry, k, v FROM ints JOIN seeds USING (rid)),
near1 AS MATERIALIZED ({near0}),
book1 AS MATERIALIZED ({book0}),
near2 AS MATERIALIZED ({near1}),
book2 AS MATERIALIZED ({book1}),
near3 AS MATERIALIZED ({near2}),
coded AS (
  SELECT rid, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near3 GROUP BY rid),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, k)) AS h FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN vectors USING (rid), digest
"""

NEAR = """
  SELECT rid, part, entry, d FROM (
    SELECT i.rid, i.part, b.entry, sum((i.v - b.v) * (i.v - b.v)) AS d
    FROM ints i JOIN {book} b ON i.part = b.part AND i.k = b.k GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1"""

BOOK = """
  SELECT part, entry, k, coalesce(m.v, {book}.v) AS v FROM {book} LEFT JOIN (
    SELECT part, entry, k, floor(sum(i.v) / count(*))::BIGINT AS v
    FROM {near} JOIN ints i USING (rid, part) GROUP BY ALL) m USING (part, entry, k)"""

for _n in range(3):
    OP11 = OP11.replace(f"{{near{_n}}}", NEAR.replace("{book}", f"book{_n}"))
    OP11 = OP11.replace(f"{{book{_n}}}", BOOK.replace("{book}", f"book{_n}").replace("{near}", f"near{_n + 1}"))

OP12 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS fails
  FROM words w LEFT JOIN marks USING (doc_id)),
cells AS MATERIALIZED (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM masks GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT '' AS o, 0 AS step, 0 AS own, 0 AS earlier, [{'own': 0, 'earlier': 0}] AS steps UNION ALL
  SELECT o || f, step + 1, bit, orders.earlier + orders.own,
    list_append(steps, {'own': bit, 'earlier': orders.earlier + orders.own})
  FROM orders, filters WHERE NOT contains(o, f)),
steps AS (
  SELECT o AS filter_order, unnest(range(1, 6)) AS step, unnest(list_slice(steps, 2, 6)) AS s
  FROM orders WHERE step = 5),
hits AS (
  SELECT part, filter_order, step, s.own AS filter, n, n_good, n_toxic,
    (fails & s.own) > 0 AS own, (fails & s.earlier) > 0 AS earlier, fails = s.own AS alone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, filter,
    sum(n) FILTER (NOT own AND NOT earlier) AS kept, sum(n) FILTER (own AND NOT earlier) AS removed,
    sum(n) FILTER (own AND earlier) AS redundant, sum(n) FILTER (alone) AS unique_fails,
    sum(n_good) FILTER (own AND NOT earlier) AS good_lost, sum(n_toxic) FILTER (own AND NOT earlier) AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept,
  coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, strlen(html)::BIGINT AS n, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
r AS (SELECT *, CASE WHEN n >= 100 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to FROM f)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""


def oracle_sql() -> dict[str, str]:
    from ridelens.llm.quality import STOP_WORDS
    return {
        "op1_near_duplicates": OP1,
        "op6_decontaminate": OP6,
        "op10_quality_rules": OP10.replace("{stop_words}", " ".join(STOP_WORDS)),
        "op11_vector_codes": OP11,
        "op12_filter_audit": OP12,
        "op13_warc": OP13,
    }
