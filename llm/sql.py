"""DuckDB SQL that must give the rows of the queries of the same name."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEAK_WORDS = rf"list_filter(regexp_split_to_array({LOWERED}, '[\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+'), lambda x: x <> '')"


def leaks(documents: str) -> str:
    """Contract of op9 over the rows of ``documents`` (any relation with doc_id and text)."""
    return f"""
WITH d AS (SELECT doc_id, {LEAK_WORDS} AS w FROM {documents}),
items AS (SELECT item_id, {LEAK_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
grams AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
),
places AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
counts AS (SELECT term, count(*) AS n FROM places GROUP BY term),
ranked AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id, w ORDER BY n, term) AS k, w
  FROM (SELECT DISTINCT item_id, w, unnest(w) AS term FROM items) JOIN counts USING (term)
),
two AS (SELECT item_id, min(term) FILTER (WHERE k = 1) AS t1, min(term) FILTER (WHERE k = 2) AS t2 FROM ranked WHERE k <= 2 GROUP BY item_id, w HAVING count(*) = 2),
near AS (
  SELECT a.doc_id, count(DISTINCT item_id) AS n_near
  FROM two JOIN places a ON a.term = t1 JOIN places b ON b.term = t2 AND b.doc_id = a.doc_id AND abs(a.p - b.p) <= 20 GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)"""


OP9 = leaks("documents")

OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, total, [3, 1, 2][(k - 1) % 3 + 1] AS weight FROM s),
steps AS (
  SELECT *, row_number() OVER (ORDER BY total / weight, source NULLS LAST) AS step, CAST(1.5 * sum(total) OVER () - 2 * coalesce(sum(total) OVER before, 0) AS DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS unit
  FROM w WINDOW before AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
goal AS (
  SELECT source, total, least(2.0 * total, (SELECT arg_min(unit, step) FROM steps WHERE unit * weight <= 2 * total) * weight) AS target FROM w
),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS rank FROM d),
j AS (
  SELECT r.doc_id, r.size, goal.total, goal.target, r.rank, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS shift
  FROM r JOIN goal ON r.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST((floor(rate * rank + shift) - floor(rate * (rank - 1) + shift)) * size AS BIGINT) AS taken
FROM j"""

GRAM_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x{{20}}\x{{09}}-\x{{0D}}]+')"


def near(documents: str) -> str:
    """Contract of op7 over the rows of ``documents``."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {GRAM_WORDS} AS w FROM {documents}),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.r = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""


LINE_WORDS = r"list_filter(regexp_split_to_array(line, '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> '')"
MASKED = "list_transform({}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)"

OP5 = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
every AS (SELECT doc_id, text, line, w, len(w) AS n FROM (
  SELECT doc_id, text, line, {LINE_WORDS} AS w FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d)
) WHERE len(w) > 0),
l AS (SELECT *, {MASKED.format("w[1:3]")} AS head FROM every WHERE n >= 5),
rows AS (SELECT DISTINCT doc_id, text, n, head, line FROM l),
held AS (SELECT n, head, line, any_value(w) AS w, count(DISTINCT (doc_id, text)) AS docs FROM l GROUP BY ALL),
leaves AS (SELECT n, head, sum(docs) AS total FROM held GROUP BY ALL HAVING sum(docs) >= 3),
places AS (SELECT n, head, line, docs, total, unnest({MASKED.format("w")}) AS word, generate_subscripts(w, 1) AS pos FROM held JOIN leaves USING (n, head)),
common AS (
  SELECT n, head, pos, word, list_sum([CAST(sum(docs) * x >= any_value(total) AS INTEGER) FOR x IN [50, 10, 2]]) AS level
  FROM places WHERE word <> '<*>' GROUP BY ALL HAVING sum(docs) >= 3
),
named AS (
  SELECT DISTINCT n, head, line, template FROM (
    SELECT n, head, line, k, string_agg(CASE WHEN c.level >= k THEN p.word ELSE '<*>' END, ' ' ORDER BY p.pos) AS template
    FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM places) p LEFT JOIN common c USING (n, head, pos, word)
    GROUP BY n, head, line, k HAVING count(*) FILTER (c.level >= k) >= CAST(0.6 AS DOUBLE) * n
  )
),
short AS (
  SELECT line FROM every WHERE n < 5 GROUP BY line
  HAVING count(DISTINCT (doc_id, text)) >= greatest(20, ceil((SELECT count(*) FROM documents) / 200))
),
shared AS (SELECT n, head, template FROM rows JOIN named USING (n, head, line) GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= 3),
gone AS (SELECT DISTINCT doc_id, text, line FROM rows JOIN named USING (n, head, line) JOIN shared USING (n, head, template)
  UNION SELECT doc_id, text, line FROM d, unnest(string_split(text, chr(10))) u(line) SEMI JOIN short USING (line)),
cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
SELECT documents.doc_id, k.text, k.n_lines, k.n_dropped
FROM documents JOIN (
  SELECT cut.doc_id, cut.text AS whole, coalesce(string_agg(cut.line, chr(10) ORDER BY i) FILTER (WHERE gone.line IS NULL), '') AS text,
    count(*) AS n_lines, count(gone.line) AS n_dropped
  FROM cut LEFT JOIN gone USING (doc_id, text, line) GROUP BY cut.doc_id, cut.text
) k ON documents.doc_id = k.doc_id AND documents.text = k.whole"""


# Twenty bits are four letters of base 32.
OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS bytes, sha1(payload) AS sha FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY sha, bytes ORDER BY page_id NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY sha, bytes ORDER BY page_id NULLS LAST) AS first FROM h)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to
FROM f"""

SEARCH_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"

OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {SEARCH_TERMS} AS w FROM documents),
n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, i, term, CAST(count(*) AS BIGINT) AS times FROM (
  SELECT item_id, i, unnest(w) AS term FROM (SELECT item_id, row_number() OVER () AS i, {SEARCH_TERMS} AS w FROM benchmark)
) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
s AS (
  SELECT item_id, i, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), total GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""

ORACLES = {"op3_mixing": OP3, "op5_line_templates": OP5, "op7_ngram_join": near("documents"), "op9_decontamination": OP9, "op11_warc": OP11, "op12_lexical_search": OP12}
