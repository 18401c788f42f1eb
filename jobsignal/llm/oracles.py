"""DuckDB SQL of the training-data queries that SQL can express; written from the contracts, not from the operators."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Smallest id reachable over link(a, b); node(id) lists all ids.
COMPONENTS = """
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, r) AS (SELECT id, id FROM node UNION SELECT e.a, reach.r FROM reach JOIN both_ways e ON e.b = reach.id WHERE reach.r < e.a),
smallest AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id AND 90 * greatest(x.n, y.n) <= 100 * least(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
node AS (SELECT doc_id AS id FROM documents),
{COMPONENTS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, smallest.component AS component_id FROM s JOIN smallest ON smallest.id = s.doc_id
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i+12] AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
corpus AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
freq AS (SELECT t, count(*) AS c FROM corpus GROUP BY t),
term AS (SELECT p, o, p[o] AS t FROM (SELECT p, unnest(range(1, len(p) + 1)) AS o FROM (SELECT DISTINCT p FROM win))),
ranked AS (SELECT term.p, term.o, term.t, row_number() OVER (PARTITION BY term.p ORDER BY freq.c, term.o) AS k FROM term JOIN freq ON freq.t = term.t),
whole AS (SELECT p, row_number() OVER () AS id FROM ranked GROUP BY p HAVING count(*) = len(p)),
at1 AS (SELECT whole.id, x.doc_id, x.i - r.o AS s FROM whole JOIN ranked r ON r.p = whole.p AND r.k = 1 JOIN corpus x ON x.t = r.t),
at2 AS (SELECT whole.id, x.doc_id, x.i - r.o AS s FROM whole JOIN ranked r ON r.p = whole.p AND r.k = least(2, len(r.p)) JOIN corpus x ON x.t = r.t),
same AS (
  SELECT at1.id, at1.doc_id, at1.s, count(*) AS n FROM at1 JOIN whole ON whole.id = at1.id JOIN term ON term.p = whole.p
  JOIN corpus c ON c.doc_id = at1.doc_id AND c.i = at1.s + term.o AND c.t = term.t GROUP BY at1.id, at1.doc_id, at1.s),
hit AS (SELECT same.doc_id, same.s, same.n, whole.p FROM same JOIN whole ON whole.id = same.id AND same.n = len(whole.p)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, p FROM hit) h JOIN win ON win.p = h.p GROUP BY doc_id),
near AS (SELECT DISTINCT at1.doc_id, whole.p FROM at1 JOIN at2 ON at1.id = at2.id AND at1.doc_id = at2.doc_id AND abs(at1.s - at2.s) <= 2 JOIN whole ON whole.id = at1.id),
close AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM near JOIN win ON win.p = near.p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN close USING (doc_id)
"""

LINE_DEDUP = r"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
h AS (SELECT doc_id, line, i, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM x),
c AS (SELECT doc_id, line, i, coalesce((31 * lag(v) OVER (PARTITION BY doc_id ORDER BY i) + v) % 3 = 0, false) AS ends FROM h),
k AS (SELECT doc_id, line, i, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
chunk AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS txt FROM k GROUP BY doc_id, chunk),
ranked AS (SELECT *, n > 1 AND regexp_matches(txt, '[^ \t\n\x0B\f\r]') AND row_number() OVER (PARTITION BY txt ORDER BY doc_id, chunk) > 1 AS gone FROM chunk)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(r.txt, chr(10) ORDER BY r.chunk) FILTER (NOT r.gone), '') END AS text,
  count(r.chunk) AS n_chunks, count(*) FILTER (r.gone) AS n_removed
FROM documents d LEFT JOIN ranked r USING (doc_id) GROUP BY d.doc_id, d.text
"""

#: The forest may miss links on large tables (recall is measured in tests); at the size of the oracle run one leaf holds all vectors.
EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
node AS (SELECT vec_id AS id FROM v),
{COMPONENTS},
degree AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(degree.n, 0) AS n_links, smallest.component AS component_id, v.vec_id = smallest.component AS kept
FROM v JOIN smallest ON smallest.id = v.vec_id LEFT JOIN degree ON degree.vec_id = v.vec_id
"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
known AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least_id AS (SELECT text, min(doc_id) AS m FROM d GROUP BY text),
f AS (
  SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN d.doc_id > least_id.m THEN 16 ELSE 0 END) AS mask
  FROM d JOIN least_id ON least_id.text = d.text LEFT JOIN known ON known.doc_id = d.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
letter(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
chain AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
step AS (
  SELECT o, k, (SELECT b FROM letter WHERE l = o[k]) AS this, (SELECT coalesce(sum(b), 0)::INTEGER FROM letter WHERE position(l IN o) < k) AS before
  FROM chain, range(1, 6) t(k)),
counted AS (
  SELECT part, o, k, this,
    coalesce(sum(n) FILTER (mask & (before | this) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & this <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & this <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = this), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & this <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & this <> 0), 0) AS toxic_lost
  FROM cell, step GROUP BY part, o, k, this)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, this))::BIGINT AS shapley
FROM counted
"""


def _round(k: int) -> str:
    """Assignment to the centroids c{k-1} and their successors c{k}."""
    return f"""
a{k} AS (
  SELECT r, min_by(no, (d, no)) AS no FROM (
    SELECT v.r, c.no, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k - 1} c)
  GROUP BY r),
m{k} AS (
  SELECT no, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT no, i, sum(x) AS s, count(*) AS n FROM (SELECT a.no, unnest(v.v) AS x, unnest(range(len(v.v))) AS i FROM v JOIN a{k} a ON a.r = v.r) GROUP BY no, i)
  GROUP BY no),
c{k} AS (SELECT c.no, coalesce(m.v, c.v) AS v FROM c{k - 1} c LEFT JOIN m{k} m ON m.no = c.no)"""


CENTROIDS = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS no, v FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT 16)),
{_round(1)},
{_round(2)},
{_round(3)},
last AS (
  SELECT r, min_by(no, (d, no)) AS no, min(d) AS d FROM (
    SELECT v.r, c.no, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c3 c)
  GROUP BY r)
SELECT v.vec_id, CAST(last.no AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY last.no) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM last JOIN v ON v.r = last.r JOIN c3 ON c3.no = last.no
"""
