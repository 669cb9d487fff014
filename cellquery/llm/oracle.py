"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_FOLDED = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

MIX = f"""
WITH d AS (
  SELECT doc_id, coalesce(len({_WORDS}), 0)::BIGINT AS size, source,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0.0) AS capped,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w
           RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s
), level AS (
  SELECT budget - capped AS rest, open_weight FROM r
  WHERE (budget - capped) / open_weight < cap / w ORDER BY cap / w LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN rest IS NULL OR cap <= w * (rest / open) THEN cap ELSE least(w * rest / open, cap) END AS target
  FROM (SELECT r.source, r.source_size, r.cap, r.w,
               (SELECT rest FROM level) AS rest, (SELECT open_weight FROM level) AS open FROM r)
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), g AS (
  SELECT source, h, sum(size) AS own,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
), k AS (
  SELECT g.source, g.h, CASE
           WHEN g.upto <= target - whole * source_size::DOUBLE THEN 1
           WHEN g.upto - g.own <= target - whole * source_size::DOUBLE
             AND g.upto - (target - whole * source_size::DOUBLE)
               < (target - whole * source_size::DOUBLE) - (g.upto - g.own) THEN 1
           ELSE 0 END AS extra
  FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source
)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (CASE WHEN d.size > 0 THEN least(n.whole + k.extra, 2) ELSE 0 END * d.size)::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
w AS (
  SELECT doc_id, words[p] AS word, p, len(words) AS n,
         CASE WHEN p + 19 <= len(words) THEN array_to_string(words[p : p + 19], ' ') END AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d)
), f AS (
  SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS again FROM w
), c AS (
  SELECT doc_id, word, p, max(again::INT) OVER (
           PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
), k AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

HITS = f"""
WITH i AS (SELECT item_id, {_FOLDED} AS words FROM benchmark WHERE text IS NOT NULL),
v AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
         array_to_string(words[p : p + least(len(words), 10) - 1], ' ') AS run
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS p FROM i WHERE len(words) > 0)
), d AS (SELECT doc_id, coalesce({_FOLDED}, []) AS words FROM documents),
m AS (
  SELECT doc_id, p, n, array_to_string(words[p : p + n - 1], ' ') AS run
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM v))
), h AS (SELECT m.doc_id, m.p, m.n, v.item_id FROM m JOIN v USING (n, run)),
c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def _integers(scale: int, columns: str, condition: str = "true") -> str:
    """Rows whose vectors are whole, with integer components."""
    return f"""SELECT {columns}, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND {condition}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


TOP_PRODUCTS = f"""
WITH r AS ({_integers(1024, "vec_id")}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10
"""

NEGATIVES = f"""
WITH r AS ({_integers(256, "vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "label IS NOT NULL")}),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same)
  WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _round(at: int) -> str:
    """The assignment ``a{at}`` to the centroids ``c{at}``."""
    return f"""a{at} AS (
  SELECT vec_id, arg_min(k, d) AS k, min(d) AS d FROM (
    SELECT r.vec_id, c.k, list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 1000 + c.k AS d
    FROM r CROSS JOIN c{at} c) GROUP BY vec_id
)"""


def _moved(at: int) -> str:
    """The centroids ``c{at}`` after the assignment before."""
    return f"""m{at} AS (
  SELECT k, list(f ORDER BY j) AS v FROM (
    SELECT a.k, j, floor(sum(r.v[j]::BIGINT) / count(*))::DOUBLE AS f
    FROM a{at - 1} a JOIN r USING (vec_id), (SELECT unnest(range(1, 65)) AS j) GROUP BY a.k, j) GROUP BY k
), c{at} AS (SELECT k, coalesce(m{at}.v, c{at - 1}.v) AS v FROM c{at - 1} LEFT JOIN m{at} USING (k))"""


CLUSTERS = f"""
WITH r AS ({_integers(64, "vec_id", "len(embedding) = 64")}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM r ORDER BY h LIMIT 16)
), {_round(0)}, {_moved(1)}, {_round(1)}, {_moved(2)}, {_round(2)}, {_moved(3)}, {_round(3)},
f AS (SELECT vec_id, k, (d // 1000)::BIGINT AS distance FROM a3)
SELECT f.vec_id, f.k::INT AS cluster, f.distance,
       (sum(f.distance) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(f.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c3.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM f JOIN c3 USING (k)
"""
