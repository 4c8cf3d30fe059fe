"""DuckDB SQL with the results of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

#: Target shares, size classes, Pareto ranks from the same MD5 digests, and the cut by a running sum over each source.
MIXING = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
    (('0x' || left(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), md5(coalesce(text, '')))), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
classed AS (SELECT *, CASE WHEN size > 0 THEN 1::BIGINT << (length(bin(size)) - 1)::BIGINT ELSE 0 END AS class FROM base),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM sizes),
weighted AS (SELECT *, ((sid - 1) % 3 + 1)::BIGINT AS weight FROM numbered),
open_ AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER up, 0))::DOUBLE AS left_,
    (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0))::DOUBLE AS weights
  FROM weighted WINDOW up AS (ORDER BY source_size::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, bool_and(weight * (left_ / weights) > 3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, sid ROWS UNBOUNDED PRECEDING) AS full_ FROM open_),
aimed AS (SELECT c.*, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE coalesce(weight * s.share, 0) END AS target
  FROM capped c LEFT JOIN (SELECT left_ / weights AS share FROM capped WHERE NOT full_ ORDER BY source_size::DOUBLE / weight, sid LIMIT 1) s ON true),
sure AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS certain FROM aimed),
plan AS (SELECT *, target - certain * source_size AS wanted FROM sure),
classes AS (SELECT p.sid, b.class, p.wanted, sum(b.size)::BIGINT AS words FROM classed b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source GROUP BY ALL),
masses AS (SELECT *, wanted - coalesce(sum(words) OVER (PARTITION BY sid ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(class * words) OVER (PARTITION BY sid ORDER BY class ROWS UNBOUNDED PRECEDING) AS mass FROM classes),
peels AS (SELECT *, bool_and(wanted > 0 AND class > 0 AND above * class >= mass) OVER (PARTITION BY sid ORDER BY class DESC ROWS UNBOUNDED PRECEDING) AS peeled FROM masses),
rests AS (SELECT sid, arg_max(above, class) AS above, arg_max(mass, class) AS mass FROM peels WHERE NOT peeled GROUP BY sid),
chances AS (SELECT p.sid, p.class, CASE WHEN peeled THEN 1.0::DOUBLE WHEN p.class > 0 THEN greatest(r.above, 0.0) * p.class / r.mass::DOUBLE ELSE 0.0::DOUBLE END AS chance FROM peels p LEFT JOIN rests r USING (sid)),
placed AS (SELECT b.*, p.sid, p.source_size, p.target, p.certain, p.wanted,
    CASE WHEN chance > 0 THEN floor(u * (1 - chance) / (u * (1 - chance) + (1 - u) * chance) * 4503599627370496.0::DOUBLE)::BIGINT END AS place
  FROM classed b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source JOIN chances c ON c.sid = p.sid AND c.class = b.class),
running AS (SELECT sid, place, wanted, sum(size) OVER (PARTITION BY sid ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed WHERE place IS NOT NULL),
ends AS (SELECT p.sid, p.wanted, coalesce(max(place), -1) AS last, p.wanted - coalesce(max(upto), 0) AS gap FROM plan p LEFT JOIN running r ON r.sid = p.sid AND upto <= r.wanted GROUP BY p.sid, p.wanted),
closing AS (SELECT p.sid, arg_min(place, {{'off': abs(size - gap), 'place': place}}) AS closing FROM placed p JOIN ends e USING (sid) WHERE place > last AND abs(size - gap) < gap GROUP BY p.sid)
SELECT doc_id, size, source_size, target, ((certain + CASE WHEN place <= last OR place = closing THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed JOIN ends USING (sid) LEFT JOIN closing USING (sid)"""

#: Shared shingles of all pairs, and the components by a walk from every document.
NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS tokens FROM words),
sized AS (SELECT doc_id, len(tokens)::BIGINT AS n FROM sets),
occurrences AS (SELECT doc_id, unnest(tokens) AS token FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM occurrences a JOIN occurrences b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, spot) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reached r JOIN sides l ON l.a = r.spot)
SELECT doc_id, n AS n_shingles, component_id FROM sized JOIN (SELECT doc_id, min(spot) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""

#: All cosines of the queries; sums run over components in order, as the operator's do.
NEAREST = """
WITH rows_ AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
long_ AS (SELECT *, sqrt(list_dot_product(v, v)) AS length FROM rows_ WHERE list_dot_product(v, v) > 0),
scored AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.v, q.v) / (e.length * q.length) AS score
  FROM long_ q JOIN long_ e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 5"""

#: Every order carried out on the documents' failures; Shapley values as plain sums over all orders.
FILTER_AUDIT = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
judged AS (SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM worded),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
orders(filter_order, used) AS (
  SELECT '', 0::BIGINT
  UNION ALL SELECT filter_order || chr(65 + k::INT), used + (1 << k) FROM orders, range(5) r(k) WHERE (used >> k) % 2 = 0),
steps AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0)::BIGINT AS earlier
  FROM orders, range(1, 6) s(step) WHERE length(filter_order) = 5),
counted AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": MIXING, "op5_ngram_join": NGRAM_JOIN, "op7_nearest": NEAREST, "op12_filter_audit": FILTER_AUDIT}
