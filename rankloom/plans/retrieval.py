"""Retrieval, fusion and projection over documents: corpus documents, queries the benchmark items, files the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.context import materialise
from rankloom.functions import text as tx
from rankloom.functions.text import PROJECTION_STOP_WORDS
from rankloom.operators import packing, projection, ranking, retrieval
from rankloom.plans.registry import query, sql_list
from rankloom.sources.tables import table


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def lexical(spark: SparkSession, sf: str, k: int, counted: retrieval.Counted | None = None) -> DataFrame:
    top = retrieval.bm25_top(corpus(spark, sf), items(spark, sf), k, counted=counted)
    return top.select("query", F.col("doc_id").alias("key"), "rank", "score")


def overlap(spark: SparkSession, sf: str, k: int, counted: retrieval.Counted | None = None) -> DataFrame:
    """Documents by number of shared distinct tokens."""
    top = retrieval.overlap_top(corpus(spark, sf), items(spark, sf), k, counted=counted)
    return top.select("query", F.col("doc_id").alias("key"), "rank", "score")


def both(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The lexical and the overlap ranking, of one count of terms."""
    counted = retrieval.counted_terms(corpus(spark, sf), items(spark, sf))
    return lexical(spark, sf, k, counted), overlap(spark, sf, k, counted)


def with_file(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return df.join(corpus(spark, sf).select(F.col("doc_id").alias("key"), F.col("source").alias("file")), "key")


TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z_][a-z0-9_]*')"


def bm25_sql(k: int) -> str:
    return f"""
    words AS (SELECT doc_id, source, {TOKENS.format('text')} AS terms FROM documents),
    lens AS (SELECT doc_id, len(terms)::DOUBLE AS length FROM words),
    totals AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
    q AS (SELECT DISTINCT item_id AS query, unnest({TOKENS.format('text')}) AS term FROM benchmark),
    occ AS (SELECT doc_id, unnest(terms) AS term FROM words),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (SELECT q.query, tf.doc_id AS key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM tf JOIN df USING (term) JOIN q USING (term) JOIN lens USING (doc_id) CROSS JOIN totals GROUP BY ALL),
    bm AS (SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM scored) WHERE rank <= {k})"""


def overlap_sql(k: int) -> str:
    return f"""
    ow AS (SELECT DISTINCT doc_id AS key, unnest({TOKENS.format('text')}) AS term FROM documents),
    oq AS (SELECT DISTINCT item_id AS query, unnest({TOKENS.format('text')}) AS term FROM benchmark),
    ov AS (SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM (SELECT query, key, count(*) AS score FROM ow JOIN oq USING (term) GROUP BY ALL)) WHERE rank <= {k})"""


def split_terms_sql(e: str) -> str:
    stop = sql_list(PROJECTION_STOP_WORDS)
    tokens = f"list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce({e}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({stop}))"
    forms = (
        f"list_concat([t], list_filter([CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN t[:-4] END, CASE WHEN t LIKE '%ies' AND length(t) > 5 THEN t[:-4] || 'y' END, CASE WHEN t LIKE '%s' AND length(t) > 4 THEN t[:-2] END],"
        f" lambda s: s IS NOT NULL AND length(s) >= 3 AND s NOT IN ({stop})))"
    )
    return f"flatten(list_transform({tokens}, lambda t: {forms}))"


def exact_terms_sql(e: str) -> str:
    stop = sql_list(PROJECTION_STOP_WORDS)
    tokens = f"list_filter(list_transform(regexp_extract_all(coalesce({e}, ''), '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({stop}))"
    parts = f"flatten(list_transform({tokens}, lambda t: list_filter(regexp_split_to_array(t, '[._]+'), lambda p: length(p) >= 3 AND p NOT IN ({stop}))))"
    return f"list_distinct(list_concat({tokens}, {parts}))"


@query(f"WITH {bm25_sql(20)} SELECT query, key AS doc_id, score, rank FROM bm")
def bm25_top20(spark, sf):
    return lexical(spark, sf, 20).select("query", F.col("key").alias("doc_id"), "score", "rank")


@query(
    f"""WITH words AS (SELECT doc_id, source, {split_terms_sql('text')} AS terms FROM documents),
    lens AS (SELECT doc_id, source, len(terms)::DOUBLE AS length FROM words),
    totals AS (SELECT source, count(*) AS n, CASE WHEN avg(length) = 0 THEN 1 ELSE avg(length) END AS mean FROM lens GROUP BY source),
    q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({split_terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
    tf AS (SELECT doc_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
    scored AS (SELECT query, source, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM tf JOIN df USING (source, term) JOIN q USING (term) JOIN lens USING (doc_id, source) JOIN totals USING (source) GROUP BY ALL)
    SELECT query, source, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc_id)::INT AS rank FROM scored) WHERE rank <= 3"""
)
def bm25_query_tf(spark, sf):
    top = retrieval.bm25_top(corpus(spark, sf), items(spark, sf), 3, tx.split_terms, retrieval.SELECTOR_K1, query_frequency=True, pool="source")
    return top.select("query", "source", "doc_id", "score", "rank")


def vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label"), rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


DENSE = """dense AS (SELECT q.vec_id AS query, e.vec_id AS key, e.label AS file, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {DENSE} SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM dense) WHERE rank <= 20")
def dense_top20(spark, sf):
    data, asked = vectors(spark, sf)
    return retrieval.dense_top(data, asked, 20).select("query", "key", "score", "rank")


@query(
    f"""WITH {DENSE}, files AS (SELECT query, file, max(score) AS fs, count(*) AS c FROM dense GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fs DESC, file)::INT AS file_rank FROM files),
    taken AS (SELECT * FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY query ORDER BY file_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked) WHERE before < 20 OR file_rank <= 2)
    SELECT query, file, key, score, file_rank, rank FROM (SELECT d.query, d.file, key, score, file_rank, row_number() OVER (PARTITION BY d.query ORDER BY score DESC, key)::INT AS rank FROM dense d JOIN taken t ON d.query = t.query AND d.file = t.file) WHERE rank <= 20"""
)
def dense_filefirst(spark, sf):
    data, asked = vectors(spark, sf)
    return retrieval.dense_file_first(data.withColumnRenamed("label", "file"), asked, 20, 2).select("query", "file", "key", "score", "file_rank", "rank")


RRF2 = """united AS (SELECT query, key, 0 AS spot, rank, 1.0::DOUBLE / (60 + rank) AS part FROM bm UNION ALL SELECT query, key, 1, rank, {w}::DOUBLE / (60 + rank) FROM ov),
    fused AS (SELECT query, key, sum(part ORDER BY spot) AS score, count(*)::INT AS present, min(rank) AS best_rank, min(spot) AS first_source FROM united GROUP BY ALL),
    rrf AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, present DESC, best_rank, first_source, key)::INT AS rank FROM fused)"""


@query(f"WITH {bm25_sql(200)}, {overlap_sql(200)}, {RRF2.format(w='1.0')} SELECT query, key, round(score, 9) AS score, present, best_rank, rank FROM rrf WHERE rank <= 20")
def hybrid_rrf(spark, sf):
    return retrieval.hybrid(*both(spark, sf, 200), limit=20).select("query", "key", F.round("score", 9).alias("score"), "present", "best_rank", "rank")


@query(
    f"""WITH {bm25_sql(50)}, {overlap_sql(50)},
    third AS (SELECT b.item_id AS query, d.doc_id AS key, row_number() OVER (PARTITION BY b.item_id ORDER BY abs(length(d.text) - length(b.text)), d.doc_id)::INT AS rank FROM benchmark b, documents d),
    united AS (SELECT query, key, 0 AS spot, rank, 1.0::DOUBLE / (60 + rank) AS part FROM bm UNION ALL SELECT query, key, 1, rank, 0.5::DOUBLE / (60 + rank) FROM ov UNION ALL SELECT query, key, 2, rank, 0.25::DOUBLE / (60 + rank) FROM third WHERE rank <= 50),
    fused AS (SELECT query, key, sum(part ORDER BY spot) AS score, count(*)::INT AS present, min(rank) AS best_rank, min(spot)::INT AS first_source FROM united GROUP BY ALL)
    SELECT query, key, round(score, 9) AS score, present, best_rank, first_source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, present DESC, best_rank, first_source, key)::INT AS rank FROM fused) WHERE rank <= 20"""
)
def multi_rrf_weighted(spark, sf):
    lengths = corpus(spark, sf).select(F.col("doc_id").alias("key"), F.length("text").alias("value"))
    third = retrieval.nearest_values(lengths, items(spark, sf).select("query", F.length("text").alias("value")), 50)
    by_terms, by_overlap = both(spark, sf, 50)
    fused = ranking.reciprocal_rank_fusion([("lexical", by_terms), ("overlap", by_overlap), ("length", third)], {"lexical": 1.0, "overlap": 0.5, "length": 0.25}, limit=20)
    return fused.select("query", "key", F.round("score", 9).alias("score"), "present", "best_rank", "first_source", "rank")


@query(
    f"""WITH {bm25_sql(50)}, {overlap_sql(50)},
    f1 AS (SELECT query, source AS file, row_number() OVER (PARTITION BY query ORDER BY min(rank), source)::INT AS rank FROM bm JOIN documents ON doc_id = key GROUP BY query, source),
    f2 AS (SELECT query, source AS file, row_number() OVER (PARTITION BY query ORDER BY min(rank), source)::INT AS rank FROM ov JOIN documents ON doc_id = key GROUP BY query, source),
    united AS (SELECT query, file, 0 AS spot, rank, 1.0::DOUBLE / (60 + rank) AS part FROM f1 UNION ALL SELECT query, file, 1, rank, 1.0::DOUBLE / (60 + rank) FROM f2),
    fused AS (SELECT query, file, sum(part ORDER BY spot) AS score, count(*)::INT AS present, min(rank) AS best_rank FROM united GROUP BY ALL)
    SELECT query, file, round(score, 9) AS score, present, best_rank, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, present DESC, best_rank, file)::INT AS rank FROM fused"""
)
def file_rrf_seeds(spark, sf):
    files = lambda df: projection.ranked_file_seeds(with_file(df, spark, sf), 10**6, 50).select("query", "file", F.col("file_rank").alias("rank"))
    fused = ranking.file_fusion([(name, files(df)) for name, df in zip(("lexical", "overlap"), both(spark, sf, 50), strict=True)])
    return fused.select("query", "file", F.round("score", 9).alias("score"), "present", "best_rank", "rank")


@query(
    f"""WITH {bm25_sql(30)}, {overlap_sql(30)}
    SELECT query, key, native_rank, projected_rank, row_number() OVER (PARTITION BY query ORDER BY least(coalesce(native_rank, 9999), coalesce(projected_rank, 9999)), native_rank IS NULL, coalesce(native_rank, 9999), coalesce(projected_rank, 9999), key)::INT AS rank
    FROM (SELECT coalesce(bm.query, ov.query) AS query, coalesce(bm.key, ov.key) AS key, bm.rank AS native_rank, ov.rank AS projected_rank FROM bm FULL JOIN ov ON bm.query = ov.query AND bm.key = ov.key)"""
)
def min_rank_union(spark, sf):
    return ranking.min_rank_union(*both(spark, sf, 30)).select("query", "key", "native_rank", "projected_rank", "rank")


@query(
    f"""WITH {bm25_sql(30)}, {overlap_sql(30)},
    rows_ AS (SELECT query, key, min({{'source': source, 'rank': rank}}) AS spot FROM (SELECT query, key, 0 AS source, rank FROM bm WHERE rank <= 10 UNION ALL SELECT query, key, 1, rank FROM ov) GROUP BY ALL)
    SELECT query, key, source, rank, round(2.0 - 0.01 * (rank - 1), 6)::DOUBLE AS similarity FROM (SELECT query, key, spot.source AS source, row_number() OVER (PARTITION BY query ORDER BY spot.source, spot.rank, key)::INT AS rank FROM rows_) WHERE rank <= 20"""
)
def fixed_prefix_fill(spark, sf):
    return ranking.prefix_fill(*both(spark, sf, 30), 20).select("query", "key", "source", "rank", "similarity")


@query(
    f"""WITH {bm25_sql(30)}, {overlap_sql(30)},
    rows_ AS (SELECT query, key, min({{'rank': rank, 'source': source}}) AS spot FROM (SELECT query, key, 0 AS source, rank FROM bm UNION ALL SELECT query, key, 1, rank FROM ov) GROUP BY ALL)
    SELECT query, key, spot.rank AS depth, spot.source AS source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY spot.rank, spot.source, key)::INT AS rank FROM rows_) WHERE rank <= 20"""
)
def round_robin_fill(spark, sf):
    return ranking.round_robin(list(both(spark, sf, 30)), 20).select("query", "key", "depth", "source", "rank")


@query(
    f"""WITH {bm25_sql(50)} SELECT query, file, first_rank, support, file_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY first_rank, file)::INT AS file_rank
    FROM (SELECT query, source AS file, min(rank) AS first_rank, count(*) AS support FROM bm JOIN documents ON doc_id = key GROUP BY ALL)) WHERE file_rank <= 10"""
)
def ranked_file_seeds(spark, sf):
    return projection.ranked_file_seeds(with_file(lexical(spark, sf, 50), spark, sf), 10, 50).select("query", "file", "first_rank", "support", "file_rank")


def described(spark, sf):
    """Entities, issue terms and ranked files: entities are documents (first line: name and signature; the rest: source), files their
    sources; an item's first sentence is its title."""
    docs = corpus(spark, sf)
    line = F.split("text", "\n")
    head, rest = F.element_at(line, 1), F.array_join(F.slice(line, F.lit(2), F.size(line)), "\n")
    entities = docs.select(F.col("source").alias("file"), head.alias("name"), head.alias("signature"), rest.alias("source"), F.col("doc_id").cast("int").alias("start_line"))
    parts = items(spark, sf).select("query", F.substring_index("text", ".", 1).alias("title"), "text")
    terms = tx.section_terms(tx.sections(parts, "query", F.col("title"), F.col("text")))
    files = projection.ranked_file_seeds(with_file(lexical(spark, sf, 20), spark, sf), 5, 20).select("query", "file", F.col("file_rank").alias("best_rank"))
    return entities, terms, materialise(files, "ranked-files")


def _sx(e: str) -> str:
    return split_terms_sql(e)


FEATURES_SQL = f"""{bm25_sql(20)},
    files AS (SELECT query, file, file_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY first_rank, file)::INT AS file_rank FROM (SELECT query, source AS file, min(rank) AS first_rank FROM bm JOIN documents ON doc_id = key GROUP BY ALL)) WHERE file_rank <= 5),
    ent AS (SELECT source AS file, string_split(text, chr(10))[1] AS name, string_split(text, chr(10))[1] AS signature, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS src, doc_id::INT AS start_line FROM documents),
    des AS (SELECT *, list_distinct({_sx("concat_ws(chr(10), name, signature, file)")}) AS symbol_terms, {exact_terms_sql("concat_ws(chr(10), name, signature, file)")} AS symbol_exact, list_distinct({_sx('src')}) AS source_terms, {exact_terms_sql('src')} AS source_exact FROM ent WHERE file IN (SELECT file FROM files)),
    it AS (SELECT item_id AS query, split_part(text, '.', 1) AS title, text FROM benchmark),
    raw AS (SELECT *, array_to_string(regexp_extract_all(concat_ws(chr(10), title, text), '`([^`]+)`', 1), ' ') AS spans, array_to_string(regexp_extract_all(text, '[''"]([A-Za-z_][A-Za-z0-9_.-]+)[''"]', 1), ' ') AS quoted FROM it),
    terms AS (SELECT query, list_distinct({_sx('title')}) AS title_terms, list_distinct({_sx('text')}) AS narrative_terms, list_distinct(list_concat(list_concat({_sx('title')}, {_sx('text')}), list_concat({_sx('spans')}, {_sx('quoted')}))) AS issue_terms,
      list_distinct(list_concat(list_concat({exact_terms_sql('title')}, {exact_terms_sql('spans')}), list_concat({exact_terms_sql('quoted')}, list_filter({exact_terms_sql('text')}, lambda t: contains(t, '_') OR contains(t, '.'))))) AS exact_terms FROM raw),
    feat AS (SELECT query, d.file, file_rank, name, signature, start_line, len(list_intersect(title_terms, symbol_terms)) AS title_symbol, len(list_intersect(title_terms, source_terms)) AS title_source,
      len(list_intersect(exact_terms, symbol_exact)) AS exact_symbol, len(list_intersect(exact_terms, source_exact)) AS exact_source, len(list_intersect(narrative_terms, symbol_terms)) AS narrative_symbol, len(list_intersect(narrative_terms, source_terms)) AS narrative_source
      FROM files JOIN des d USING (file) JOIN terms USING (query))"""


@query(
    f"""WITH {FEATURES_SQL}
    SELECT query, start_line, title_symbol, title_source, exact_symbol, exact_source, file_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY title_symbol DESC, title_source DESC, exact_symbol DESC, exact_source DESC, file_rank, start_line, name)::INT AS rank FROM feat) WHERE rank <= 20"""
)
def entity_projection(spark, sf):
    ranked = projection.best_projected(*described(spark, sf), 20, "start_line")
    counts = ["title_symbol", "title_source", "exact_symbol", "exact_source"]
    return ranked.select("query", "start_line", *[F.col(c).cast("long").alias(c) for c in counts], "file_rank", "rank")


@query(
    f"""WITH {FEATURES_SQL},
    v AS (SELECT query, start_line AS key, signature, file_rank, start_line, title_symbol + narrative_symbol AS overlap, title_source + narrative_source AS bm25, round(3.0 * (title_symbol + title_source) + 4.0 * (exact_symbol + exact_source) + narrative_symbol + narrative_source - 0.05 * file_rank, 9) AS fs FROM feat),
    r AS (SELECT query, key, 'file_source_order' AS variant, row_number() OVER (PARTITION BY query ORDER BY file_rank, start_line, signature)::INT AS rank FROM v
      UNION ALL SELECT query, key, 'file_name_overlap', row_number() OVER (PARTITION BY query ORDER BY file_rank, overlap DESC, start_line, signature)::INT FROM v
      UNION ALL SELECT query, key, 'file_bm25', row_number() OVER (PARTITION BY query ORDER BY file_rank, bm25 DESC, start_line, signature)::INT FROM v
      UNION ALL SELECT query, key, 'weighted_features', row_number() OVER (PARTITION BY query ORDER BY fs DESC, file_rank, start_line, signature)::INT FROM v
      UNION ALL SELECT query, key, 'stable_random', row_number() OVER (PARTITION BY query ORDER BY sha256(query || '|' || key))::INT FROM v
      UNION ALL SELECT query, key, 'round_robin_bm25', row_number() OVER (PARTITION BY query ORDER BY depth, file_rank, bm25 DESC, start_line, signature)::INT FROM (SELECT *, row_number() OVER (PARTITION BY query, file_rank ORDER BY bm25 DESC, start_line, signature) AS depth FROM v))
    SELECT query, key, variant, rank FROM r WHERE rank <= 20"""
)
def selector_variants(spark, sf):
    return projection.best_selected(*described(spark, sf), 20).select("query", "key", "variant", "rank")


@query(f"SELECT doc_id, array_to_string({split_terms_sql('text')}, ' ') AS terms, array_to_string(list_sort({exact_terms_sql('text')}), ' ') AS exact FROM documents")
def identifier_terms(spark, sf):
    t = F.col("text")
    return corpus(spark, sf).select("doc_id", F.array_join(tx.split_terms(t), " ").alias("terms"), F.array_join(F.array_sort(tx.exact_terms(t)), " ").alias("exact"))


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
    d AS (SELECT *, max(CASE WHEN line LIKE 'Le%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n ROWS UNBOUNDED PRECEDING) AS late FROM l)
    SELECT conv_id, turn, count(*) AS lines, sum(late)::BIGINT AS late_lines FROM d GROUP BY ALL"""
)
def carried_sections(spark, sf):
    """Lines from the first marked one on, per text: the state that a traceback carries to all later lines."""
    from pyspark.sql import Window

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    late = F.max(F.col("line").startswith("Le").cast("int")).over(Window.partitionBy("conv_id", "turn").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("late", late).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("lines"), F.sum("late").alias("late_lines"))


@query(
    f"""WITH {bm25_sql(50)}, t AS (SELECT query, key, rank, ceil(length(text) / 4)::BIGINT AS tokens FROM bm JOIN documents ON doc_id = key),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM t)
    SELECT query, budget::INT AS budget, candidates, coalesce(selected, 0) AS selected, coalesce(used, 0)::BIGINT AS used, round(coalesce(used, 0) / budget, 6) AS fill
    FROM (SELECT query, count(*) AS candidates FROM t GROUP BY query) CROSS JOIN (SELECT unnest([2000, 4000, 8000]) AS budget) LEFT JOIN (SELECT query, budget, count(*) AS selected, max(total) AS used FROM s CROSS JOIN (SELECT unnest([2000, 4000, 8000]) AS budget) WHERE total <= budget GROUP BY ALL) USING (query, budget)"""
)
def pack_prefix(spark, sf):
    ranked = lexical(spark, sf, 50).join(corpus(spark, sf).select(F.col("doc_id").alias("key"), tx.token_proxy(F.col("text")).alias("tokens")), "key")
    budgets = [2000, 4000, 8000]
    return packing.pack_summary(packing.pack_prefix(ranked, budgets), ranked, budgets).select("query", "budget", "candidates", "selected", "used", "fill")


@query(
    f"""WITH {bm25_sql(40)}, r AS (SELECT query, key, source AS file, rank, CASE WHEN rank <= 10 THEN 'primary' ELSE 'tail' END AS band FROM bm JOIN documents ON doc_id = key),
    f AS (SELECT *, row_number() OVER (PARTITION BY query, band, file ORDER BY rank) AS nth FROM r)
    SELECT query, key, file, rank, band, position FROM (SELECT *, row_number() OVER (PARTITION BY query, band ORDER BY rank)::INT AS position FROM f WHERE nth <= 2) WHERE position <= 4"""
)
def rank_banded(spark, sf):
    return packing.rank_bands(with_file(lexical(spark, sf, 40), spark, sf).select("query", "key", "file", "rank"))


@query(
    f"""WITH {bm25_sql(20)}, f AS (SELECT query, key, rank, source AS file FROM bm JOIN documents ON doc_id = key)
    SELECT query, key, file, row_number() OVER (PARTITION BY query ORDER BY o, lr)::INT AS rank FROM (SELECT query, key, file, rank AS lr, min(rank) OVER (PARTITION BY query, file) AS o FROM f)"""
)
def file_primary_order(spark, sf):
    return ranking.file_primary(with_file(lexical(spark, sf, 20), spark, sf)).select("query", "key", "file", "rank")


@query(
    f"""WITH {bm25_sql(5)}, a AS (SELECT query, key, source AS file FROM bm JOIN documents ON doc_id = key),
    p AS (SELECT DISTINCT a.query, d.doc_id AS key, a.file, min(abs(d.doc_id - a.key)) AS gap FROM a JOIN documents d ON d.source = a.file WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.query = a.query AND b.key = d.doc_id) GROUP BY a.query, d.doc_id, a.file)
    SELECT query, key, file, gap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gap, file, key)::INT AS rank FROM p) WHERE rank <= 20"""
)
def neighbor_tail(spark, sf):
    place = lambda df: df.withColumn("start_line", F.col("key")).withColumn("end_line", F.col("key"))
    anchors = place(with_file(lexical(spark, sf, 5), spark, sf)).select("query", "key", "file", "start_line", "end_line")
    pool = place(corpus(spark, sf).select(F.col("doc_id").alias("key"), F.col("source").alias("file")))
    return ranking.same_file_top(materialise(anchors, "anchors"), pool, 20).select("query", "key", "file", "gap", "rank")
