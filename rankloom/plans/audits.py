"""Audits and stored structures: expectations, the inverted index, line provenance, temporal provenance, prompt coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.context import materialise, scratch
from rankloom.operators import audit, expectations, inverted_index, linking, packing
from rankloom.plans.evaluation import EVAL_SQL, targets
from rankloom.plans.registry import query
from rankloom.plans.retrieval import bm25_sql, both, corpus, items, lexical, overlap_sql
from rankloom.sources import provenance
from rankloom.sources.tables import table


@query(
    """WITH t(name, expectation, rows_, failed, value, ok) AS (
      SELECT 'orders', 'o_orderkey is not null', count(*), count(*) FILTER (o_orderkey IS NULL), NULL::DOUBLE, bool_and(o_orderkey IS NOT NULL) FROM orders
      UNION ALL SELECT 'orders', 'o_orderstatus is known', count(*), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), NULL, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders
      UNION ALL SELECT 'orders', 'o_totalprice is in range', count(*), count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 400000), NULL, count(*) FILTER (o_totalprice BETWEEN 1000 AND 400000) >= 0.9 * count(*) FROM orders
      UNION ALL SELECT 'orders', 'mean price', count(*), NULL, avg(o_totalprice), avg(o_totalprice) BETWEEN 1 AND 1000000 FROM orders
      UNION ALL SELECT 'lineitem', 'l_returnflag has its form', count(*), count(*) FILTER (NOT regexp_matches(l_returnflag, '^[ANR]$')), NULL, count(*) FILTER (NOT regexp_matches(l_returnflag, '^[ANR]$')) = 0 FROM lineitem
      UNION ALL SELECT 'lineitem', 'discounted price is positive', count(*), count(*) FILTER (NOT l_extendedprice * (1 - l_discount) > 0), NULL, count(*) FILTER (NOT l_extendedprice * (1 - l_discount) > 0) = 0 FROM lineitem
      UNION ALL SELECT 'lineitem', 'half of the lines are small', count(*), count(*) FILTER (NOT l_quantity < 20), NULL, count(*) FILTER (l_quantity < 20) >= 0.5 * count(*) FROM lineitem
      UNION ALL SELECT 'lineitem', 'numbers of a line', count(*), NULL, max(l_linenumber)::DOUBLE, max(l_linenumber) <= 7 FROM lineitem)
    SELECT name AS "table", expectation, rows_ AS "rows", failed, round(value, 4) AS value, ok FROM t"""
)
def table_expectations(spark, sf):
    """Eight expectations of two tables, each table read once."""
    e = expectations
    orders = [e.not_null("o_orderkey"), e.one_of("o_orderstatus", ["F", "O"]), e.between("o_totalprice", F.lit(1000), F.lit(400000), 0.9), e.total("mean price", F.avg("o_totalprice"), 1, 1_000_000)]
    lines = [
        e.matches("l_returnflag", "^[ANR]$"), e.rows_where("discounted price is positive", F.col("l_extendedprice") * (1 - F.col("l_discount")) > 0),
        e.rows_where("half of the lines are small", F.col("l_quantity") < 20, 0.5), e.total("numbers of a line", F.max("l_linenumber"), high=7),
    ]
    found = e.report({"orders": (table(spark, sf, "orders"), orders), "lineitem": (table(spark, sf, "lineitem"), lines)})
    return found.withColumn("value", F.round("value", 4))


@query(
    """WITH l AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS quantity, count(*)::DOUBLE AS lines FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT k, CASE WHEN k % 7 = 0 THEN quantity + 1 ELSE quantity END AS quantity, lines FROM l WHERE k % 5 <> 0),
    e AS (SELECT coalesce(s.k, l.k) AS k, unnest(['quantity', 'lines']) AS entry, unnest([s.quantity, s.lines]) AS stated, unnest([l.quantity, l.lines]) AS found FROM s FULL JOIN l ON s.k = l.k)
    SELECT k, entry, round(stated, 2) AS stated, round(found, 2) AS found FROM e WHERE stated IS NULL OR found IS NULL OR abs(stated - found) > 1e-6"""
)
def ledger_reconciliation(spark, sf):
    """A ledger of orders with every fifth order missing and every seventh misstated, against the lines themselves."""
    actual = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    ledger = actual.where("k % 5 <> 0").withColumn("quantity", F.col("quantity") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))
    found = expectations.reconcile(ledger, actual, ["k"], ["quantity", "lines"], 1e-6)
    return found.select("k", "entry", F.round("stated", 2).alias("stated"), F.round("found", 2).alias("found"))


@query(f"WITH {bm25_sql(20)} SELECT query, key AS doc_id, score, rank FROM bm")
def indexed_top20(spark, sf):
    """BM25 from a stored index: two thirds of the documents are written, the others appended, and the index is searched."""
    path, docs = scratch(spark, "inverted-index"), corpus(spark, sf)
    inverted_index.append(docs.where("doc_id % 3 <> 0"), path)
    inverted_index.append(docs.where("doc_id % 3 = 0"), path)
    return inverted_index.search(spark, path, items(spark, sf), 20).select("query", "doc_id", "score", "rank")


def order_hunks(spark, sf):
    """Every order as a file whose lines are its commits: where they change it, how many lines go and come."""
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("position"), F.concat_ws("-", F.lit("c"), "l_partkey", "l_linenumber").alias("commit"),
        (1 + F.col("l_suppkey") % (3 * F.col("l_linenumber"))).alias("start_line"), (F.col("l_partkey") % 4).alias("old_lines"), F.col("l_quantity").cast("long").alias("new_lines"),
    )


@query()
def line_provenance(spark, sf):
    """The commit of every line of every file, replayed from its hunks."""
    return provenance.line_provenance(order_hunks(spark, sf))


_FUSED = """{n}u AS (SELECT query, key, 0 AS spot, rank, 1.0::DOUBLE / (60 + rank) AS part FROM bm UNION ALL SELECT query, key, 1, rank, 1.0::DOUBLE / (60 + rank) FROM {ov}),
    {n}f AS (SELECT query, key, sum(part ORDER BY spot) AS score, count(*) AS present, min(rank) AS best_rank, min(spot) AS first_source FROM {n}u GROUP BY ALL),
    {n}r AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, present DESC, best_rank, first_source, key) AS rank FROM {n}f),
    {n}d AS (SELECT query, string_agg(key::VARCHAR, chr(10) ORDER BY rank) FILTER (rank <= 20) AS top20, string_agg(key::VARCHAR, chr(10) ORDER BY rank) FILTER (rank <= 50) AS top50 FROM {n}r GROUP BY query)"""


@query(
    f"""WITH {bm25_sql(50)}, {overlap_sql(50)},
    art AS (SELECT (CASE WHEN o_orderkey % 2 = 0 THEN 'issue#' ELSE 'pr#' END) || o_orderkey AS artifact, o_orderdate AS created, modified FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS modified FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
    cut AS (SELECT item_id AS query, TIMESTAMP '1993-01-01' + INTERVAL 1 DAY * (item_id % 50 * 50) AS cutoff FROM benchmark),
    st AS (SELECT query, key, rank, (CASE WHEN key % 2 = 0 THEN 'issue#' ELSE 'pr#' END) || key AS node FROM ov),
    jd AS (SELECT st.*, CASE WHEN key % 3 = 0 AND NOT coalesce(created <= cutoff AND modified <= cutoff, false) THEN 1 ELSE 0 END AS barred FROM st JOIN cut USING (query) LEFT JOIN art ON node = artifact),
    kept AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM jd WHERE barred = 0),
    {_FUSED.format(n='a', ov='ov')}, {_FUSED.format(n='b', ov='kept')},
    own AS (SELECT query, count(*) FILTER (key % 3 = 0) AS history_rows, sum(barred) AS ineligible_rows FROM jd GROUP BY query)
    SELECT query, coalesce(history_rows, 0)::BIGINT AS history_rows, coalesce(ineligible_rows, 0)::BIGINT AS ineligible_rows, coalesce(ineligible_rows, 0)::BIGINT AS history_only,
      coalesce(ad.top20 = bd.top20, ad.top20 IS NULL AND bd.top20 IS NULL) AS same_top20, coalesce(ad.top50 = bd.top50, ad.top50 IS NULL AND bd.top50 IS NULL) AS same_top50, sha256(ad.top20) AS current_digest, sha256(bd.top20) AS strict_digest
    FROM cut LEFT JOIN own USING (query) LEFT JOIN ad USING (query) LEFT JOIN bd USING (query)"""
)
def temporal_provenance(spark, sf):
    """Documents of a ranking stand for orders: every third one's path goes through the order, which is dated by its dates."""
    name = lambda k: F.concat(F.when(k % 2 == 0, "issue#").otherwise("pr#"), k.cast("string"))
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("modified"))
    artifacts = table(spark, sf, "orders").join(ships, "o_orderkey").select(name(F.col("o_orderkey")).alias("artifact"), F.col("o_orderdate").alias("created"), "modified")
    cutoffs = items(spark, sf).select("query", F.expr("TIMESTAMP '1993-01-01 00:00:00' + make_dt_interval(CAST(query % 50 * 50 AS INT))").alias("cutoff"))
    by_terms, by_overlap = both(spark, sf, 50)
    structural = by_overlap.withColumn("nodes", F.when(F.col("key") % 3 == 0, F.array(name(F.col("key")))))
    bm = materialise(by_terms.select("query", "key", "rank"), "lexical")
    return audit.temporal_provenance(structural, artifacts, cutoffs, [("lexical", bm)], [])


_BLOCK = "'- signature : ' || sig || chr(10) || '- start_line : ' || key || chr(10) || '- end_line : ' || (key + 5) || chr(10)"


@query(
    f"""WITH {EVAL_SQL},
    shown AS (SELECT variant, instance, rank, key, source AS file, trim(replace(string_split(text, chr(10))[1], chr(13), '')) AS sig FROM (SELECT 'lexical' AS variant, query AS instance, rank, key FROM bm UNION ALL SELECT 'overlap', query, rank, key FROM ov) JOIN documents ON doc_id = key WHERE rank <= 8),
    texts AS (SELECT variant, instance, count(*) AS rendered, count(*) FILTER (key % 2 = 0) AS with_source, string_agg({_BLOCK} || CASE WHEN key % 2 = 0 THEN '- source_authority : base' || chr(10) ELSE '' END, '' ORDER BY rank) AS text FROM shown GROUP BY ALL),
    mtc AS (SELECT variant, shown.instance, count(DISTINCT target) AS matched FROM shown JOIN tg ON shown.instance = tg.instance AND shown.file = tg.file AND (tg.key IS NULL OR tg.key = shown.key) WHERE shown.key % 2 = 0 GROUP BY ALL),
    wt AS (SELECT instance, count(DISTINCT target) AS target_count FROM tg GROUP BY instance)
    SELECT variant, instance, rendered, with_source, target_count, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / target_count, 6) AS coverage, (coalesce(matched, 0) > 0)::INT AS hit, (coalesce(matched, 0) = target_count)::INT AS complete,
      ceil(length(text) / 4)::BIGINT AS tokens, sha256(text) AS digest FROM texts JOIN wt USING (instance) LEFT JOIN mtc USING (variant, instance)"""
)
def prompt_coverage(spark, sf):
    """Prompts of two rankings' first eight documents, every second one with its source, read back from their text."""
    docs = corpus(spark, sf).select(F.col("doc_id").alias("key"), F.col("source").alias("file"), F.trim(F.replace(F.element_at(F.split("text", "\n"), 1), F.lit("\r"), F.lit(""))).alias("signature"))
    ranked = [df.where("rank <= 8").select(F.lit(n).alias("variant"), F.col("query").alias("instance"), "rank", "key") for n, df in zip(("lexical", "overlap"), both(spark, sf, 50), strict=True)]
    shown = materialise(ranked[0].unionByName(ranked[1]).join(docs, "key"), "shown")
    authority = F.when(F.col("key") % 2 == 0, "- source_authority : base\n").otherwise("")
    block = F.concat(F.lit("- signature : "), "signature", F.lit("\n- start_line : "), F.col("key").cast("string"), F.lit("\n- end_line : "), (F.col("key") + 5).cast("string"), F.lit("\n"), authority)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "")
    prompts = shown.groupBy("variant", "instance").agg(text.alias("text"))
    methods = shown.select(
        "variant", "instance", F.col("key").alias("id"), F.col("rank").alias("ordinal"), "signature", F.col("key").alias("start_line"), (F.col("key") + 5).alias("end_line"), "file",
        F.lit("function").alias("kind"), F.col("key").cast("string").alias("name"),
    )
    return audit.prompt_coverage(prompts, methods, targets(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query(
    """WITH w AS (SELECT *, lower(p_type) AS pkg, upper(left(string_split(p_name, ' ')[-1], 1)) || substr(string_split(p_name, ' ')[-1], 2) AS cls FROM part),
    f AS (SELECT DISTINCT p_brand AS g, 'm' || (p_size % 3) || '/src/main/java' AS root, pkg, cls FROM w),
    n AS (SELECT DISTINCT p_brand AS g, CASE p_partkey % 4 WHEN 0 THEN cls || '.make' WHEN 1 THEN 'org.' || pkg WHEN 2 THEN 'org.' || pkg || '.' || cls || '.make' ELSE 'org.none.' || cls || '$Inner' END AS name, CASE WHEN p_partkey % 4 IN (0, 3) THEN NULL ELSE pkg END AS pkg, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE cls END AS cls FROM w),
    exact AS (SELECT g, name, 'file' AS kind, root || '/org/' || n.pkg || '/' || n.cls || '.java' AS path FROM n JOIN f USING (g, pkg, cls)),
    packages AS (SELECT DISTINCT g, name, 'package' AS kind, root || '/org/' || pkg AS path FROM n JOIN f USING (g, pkg) WHERE n.cls IS NULL),
    stems AS (SELECT g, name, 'file' AS kind, root || '/org/' || f.pkg || '/' || cls || '.java' AS path FROM n JOIN f USING (g, cls) WHERE (g, name) NOT IN (SELECT (g, name) FROM exact))
    SELECT * FROM exact UNION SELECT * FROM packages UNION SELECT * FROM stems"""
)
def type_files(spark, sf):
    """Types of a brand's modules, made of types and names of parts, against members, packages, simple and unknown names."""
    part = table(spark, sf, "part").withColumn("pkg", F.lower("p_type")).withColumn("w", F.element_at(F.split("p_name", " "), -1))
    part = part.withColumn("cls", F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)")))
    files = part.select(F.col("p_brand").alias("g"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string"), F.lit("/src/main/java/org/"), "pkg", F.lit("/"), "cls", F.lit(".java")).alias("path"))
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("cls", F.lit(".make"))).when(k == 1, F.concat(F.lit("org."), "pkg")).when(k == 2, F.concat(F.lit("org."), "pkg", F.lit("."), "cls", F.lit(".make"))).otherwise(F.concat(F.lit("org.none."), "cls", F.lit("$Inner")))
    return linking.type_files(part.select(F.col("p_brand").alias("g"), name.alias("name")), files, "g")


@query(
    f"""WITH {bm25_sql(40)}, r AS (SELECT query, key, rank, source AS file, key % 3 > 0 AS candidate FROM bm JOIN documents ON doc_id = key),
    b AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query, file ORDER BY rank) AS nth FROM r) WHERE nth = 1),
    l AS (SELECT *, file = arg_min(file, rank) OVER (PARTITION BY query) AS lead FROM r), u AS (SELECT *, bool_or(lead AND candidate) OVER (PARTITION BY query) AS held FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY query, lead ORDER BY rank) AS nth FROM u WHERE NOT lead OR candidate OR NOT held),
    f AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY lead DESC, rank) AS position FROM n WHERE lead AND nth <= 4 OR NOT lead AND nth = 1),
    t AS (SELECT query, file, row_number() OVER (PARTITION BY query ORDER BY min(rank) DESC, file) AS n FROM r GROUP BY query, file),
    y AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rank) AS position FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query, r.file ORDER BY rank) AS nth FROM r JOIN t ON r.query = t.query AND r.file = t.file WHERE n <= 2) WHERE nth <= 3)
    SELECT 'breadth' AS builder, query, key, position::INT AS position, ['primary', 'secondary', 'secondary', 'secondary', 'metadata', 'metadata'][position] AS mode FROM b WHERE position <= 6
    UNION ALL SELECT 'focus', query, key, position::INT, NULL FROM f
    UNION ALL SELECT 'retry', query, key, position::INT, ['primary', 'secondary', 'secondary', 'metadata'][least(position, 4)] FROM y"""
)
def context_items(spark, sf):
    """Items of three context builders over one ranking; a retry names its files from the last on."""
    ranked = lexical(spark, sf, 40).join(corpus(spark, sf).select(F.col("doc_id").alias("key"), F.col("source").alias("file")), "key")
    ranked = materialise(ranked.select("query", "key", "file", "rank", (F.col("key") % 3 > 0).alias("candidate")), "ranked")
    named = ranked.groupBy("query", "file").agg((-F.min("rank")).alias("place"))
    parts = {"breadth": packing.breadth_items(ranked), "focus": packing.focus_items(ranked).withColumn("mode", F.lit(None).cast("string")), "retry": packing.retry_items(ranked, named)}
    parts = [df.select(F.lit(n).alias("builder"), "query", "key", "position", "mode") for n, df in parts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
