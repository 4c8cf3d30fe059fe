"""Reports over rankings, round trips through sinks, and matches by name, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.context import scratch
from rankloom.operators import joins, metrics, packing, parsers, patches, reports, stats
from rankloom.plans.evaluation import EVAL_SQL, PAIRS, evaluated, pairs, rankings, targets
from rankloom.plans.registry import query
from rankloom.plans.retrieval import bm25_sql, corpus, lexical, with_file
from rankloom.sources import tables as src
from rankloom.sources.tables import table


@query(
    f"""WITH {EVAL_SQL}, fr AS (SELECT instance, file, row_number() OVER (PARTITION BY instance ORDER BY min(rank), file) AS n FROM rk WHERE approach = 'lexical' GROUP BY instance, file), b AS (SELECT fr.instance, min(n) AS best FROM fr JOIN tg USING (instance, file) GROUP BY 1)
    SELECT top::INT AS top, count(*) AS n, round(100 * avg((coalesce(best, 2147483647) <= top)::INT), 4) AS hit_rate FROM (SELECT DISTINCT instance FROM tg) LEFT JOIN b USING (instance) CROSS JOIN (SELECT unnest([1, 5, 10]) AS top) GROUP BY top"""
)
def file_hit_rates(spark, sf):
    ranked = rankings(spark, sf).where("approach = 'lexical'").select(F.col("instance").alias("query"), "file", "rank")
    return reports.file_hits(ranked, targets(spark, sf).select(F.col("instance").alias("query"), "file"), [1, 5, 10])


@query(f"WITH {EVAL_SQL} SELECT approach, first_rank AS at, count(*) AS n FROM ev GROUP BY ALL")
def rank_histogram(spark, sf):
    return reports.rank_histogram(evaluated(spark, sf), ["approach"])


@query(
    f"""WITH {EVAL_SQL}, s AS (SELECT approach, count(*) FILTER (first_rank > 0) AS observed, count(*) FILTER (first_rank = 0) AS missed, count(*) FILTER (first_rank = 1) AS top1, count(*) FILTER (first_rank BETWEEN 1 AND 5) AS top5, count(*) FILTER (first_rank BETWEEN 1 AND 10) AS top10, count(*) FILTER (first_rank BETWEEN 1 AND 15) AS top15, count(*) FILTER (first_rank > 15) AS beyond15 FROM ev GROUP BY approach)
    SELECT *, round(100 * top1 / observed, 2) AS top1_percent, round(100 * top5 / observed, 2) AS top5_percent, round(100 * top10 / observed, 2) AS top10_percent, round(100 * top15 / observed, 2) AS top15_percent, round(100 * beyond15 / observed, 2) AS beyond15_percent FROM s"""
)
def mechanism_summary(spark, sf):
    return reports.mechanism_summary(reports.rank_histogram(evaluated(spark, sf), ["approach"]), ["approach"])


SIDES_SQL = f"{EVAL_SQL}, sd AS (SELECT a.instance, a.target_count <= 3 AS eligible, a.file_hit AS base_file_hit, b.file_hit AS treat_file_hit, a.hit AS base_hit, b.hit AS treat_hit, a.first_rank AS base_first_rank, b.first_rank AS treat_first_rank FROM (SELECT * FROM ev WHERE approach = 'overlap') a JOIN (SELECT * FROM ev WHERE approach = 'lexical') b USING (instance))"


def sides(spark, sf):
    """Two approaches side by side."""
    columns = ["file_hit", "hit", "first_rank"]
    e = evaluated(spark, sf)
    one = lambda name, prefix: e.where(F.col("approach") == name).select("instance", "target_count", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return one("overlap", "base").join(one("lexical", "treat").drop("target_count"), "instance").withColumn("eligible", F.col("target_count") <= 3)


@query(f"WITH {SIDES_SQL} SELECT count(*) AS n, round(100 * avg(base_hit), 6) AS baseline, round(100 * avg(treat_hit), 6) AS treatment, round(100 * avg(treat_hit - base_hit), 6) AS delta, count(*) FILTER (treat_hit > base_hit) AS wins, count(*) FILTER (treat_hit = base_hit) AS ties, count(*) FILTER (treat_hit < base_hit) AS losses FROM sd WHERE eligible AND base_file_hit = 1 AND treat_file_hit = 1")
def opportunity_matched(spark, sf):
    return reports.opportunity_matched(sides(spark, sf), "hit")


@query(f"WITH {SIDES_SQL} SELECT count(*) AS n, round(avg(base_first_rank), 6) AS baseline, round(avg(treat_first_rank), 6) AS treatment, round(avg(treat_first_rank - base_first_rank), 6) AS shift, count(*) FILTER (treat_first_rank < base_first_rank) AS earlier, count(*) FILTER (treat_first_rank = base_first_rank) AS same, count(*) FILTER (treat_first_rank > base_first_rank) AS later FROM sd WHERE base_hit = 1 AND treat_hit = 1")
def shared_hit_rank_shift(spark, sf):
    return reports.rank_shift(sides(spark, sf))


@query(
    f"""WITH {EVAL_SQL}, b AS (SELECT instance, hit AS b_hit, complete AS b_complete FROM ev WHERE approach = 'lexical')
    SELECT approach, count(*) AS n, round(100 * avg(hit), 4) AS hit, round(100 * avg(complete), 4) AS complete, count(*) FILTER (hit > b_hit) AS hit_wins, count(*) FILTER (complete > b_complete) AS complete_wins, count(*) FILTER (hit < b_hit) AS hit_losses, count(*) FILTER (complete < b_complete) AS complete_losses FROM ev JOIN b USING (instance) WHERE approach <> 'lexical' GROUP BY approach"""
)
def against_control(spark, sf):
    return reports.against_control(evaluated(spark, sf), "lexical", ["hit", "complete"]).drop("p")


@query(
    f"""WITH {EVAL_SQL}, p AS (SELECT instance, count(*) FILTER (key IS NOT NULL) AS e, count(*) FILTER (key IS NULL) AS f, count(*) AS n FROM tg GROUP BY instance),
    w AS (SELECT count(*)::BIGINT AS instances, sum(n)::BIGINT AS targets, (count(*) FILTER (e > 0 AND f = 0))::BIGINT AS entity_only, (count(*) FILTER (e > 0 AND f > 0))::BIGINT AS mixed, (count(*) FILTER (e = 0))::BIGINT AS file_only, (count(*) FILTER (n = 1))::BIGINT AS one_target, (count(*) FILTER (n = 2))::BIGINT AS two_targets, (count(*) FILTER (n >= 3))::BIGINT AS three_or_more FROM p)
    UNPIVOT w ON COLUMNS(*) INTO NAME measure VALUE value"""
)
def dataset_profile(spark, sf):
    return reports.dataset_profile(targets(spark, sf))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.95), 2) AS p95, round(max(value), 2) AS max FROM events GROUP BY event_type")
def construction_cost(spark, sf):
    return reports.construction_cost(table(spark, sf, "events"), ["event_type"], "value")


@query(
    """WITH s AS (SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 13 = 0 THEN 'incomplete' WHEN o_orderkey % 7 = 0 THEN 'empty_patch' WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'unresolved' END AS state FROM orders)
    SELECT state, count(*) AS n FROM s GROUP BY state UNION ALL SELECT 'completed', count(*) FROM s WHERE state IN ('resolved', 'unresolved')"""
)
def run_report(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), "o_orderstatus")
    predictions = orders.where("instance_id % 13 <> 0").select("instance_id", F.when(F.col("instance_id") % 7 == 0, "").otherwise("patch").alias("model_patch"))
    outcome = orders.where("instance_id % 5 <> 0").select("instance_id", (F.col("o_orderstatus") == "F").alias("resolved"))
    return reports.run_report(reports.run_states(orders, predictions, outcome))


@query(
    f"""WITH {PAIRS}, c AS (SELECT measure, instance % 6 AS cluster, sum(treatment - baseline) AS d, count(*) AS w FROM pr GROUP BY ALL) SELECT measure, round(sum(d) / sum(w), 9) AS delta, count(*) FILTER (d > 1e-12) AS positive, count(*) FILTER (abs(d) <= 1e-12) AS zero, count(*) FILTER (d < -1e-12) AS negative FROM c GROUP BY measure"""
)
def cluster_signs(spark, sf):
    return stats.sign_flip_summary(pairs(spark, sf).withColumn("cluster", F.col("instance") % 6), ["measure"], "cluster").drop("clusters", "p")


@query(
    """WITH v AS (SELECT doc_id, quality AS v, 'quality' AS variant FROM labels UNION ALL SELECT doc_id, toxic, 'toxic' FROM labels UNION ALL SELECT doc_id, 1, 'always' FROM labels)
    SELECT a.variant, b.variant AS other, count(*) FILTER (b.v > a.v) AS wins, count(*) FILTER (b.v < a.v) AS losses FROM v a JOIN v b USING (doc_id) WHERE a.variant < b.variant GROUP BY ALL"""
)
def all_contrasts(spark, sf):
    labels = table(spark, sf, "labels")
    frames = {n: labels.select("doc_id", (F.col(n) if n != "always" else F.lit(1)).alias("v")) for n in ("quality", "toxic", "always")}
    return stats.all_contrasts(frames, "doc_id", "v").drop("p")


@query(
    f"""WITH {bm25_sql(50)}, t AS (SELECT query, rank, ceil(length(text) / 4)::BIGINT AS tokens FROM bm JOIN documents ON doc_id = key), s AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank) AS total FROM t),
    p AS (SELECT query, budget, count(*) AS candidates, count(*) FILTER (total <= budget) AS selected FROM s CROSS JOIN (SELECT unnest([4000, 80000]) AS budget) GROUP BY ALL)
    SELECT budget::INT AS budget, count(*) AS n, count(*) FILTER (selected = candidates) AS exhausted, count(*) FILTER (selected = candidates AND candidates >= 50) AS at_cap FROM p GROUP BY budget"""
)
def cap_exhaustion(spark, sf):
    from rankloom.functions.text import token_proxy

    ranked = lexical(spark, sf, 50).join(corpus(spark, sf).select(F.col("doc_id").alias("key"), token_proxy(F.col("text")).alias("tokens")), "key")
    budgets = [4000, 80000]
    return reports.cap_exhaustion(packing.pack_summary(packing.pack_prefix(ranked, budgets), ranked, budgets), ["budget"], 50)


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS s, round(p_retailprice, 6) AS v FROM part")
def ledger_round_trip(spark, sf):
    """Written as a ledger with NA for nulls, and read back under a schema."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("s"), F.col("p_retailprice").alias("v"))
    out = scratch(spark, "ledger")
    src.write_ledger(part, out, ["k", "s", "v"])
    return src.ledger(spark, out, "k long, s string, v double")


@query(f"WITH {bm25_sql(5)} SELECT 'q' || query AS instance_id, rank, 'doc' || key AS name FROM bm")
def archive_round_trip(spark, sf):
    """Written as one compressed JSON line per instance, and one source read back."""
    ranked = with_file(lexical(spark, sf, 8), spark, sf).select(F.concat(F.lit("q"), "query").alias("instance_id"), F.lit("lexical").alias("source"), "rank", F.col("file").alias("file_path"), F.concat(F.lit("doc"), "key").alias("name"))
    out = scratch(spark, "archive")
    src.write_archive(ranked, out, 5)
    return src.ranking_archive(spark, out, "lexical", 5).select("instance_id", "rank", "name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 = 0")
def id_list_scan(spark, sf):
    """Ids written as lines, read as an id list, and used to cut a table."""
    customer = table(spark, sf, "customer")
    out = scratch(spark, "ids")
    customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string")).write.text(out)
    ids = src.id_list(spark, out, "c_custkey").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    return src.only_ids(customer, ids, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT r_name, n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN (SELECT min(r_name) FROM region)")
def partitioned_snapshot(spark, sf):
    """A snapshot partitioned by one column, read back with its partition filter."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "c_custkey")
    out = scratch(spark, "snapshot")
    src.snapshot(rows, out, ["r_name"])
    first = table(spark, sf, "region").agg(F.min("r_name")).first()[0]
    return spark.read.parquet(out).where(F.col("r_name") == first).select("r_name", "n_name", "c_custkey")


@query("""WITH p AS (SELECT DISTINCT p_brand AS g, replace(p_type, ' ', '.') AS sig FROM part), c AS (SELECT DISTINCT p_brand AS g, string_split(p_type, ' ')[1] AS cls FROM part WHERE p_size > 25) SELECT p.g, sig, cls FROM p JOIN c ON p.g = c.g AND (sig = cls OR starts_with(sig, cls || '.'))""")
def prefix_match(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.col("p_brand").alias("g"), F.regexp_replace("p_type", " ", ".").alias("sig")).distinct()
    classes = part.where("p_size > 25").select(F.col("p_brand").alias("g"), F.split("p_type", " ")[0].alias("cls")).distinct()
    return joins.prefix_match(names, classes, "g", "sig", "cls").select("g", "sig", "cls")


@query("""WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages), t AS (SELECT host, path, string_split(path, '/')[-1] AS tail FROM f WHERE path <> '') SELECT a.host, a.path, b.tail FROM f a JOIN t b USING (host) WHERE ends_with(a.path, b.tail) OR ends_with(b.tail, a.path)""")
def suffix_match(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path")).distinct()
    tails = files.where("path <> ''").select("host", F.element_at(F.split("path", "/"), -1).alias("tail"))
    return joins.suffix_match(files, tails, "host", "path", "tail").select("host", "path", "tail")


@query(
    """WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages),
    t AS (SELECT DISTINCT host, left(path, 1 + length(path) // 2) AS part FROM f UNION SELECT host, right(path, length(path) // 3) || 'x' FROM f UNION SELECT host, right(path, 2) FROM f)
    SELECT f.host, path, part FROM f JOIN t ON f.host = t.host AND (contains(path, part) OR contains(part, path))"""
)
def contains_match(spark, sf):
    """Paths of a host against halves, endings and last two characters of its paths."""
    files = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path")).distinct()
    third = F.expr("right(path, CAST(length(path) DIV 3 AS INT))")
    parts = [F.expr("left(path, CAST(1 + length(path) DIV 2 AS INT))"), F.concat(third, F.lit("x")), F.expr("right(path, 2)")]
    parts = files.select("host", F.explode(F.array(*parts)).alias("part")).distinct()
    return joins.contains_match(files, parts, "host", "path", "part").select("host", "path", "part")


@query("SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::BIGINT AS firsts FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey")
def keys_in_all(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    common = joins.in_all([table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")), lines.where("l_returnflag = 'R'").select("k"), lines.select("k")], "k")
    return lines.join(common, "k", "left_semi").groupBy(F.col("k").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_linenumber") == 1).cast("int")).alias("firsts"))


@query("SELECT source, symbol_rank, doc FROM (SELECT source, lang AS doc, row_number() OVER (PARTITION BY source ORDER BY min(doc_id), lang)::INT AS symbol_rank FROM documents GROUP BY source, lang)")
def distinct_symbol_ranks(spark, sf):
    df = table(spark, sf, "documents").select("source", F.col("lang").alias("symbol"), F.col("doc_id").alias("rank"))
    return reports.distinct_symbol_ranks(df, "source").select("source", "symbol_rank", F.col("symbol").alias("doc"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS micro, round(avg((l_discount > 0.05)::INT), 6) AS macro FROM lineitem GROUP BY l_returnflag")
def ratio_and_mean(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("part", F.col("l_quantity") * F.col("l_discount")).withColumn("flag", (F.col("l_discount") > 0.05).cast("int"))
    return metrics.ratio_and_mean(rows, ["l_returnflag"], "part", "l_quantity", "flag")


@query(
    """WITH p AS (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS brand, p_size AS n, p_size % 4 AS d FROM part)
    SELECT p_partkey, 'class' AS kind, brand AS name, brand AS signature, 1 AS "start", (7 + d)::INT AS "end" FROM p
    UNION ALL SELECT p_partkey, 'assignment', brand || '.size', brand || '.size = ' || n, (4 + d)::INT, (4 + d)::INT FROM p
    UNION ALL SELECT p_partkey, 'function', brand || '.price', brand || '.price(self, n=' || n || ')', (6 + d)::INT, (7 + d)::INT FROM p
    UNION ALL SELECT p_partkey, 'function', 'helper_' || p_partkey, 'helper_' || p_partkey || '(x)', (9 + d)::INT, (10 + d)::INT FROM p WHERE n % 3 > 0"""
)
def python_entities(spark, sf):
    """Entities of modules made of the parts' columns: a class with a docstring of some lines, a method, and a function that may be missing."""
    brand, size, key = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    doc = F.concat(F.lit("    \'\'\'"), "p_name", F.lit("\n"), F.expr("repeat('    a line\n', p_size % 4)"), F.lit("    \'\'\'\n"))
    helper = F.when(F.col("p_size") % 3 > 0, F.concat(F.when(F.col("p_size") % 2 == 1, "async ").otherwise(""), F.lit("def helper_"), key, F.lit("(x):\n    return x\n"))).otherwise("")
    content = F.concat(F.lit("class "), brand, F.lit(":\n"), doc, F.lit("    size = "), size, F.lit("\n\n    def price(self, n="), size, F.lit("):\n        return n\n\n"), helper)
    files = table(spark, sf, "part").select("p_partkey", content.alias("content"))
    return parsers.entities(files, ["p_partkey"]).select("p_partkey", "kind", "name", "signature", "start", "end")


@query(
    """WITH h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)::INT AS hunk, (l_returnflag = 'R')::INT AS gone, (l_linestatus = 'O')::INT AS come FROM lineitem)
    SELECT l_orderkey, 'f' || l_orderkey || '.py' AS file, hunk, ' ' AS op, 10 * hunk AS old_line, 10 * hunk AS new_line, 'part ' || l_partkey AS line FROM h
    UNION ALL SELECT l_orderkey, 'f' || l_orderkey || '.py', hunk, '-', 10 * hunk + 1, NULL, 'supplier ' || l_suppkey FROM h WHERE gone = 1
    UNION ALL SELECT l_orderkey, 'f' || l_orderkey || '.py', hunk, '+', 10 * hunk + 1 + gone, 10 * hunk + 1, 'quantity ' || l_quantity::BIGINT FROM h WHERE come = 1"""
)
def diff_lines(spark, sf):
    """Lines of one diff per order, with a hunk for each of its lines: what came back is taken out, what is open is put in."""
    start, gone, come = F.format_string("%d", 10 * F.col("hunk")), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    size = lambda c: (1 + c.cast("int")).cast("string")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = table(spark, sf, "lineitem").withColumn("hunk", F.row_number().over(order))
    hunk = F.concat(
        F.lit("@@ -"), start, F.lit(","), size(gone), F.lit(" +"), start, F.lit(","), size(come), F.lit(" @@\n part "), F.col("l_partkey").cast("string"), F.lit("\n"),
        F.when(gone, F.concat(F.lit("-supplier "), F.col("l_suppkey").cast("string"), F.lit("\n"))).otherwise(""),
        F.when(come, F.concat(F.lit("+quantity "), F.col("l_quantity").cast("long").cast("string"), F.lit("\n"))).otherwise(""),
    )
    whole = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", hunk.alias("text")))), lambda x: x["text"]), "").alias("hunks"))
    name = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".py\n"))
    diffs = whole.select("l_orderkey", F.concat(F.lit("--- a/"), name, F.lit("+++ b/"), name, "hunks").alias("patch"))
    return patches.patch_lines(diffs, "l_orderkey", "patch")


@query()
def fuzzy_best(spark, sf):
    """Best match by longest common subsequence of part names within a brand."""
    part = table(spark, sf, "part")
    left, right = part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1")
    return joins.fuzzy_best(left.select("p_brand", F.col("p_name").alias("a")).distinct(), right.select("p_brand", F.col("p_name").alias("b")).distinct(), "p_brand", "a", "b")
