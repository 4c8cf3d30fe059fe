"""Evaluation and statistics: approaches are rankings of documents, instances the benchmark items, repositories the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.context import materialise
from rankloom.operators import metrics, stats
from rankloom.operators.audit import contained_passages
from rankloom.plans.registry import query
from rankloom.plans.retrieval import bm25_sql, both, corpus, overlap_sql
from rankloom.sources.tables import table


def rankings(spark, sf, k: int = 20):
    """(approach, instance, rank, file, kind, name) of two rankings and their fusion by better rank."""
    from rankloom.operators.ranking import min_rank_union

    a, b = (materialise(df, "ranking") for df in both(spark, sf, 50))  # each is used twice
    parts = {"lexical": a.select("query", "key", "rank"), "overlap": b.select("query", "key", "rank"), "union": min_rank_union(a, b).select("query", "key", "rank")}
    out = None
    for name, df in parts.items():
        df = df.where(F.col("rank") <= k).select(F.lit(name).alias("approach"), F.col("query").alias("instance"), "rank", "key")
        out = df if out is None else out.unionByName(df)
    docs = corpus(spark, sf).select(F.col("doc_id").alias("key"), F.col("source").alias("file"))
    ranked = out.join(docs, "key").select("approach", "instance", "rank", "file", F.lit("function").alias("kind"), F.col("key").cast("string").alias("name"))
    return materialise(ranked, "rankings")  # an evaluation reads it several times


def targets(spark, sf):
    """Documents that hold an item's passage; every fifth item has its first file as a file target too."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    docs = corpus(spark, sf)
    # read several times, so texts are searched once
    held = materialise(contained_passages(docs, items).join(docs.select("doc_id", "source"), "doc_id"), "held")
    entity = held.select(F.col("item_id").alias("instance"), F.col("doc_id").cast("string").alias("target"), F.lit("function").alias("target_type"), F.col("source").alias("file"), F.col("doc_id").cast("string").alias("name"))
    file = held.where("item_id % 5 = 0").groupBy("item_id").agg(F.min("source").alias("file")).select(F.col("item_id").alias("instance"), F.concat(F.lit("file:"), "file").alias("target"), F.lit("file").alias("target_type"), "file", F.lit("").alias("name"))
    return entity.unionByName(file)


def evaluated(spark, sf):
    return metrics.evaluate(rankings(spark, sf), targets(spark, sf), 20)


EVAL_SQL = f"""{bm25_sql(50)}, {overlap_sql(50)},
    un AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY least(coalesce(a, 9999), coalesce(b, 9999)), a IS NULL, coalesce(a, 9999), coalesce(b, 9999), key)::INT AS rank FROM (SELECT coalesce(bm.query, ov.query) AS query, coalesce(bm.key, ov.key) AS key, bm.rank AS a, ov.rank AS b FROM bm FULL JOIN ov ON bm.query = ov.query AND bm.key = ov.key)),
    rk AS (SELECT approach, query AS instance, rank, key, source AS file FROM (SELECT 'lexical' AS approach, query, key, rank FROM bm UNION ALL SELECT 'overlap', query, key, rank FROM ov UNION ALL SELECT 'union', query, key, rank FROM un) JOIN documents ON doc_id = key WHERE rank <= 20),
    held AS (SELECT DISTINCT doc_id, item_id, source FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)),
    tg AS (SELECT item_id AS instance, doc_id::VARCHAR AS target, source AS file, doc_id AS key FROM held UNION ALL SELECT item_id, 'file:' || min(source), min(source), NULL FROM held WHERE item_id % 5 = 0 GROUP BY item_id),
    mt AS (SELECT approach, rk.instance, rank, target FROM rk JOIN tg ON rk.instance = tg.instance AND rk.file = tg.file AND (tg.key IS NULL OR tg.key = rk.key)),
    ev AS (SELECT approach, instance, coalesce(candidate_count, 0) AS candidate_count, target_count, coalesce(matched, 0) AS matched_target_count, coalesce(first_rank, 0) AS first_rank, coalesce(file_hit, 0)::INT AS file_hit, coalesce(matched, 0) / target_count AS target_coverage, (coalesce(matched, 0) > 0)::INT AS hit, coalesce(1.0 / first_rank, 0)::DOUBLE AS mrr, (coalesce(matched, 0) = target_count)::INT AS complete
      FROM (SELECT instance, count(DISTINCT target) AS target_count FROM tg GROUP BY instance) CROSS JOIN (SELECT DISTINCT approach FROM rk) LEFT JOIN (SELECT approach, instance, count(*) AS candidate_count FROM rk GROUP BY ALL) USING (approach, instance)
      LEFT JOIN (SELECT approach, instance, count(DISTINCT target) AS matched, min(rank) AS first_rank FROM mt GROUP BY ALL) USING (approach, instance) LEFT JOIN (SELECT DISTINCT approach, rk.instance, 1 AS file_hit FROM rk JOIN tg ON rk.instance = tg.instance AND rk.file = tg.file) USING (approach, instance)),
    pr AS (SELECT instance, measure, a.v AS baseline, b.v AS treatment FROM (SELECT * FROM lg WHERE approach = 'lexical') a JOIN (SELECT * FROM lg WHERE approach = 'union') b USING (instance, measure))"""
LONG_SQL = "lg AS (SELECT approach, instance, unnest(['file_hit', 'target_coverage', 'hit', 'mrr', 'complete']) AS measure, unnest([file_hit, target_coverage, hit, mrr, complete]::DOUBLE[]) AS v FROM ev), "
EVAL_SQL, PAIR_SQL = EVAL_SQL[: EVAL_SQL.index("pr AS")].rstrip().rstrip(","), EVAL_SQL[EVAL_SQL.index("pr AS") :]
PAIRS = f"{EVAL_SQL}, {LONG_SQL}{PAIR_SQL}"


@query(f"WITH {EVAL_SQL} SELECT approach, instance, candidate_count, target_count, matched_target_count, first_rank, file_hit, round(target_coverage, 6) AS target_coverage, hit, round(mrr, 6) AS mrr, complete FROM ev")
def retrieval_metrics(spark, sf):
    return evaluated(spark, sf).withColumn("target_coverage", F.round("target_coverage", 6)).withColumn("mrr", F.round("mrr", 6))


@query(f"WITH {EVAL_SQL} SELECT approach, count(*) AS n, round(avg(candidate_count), 4) AS candidate_count_mean, round(100 * avg(file_hit), 4) AS file_hit, round(100 * avg(target_coverage), 4) AS target_coverage, round(100 * avg(hit), 4) AS hit, round(100 * avg(mrr), 4) AS mrr, round(100 * avg(complete), 4) AS complete FROM ev GROUP BY approach")
def bm25_metrics(spark, sf):
    return metrics.summarise(evaluated(spark, sf))


def pairs(spark, sf):
    return metrics.paired(materialise(evaluated(spark, sf), "evaluated"), "lexical", "union")


@query(f"WITH {PAIRS} SELECT measure, count(*) AS n, round(100 * avg(treatment - baseline), 6) AS delta, count(*) FILTER (treatment - baseline > 1e-12) AS wins, count(*) FILTER (treatment - baseline < -1e-12) AS losses FROM pr GROUP BY measure")
def paired_contrast(spark, sf):
    return metrics.contrast(pairs(spark, sf))


@query(
    f"""WITH {PAIRS}, c AS (SELECT measure, count(*) FILTER (treatment > baseline + 1e-12) AS wins, count(*) FILTER (treatment < baseline - 1e-12) AS losses FROM pr GROUP BY measure)
    SELECT measure, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(j + 1) - lgamma(wins + losses - j + 1) - (wins + losses) * ln(2))) FROM (SELECT unnest(generate_series(0, 200)) AS j) WHERE j <= least(wins, losses))) END, 9)::DOUBLE AS p FROM c"""
)
def mcnemar_exact(spark, sf):
    return metrics.contrast(pairs(spark, sf)).select("measure", "wins", "losses", F.round(stats.mcnemar(F.col("wins"), F.col("losses")), 9).alias("p"))


@query()
def cluster_bootstrap_ci(spark, sf):
    p = pairs(spark, sf).withColumn("cluster", F.col("instance") % 12)
    return stats.paired_table(p, ["measure"], "cluster", 2000)


SOURCE_VALUES = "v AS (SELECT source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) - 0.7 AS d FROM documents JOIN labels USING (doc_id) GROUP BY source)"


@query(
    f"""WITH {SOURCE_VALUES}, n AS (SELECT d, row_number() OVER (ORDER BY source) - 1 AS i FROM v), s AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -d ELSE d END) AS t FROM (SELECT unnest(range(1::BIGINT << (SELECT count(*) FROM v))) AS m) CROSS JOIN n GROUP BY m)
    SELECT 'labels' AS endpoint, (SELECT count(*) FROM v) AS clusters, round(abs((SELECT sum(d) FROM n)), 9)::DOUBLE AS observed, round(avg((abs(t) >= abs((SELECT sum(d) FROM n)) - 1e-12)::INT), 9) AS p FROM s"""
)
def signflip_exact(spark, sf):
    rows = corpus(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    v = rows.groupBy("source").agg((F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)) - F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)) - 0.7).alias("d"))
    return stats.sign_flip(v.withColumn("endpoint", F.lit("labels")), ["endpoint"], "d", "source")


@query(
    """WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(c) AS n, sum(CASE WHEN x = y THEN c ELSE 0 END) AS same FROM c),
    h AS (SELECT sum(rx * cy) AS chance FROM (SELECT x AS v, sum(c) AS rx FROM c GROUP BY x) JOIN (SELECT y AS v, sum(c) AS cy FROM c GROUP BY y) USING (v))
    SELECT n::BIGINT AS n, round(same / n, 9)::DOUBLE AS agreement, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 9)::DOUBLE AS kappa FROM t, h"""
)
def kappa(spark, sf):
    return metrics.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query(
    """WITH r AS (SELECT 'quality' AS rater, doc_id, quality AS label FROM labels UNION ALL SELECT 'toxic', doc_id, toxic FROM labels), a AS (SELECT 'all' AS scope, label FROM r UNION ALL SELECT rater, label FROM r UNION ALL SELECT 'consensus', min(label) FROM r GROUP BY doc_id HAVING count(DISTINCT label) = 1),
    c AS (SELECT scope, label, count(*) AS n FROM a GROUP BY ALL) SELECT scope, label, n, round(n / sum(n) OVER (PARTITION BY scope), 6) AS share FROM c"""
)
def preference_shares(spark, sf):
    labels = table(spark, sf, "labels")
    rows = labels.select("doc_id", F.lit("quality").alias("rater"), F.col("quality").alias("label")).unionByName(labels.select("doc_id", F.lit("toxic").alias("rater"), F.col("toxic").alias("label")))
    return metrics.preference_shares(rows, "doc_id", "rater", "label")


@query("SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, count(*) AS n, round(avg(l_discount), 4) AS discount, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def rollup_all(spark, sf):
    return metrics.with_all(table(spark, sf, "lineitem"), "l_returnflag", {"n": F.count(F.lit(1)), "discount": F.round(F.avg("l_discount"), 4), "quantity": F.round(F.sum("l_quantity"), 2)})


@query(
    """SELECT CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS stratum, l_returnflag, count(*) AS n, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS micro, round(avg(l_discount), 6) AS macro
    FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_returnflag))"""
)
def strata(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("strata_rows")
    return spark.sql(
        """SELECT IF(grouping(l_linestatus) = 1, 'all', l_linestatus) AS stratum, l_returnflag, count(*) AS n, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS micro, round(avg(l_discount), 6) AS macro
        FROM strata_rows GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_returnflag))"""
    )


@query("WITH g AS (SELECT source, sum(n_chars) AS s, count(n_chars) AS n FROM documents GROUP BY source) SELECT source, n, round(s / n, 6) AS mean, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n), 6) AS mean_without FROM g")
def leave_one_out(spark, sf):
    return metrics.leave_one_out(table(spark, sf, "documents"), "source", "n_chars")


HITS_SQL = f"{EVAL_SQL}, h AS (SELECT approach AS source, instance, hit FROM ev), t AS (SELECT instance, sum(hit) AS by_ FROM h GROUP BY instance)"


@query(f"WITH {HITS_SQL} SELECT source, sum(hit)::BIGINT AS hits, count(*) FILTER (hit = 1 AND by_ = 1) AS exclusive FROM h JOIN t USING (instance) GROUP BY source")
def exclusive_hits(spark, sf):
    return metrics.exclusive_hits(evaluated(spark, sf).select(F.col("approach").alias("source"), "instance", "hit"))


@query(f"WITH {HITS_SQL} SELECT source, count(*) FILTER (by_ > 0) AS hit_by_all, count(*) FILTER (by_ - hit > 0) AS hit_without FROM h JOIN t USING (instance) GROUP BY source")
def leave_one_source_out(spark, sf):
    return metrics.leave_one_source_out(evaluated(spark, sf).select(F.col("approach").alias("source"), "instance", "hit"))


@query(
    f"""WITH {PAIRS}, k AS (SELECT measure, CASE WHEN baseline > 0 AND treatment > 0 THEN 'both' WHEN baseline > 0 THEN 'only_baseline' WHEN treatment > 0 THEN 'only_treatment' ELSE 'neither' END AS transition FROM pr)
    SELECT measure, transition, coalesce(n, 0) AS n FROM (SELECT DISTINCT measure FROM pr) CROSS JOIN (SELECT unnest(['both', 'only_baseline', 'only_treatment', 'neither']) AS transition) LEFT JOIN (SELECT measure, transition, count(*) AS n FROM k GROUP BY ALL) USING (measure, transition)"""
)
def transitions(spark, sf):
    return metrics.transitions(pairs(spark, sf), ["measure"])


@query(
    """WITH c AS (SELECT l_orderkey, count(*) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey), b AS (SELECT unnest(list_filter([CASE WHEN c = 1 THEN '1' END, CASE WHEN c = 2 THEN '2' END, CASE WHEN c >= 3 THEN '3+' END, CASE WHEN c >= 2 THEN '2+' END], lambda x: x IS NOT NULL)) AS bucket, q FROM c)
    SELECT bucket, count(*) AS n, round(avg(q), 6) AS mean FROM b GROUP BY bucket"""
)
def overlap_buckets(spark, sf):
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))
    return metrics.overlap_buckets(orders, "c", {"n": F.count(F.lit(1)), "mean": F.round(F.avg("q"), 6)})


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS interpolated, quantile_disc(l_extendedprice, 0.9) AS nearest_rank, list_sort(list(l_extendedprice))[least(count(*) - 1, floor(count(*) * 0.9)::BIGINT) + 1] AS truncated_index FROM lineitem GROUP BY l_returnflag")
def percentiles_three_ways(spark, sf):
    return metrics.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@query("SELECT round(avg(CASE WHEN quality = 1 THEN n_chars END), 6) AS with_outcome, round(avg(CASE WHEN quality = 0 THEN n_chars END), 6) AS without, round(avg(CASE WHEN quality = 1 THEN n_chars END) - avg(CASE WHEN quality = 0 THEN n_chars END), 6) AS gap FROM documents JOIN labels USING (doc_id)")
def outcome_gap(spark, sf):
    return metrics.outcome_gap(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"), "quality", "n_chars")


@query("SELECT b::DOUBLE AS bin, coalesce(n, 0) AS n, rate FROM (SELECT unnest([0.0, 0.05, 0.1, 0.5]) AS b) LEFT JOIN (SELECT l_discount AS d, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS rate FROM lineitem GROUP BY d) ON b::DOUBLE = d")
def binned_coverage(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return metrics.binned_coverage(rows, "l_discount", "returned", (0.0, 0.05, 0.1, 0.5)).withColumn("rate", F.round("rate", 6))


@query("WITH f AS (SELECT unnest(string_split(p_type, ' ')) AS flag, len(string_split(p_type, ' ')) = 1 AS alone FROM part WHERE length(p_type) > 0) SELECT flag, count(*) AS n, count(*) FILTER (alone) AS exclusive FROM f GROUP BY flag")
def flag_counts(spark, sf):
    return metrics.flag_counts(table(spark, sf, "part"), "p_type", " ")


@query("WITH m AS (SELECT p_size % 5 AS g, p_brand AS k, count(*) AS v FROM part GROUP BY ALL) SELECT g, array_to_string(list(k || '=' || v ORDER BY k), ',') AS counts FROM m GROUP BY g")
def sum_maps(spark, sf):
    maps = table(spark, sf, "part").groupBy((F.col("p_size") % 5).alias("g"), "p_size", "p_brand").count().groupBy("g", "p_size").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "count"))).alias("m"))
    summed = metrics.sum_maps(maps, ["g"], "m")
    return summed.select("g", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))
