"""Run reports and ledgers: legacy metrics, histograms, mechanism summaries, outcome states, prompts, protocol checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, places)).otherwise(0.0)


def distinct_symbol_ranks(df: DataFrame, query: str = "query") -> DataFrame:
    """Legacy rank: position among the distinct symbols of a query."""
    first = df.groupBy(query, "symbol").agg(F.min("rank").alias("first"))
    return first.withColumn("symbol_rank", F.row_number().over(Window.partitionBy(query).orderBy("first", "symbol")))


def file_hits(ranked: DataFrame, targets: DataFrame, tops: list[int], query: str = "query", file: str = "file") -> DataFrame:
    """Share of queries with a target file among the first n distinct files, for every n."""
    files = ranked.groupBy(query, file).agg(F.min("rank").alias("first"))
    files = files.withColumn("file_rank", F.row_number().over(Window.partitionBy(query).orderBy("first", file)))
    best = files.join(targets.select(query, file).distinct(), [query, file]).groupBy(query).agg(F.min("file_rank").alias("best"))
    rows = targets.select(query).distinct().join(best, query, "left")
    tops_table = ranked.sparkSession.createDataFrame([(t,) for t in tops], "top int")
    return rows.crossJoin(F.broadcast(tops_table)).groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.coalesce("best", F.lit(2**31 - 1)) <= F.col("top")).cast("double")), 4).alias("hit_rate"))


def rank_histogram(df: DataFrame, by: list[str], rank: str = "first_rank") -> DataFrame:
    """Observations per rank; rank 0 stands for a miss."""
    return df.groupBy(*by, F.col(rank).alias("at")).agg(F.count(F.lit(1)).alias("n"))


def mechanism_summary(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Top 1, 5, 10, 15 and beyond of a rank histogram, with percents of what was found."""
    n, at = F.col("n"), F.col("at")
    within = lambda low, high: F.sum(F.when((at >= low) & (at <= high), n).otherwise(0))
    row = histogram.groupBy(*by).agg(within(1, 2**31 - 1).alias("observed"), within(0, 0).alias("missed"), within(1, 1).alias("top1"), within(1, 5).alias("top5"), within(1, 10).alias("top10"), within(1, 15).alias("top15"), within(16, 2**31 - 1).alias("beyond15"))
    return row.select("*", *[percent(F.col(c), F.col("observed")).alias(f"{c}_percent") for c in ("top1", "top5", "top10", "top15", "beyond15")])


def path_summary(df: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """Direct (one step) and multi-hop paths."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col(length) == 1).alias("direct"), F.count_if(F.col(length) > 1).alias("multi_hop"))


def cache_summary(df: DataFrame, ranks: str = "ranks") -> DataFrame:
    """Mean reciprocal rank and hit rate from maps of rank to count: the least positive rank with a count is the instance's."""
    keys = F.map_keys(F.map_filter(F.coalesce(ranks, F.create_map().cast("map<int,int>")), lambda k, v: (k > 0) & (v > 0)))
    best = F.array_min(keys)
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1.0 / best, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.size(keys) > 0).cast("double")), 6).alias("hit_rate"))


def edit_targets(matched: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """Recall and completeness of edit targets: distinct matched over wanted."""
    got = matched.groupBy(key).agg(F.count_distinct("target").alias("found"))
    return total.join(got, key, "left").na.fill(0, ["found"]).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6)).withColumn("complete", (F.col("found") == F.col("wanted")).cast("int"))


def cap_exhaustion(df: DataFrame, by: list[str], cap: int) -> DataFrame:
    """Packings that ran out of candidates, and those that met the cap on them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("selected") == F.col("candidates")).alias("exhausted"), F.count_if((F.col("selected") == F.col("candidates")) & (F.col("candidates") >= cap)).alias("at_cap"))


def opportunity_matched(pairs: DataFrame, measure: str) -> DataFrame:
    """Contrast on instances where both sides had the file: mean of each, difference, wins, ties and losses.

    ``pairs``: eligible, base_file_hit, treat_file_hit, base_<measure>, treat_<measure>.
    """
    a, b = F.col(f"base_{measure}"), F.col(f"treat_{measure}")
    rows = pairs.where(F.col("eligible") & (F.col("base_file_hit") == 1) & (F.col("treat_file_hit") == 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(a), 6).alias("baseline"), F.round(100 * F.avg(b), 6).alias("treatment"), F.round(100 * F.avg(b - a), 6).alias("delta"), F.count_if(b > a).alias("wins"), F.count_if(a == b).alias("ties"), F.count_if(b < a).alias("losses"))


def rank_shift(pairs: DataFrame) -> DataFrame:
    """First ranks of instances that both sides hit: means, shift, earlier, same and later."""
    a, b = F.col("base_first_rank"), F.col("treat_first_rank")
    return pairs.where((F.col("base_hit") == 1) & (F.col("treat_hit") == 1)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(a), 6).alias("baseline"), F.round(F.avg(b), 6).alias("treatment"), F.round(F.avg(b - a), 6).alias("shift"), F.count_if(b < a).alias("earlier"), F.count_if(a == b).alias("same"), F.count_if(b > a).alias("later"))


def against_control(groups: DataFrame, control: str, measures: list[str], key: str = "instance") -> DataFrame:
    """Every group against one control: rates, wins, losses per measure, and the exact p of hits."""
    from rankloom.operators.stats import mcnemar

    base = groups.where(F.col("approach") == control).select(key, *[F.col(m).cast("double").alias(f"b_{m}") for m in measures])
    rows = groups.where(F.col("approach") != control).join(base, key)
    d = {m: F.col(m).cast("double") - F.col(f"b_{m}") for m in measures}
    out = rows.groupBy("approach").agg(F.count(F.lit(1)).alias("n"), *[F.round(100 * F.avg(F.col(m).cast("double")), 4).alias(m) for m in measures], *[F.count_if(d[m] > 1e-12).alias(f"{m}_wins") for m in measures], *[F.count_if(d[m] < -1e-12).alias(f"{m}_losses") for m in measures])
    return out.withColumn("p", F.round(mcnemar(F.col("hit_wins"), F.col("hit_losses")), 9)) if "hit" in measures else out


def construction_cost(df: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """Total, mean, median, interpolated 95th percentile and maximum of seconds."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds), 2).alias("total"), F.round(F.avg(seconds), 4).alias("mean"), F.round(F.percentile(seconds, 0.5), 2).alias("median"), F.round(F.percentile(seconds, 0.95), 2).alias("p95"), F.round(F.max(seconds), 2).alias("max"))


def run_states(dataset: DataFrame, predictions: DataFrame, reports: DataFrame, key: str = "instance_id") -> DataFrame:
    """State of every instance: incomplete (no prediction), empty_patch, error (no or broken report), resolved or unresolved."""
    rows = dataset.select(key).distinct().join(predictions.select(key, F.col("model_patch").alias("patch"), F.lit(True).alias("predicted")), key, "left").join(reports.select(key, "resolved", F.lit(True).alias("reported")), key, "left")
    state = F.when(F.col("predicted").isNull(), "incomplete").when(F.coalesce(F.trim("patch"), F.lit("")) == "", "empty_patch").when(F.col("reported").isNull() | F.col("resolved").isNull(), "error").when(F.col("resolved"), "resolved").otherwise("unresolved")
    return rows.select(key, state.alias("state"))


def run_report(states: DataFrame) -> DataFrame:
    """Counts per state, and completed = resolved and unresolved together."""
    counts = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    done = states.where(F.col("state").isin("resolved", "unresolved")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("completed").alias("state"), "n")
    return counts.unionByName(done)


def retry_states(runs: DataFrame, instances: DataFrame, key: str) -> DataFrame:
    """complete with exactly one clean run, retry with failed or unfinished runs only; fails for two clean runs or none at all.

    ``runs``: key and outcome (clean, failed, unfinished).
    """
    n = runs.groupBy(key).agg(F.count_if(F.col("outcome") == "clean").alias("clean"), F.count(F.lit(1)).alias("runs"))
    rows = instances.join(n, key, "left").na.fill(0, ["clean", "runs"])
    checked = rows.withColumn("ok", F.assert_true((F.col("clean") <= 1) & (F.col("runs") > 0), "an instance has two clean runs, or none at all").isNull()).where("ok")
    return checked.select(key, F.when(F.col("clean") == 1, "complete").otherwise("retry").alias("state"))


def prediction_checks(predictions: DataFrame, dataset: DataFrame, key: str = "instance_id") -> DataFrame:
    """Predictions that break the protocol: an id twice, an unknown id, or a missing field. Empty when all is well."""
    twice = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("problem"))
    unknown = predictions.select(key).distinct().join(dataset.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    fields = predictions.where(F.col("model_patch").isNull() | F.col("model_name_or_path").isNull()).select(key, F.lit("missing_field").alias("problem"))
    return twice.unionByName(unknown).unionByName(fields)


def dataset_profile(targets: DataFrame) -> DataFrame:
    """Instances by stratum of their targets and by their number: measure, value."""
    per = targets.groupBy("instance").agg(F.count_if(F.col("target_type") != "file").alias("entities"), F.count_if(F.col("target_type") == "file").alias("files"), F.count(F.lit(1)).alias("n"))
    e, f, n = F.col("entities"), F.col("files"), F.col("n")
    wide = per.agg(F.count(F.lit(1)).alias("instances"), F.sum(n).alias("targets"), F.count_if((e > 0) & (f == 0)).alias("entity_only"), F.count_if((e > 0) & (f > 0)).alias("mixed"), F.count_if(e == 0).alias("file_only"), F.count_if(n == 1).alias("one_target"), F.count_if(n == 2).alias("two_targets"), F.count_if(n >= 3).alias("three_or_more"))
    return wide.selectExpr("stack(8, 'instances', instances, 'targets', targets, 'entity_only', entity_only, 'mixed', mixed, 'file_only', file_only, 'one_target', one_target, 'two_targets', two_targets, 'three_or_more', three_or_more) AS (measure, value)")


def rendered_blocks(prompts: DataFrame, key: str, text: str) -> DataFrame:
    """Entities of a rendered prompt, one block per '- signature : ' line: signature, start_line, end_line, has_source."""
    blocks = prompts.select(key, F.posexplode(F.split(F.col(text), r"(?m)(?=^- signature : )")).alias("at", "block")).where(F.col("block").startswith("- signature : "))
    line = lambda name: F.trim(F.regexp_extract("block", rf"(?m)^- {name} : (.*)$", 1))
    return blocks.select(key, "at", line("signature").alias("signature"), line("start_line").alias("start_line"), line("end_line").alias("end_line"), F.contains("block", F.lit("- source_authority :")).cast("int").alias("has_source"))


def resolve_blocks(blocks: DataFrame, methods: DataFrame, key: str) -> DataFrame:
    """Blocks to methods (key, signature, start_line, end_line, id, ordinal): exact, then by signature, then by span and prefix."""
    m = methods.select(key, F.col("signature").alias("m_signature"), F.col("start_line").cast("string").alias("m_start"), F.col("end_line").cast("string").alias("m_end"), "id", "ordinal")
    same_signature = F.col("signature") == F.col("m_signature")
    same_span = (F.col("start_line") == F.col("m_start")) & (F.col("end_line") == F.col("m_end"))
    level = F.when(same_signature & same_span, 0).when(same_signature, 1).when(same_span & F.col("m_signature").startswith(F.col("signature")), 2)
    hit = blocks.join(m, key).withColumn("level", level).where("level IS NOT NULL")
    best = hit.groupBy(key, "at").agg(F.min(F.struct("level", "ordinal", "id")).alias("b"))
    return blocks.join(best, [key, "at"], "left").select(*blocks.columns, F.col("b.id").alias("id"), F.col("b.level").alias("level"))


def context_counts(df: DataFrame, key: str) -> DataFrame:
    """Entities with source, and their files, per resolved context."""
    return df.where(F.length(F.trim(F.coalesce("source_code", F.lit("")))) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("file_path").alias("files"))
