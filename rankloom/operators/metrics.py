"""Evaluation of rankings against targets, and summaries by approach, stratum and repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ["file_hit", "target_coverage", "hit", "mrr", "complete"]


def matches(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(approach, instance, rank, target) where a candidate meets a target.

    ``candidates``: approach, instance, rank, file, kind, name. ``targets``: instance, target, target_type, file, name.
    Entity targets need kind and name as well, file targets the file alone: two equi-joins instead of an OR.
    """
    entity = targets.where("target_type <> 'file'").select("instance", "file", F.col("target_type").alias("kind"), "name", "target")
    file = targets.where("target_type = 'file'").select("instance", "file", "target")
    by_name = candidates.join(entity, ["instance", "file", "kind", "name"]).select("approach", "instance", "rank", "target")
    return by_name.unionByName(candidates.join(file, ["instance", "file"]).select("approach", "instance", "rank", "target"))


def evaluate(candidates: DataFrame, targets: DataFrame, top: int = 20) -> DataFrame:
    """Per approach and instance: file_hit, target_coverage, hit, mrr, complete, counts and first_rank over the first ``top``.

    Every approach gets a row for every instance with targets.
    """
    window = candidates.where(F.col("rank") <= top)
    wanted = targets.groupBy("instance").agg(F.count_distinct("target").alias("target_count"))
    files = targets.select("instance", "file").distinct()
    found = matches(window, targets).groupBy("approach", "instance").agg(F.count_distinct("target").alias("matched"), F.min("rank").alias("first_rank"))
    seen = window.groupBy("approach", "instance").agg(F.count(F.lit(1)).alias("candidate_count"))
    file_hits = window.join(files, ["instance", "file"], "left_semi").select("approach", "instance").distinct().withColumn("file_hit", F.lit(1))
    spine = wanted.crossJoin(F.broadcast(candidates.select("approach").distinct()))  # a handful of approaches
    rows = spine.join(seen, ["approach", "instance"], "left").join(found, ["approach", "instance"], "left").join(file_hits, ["approach", "instance"], "left")
    matched = F.coalesce("matched", F.lit(0))
    return rows.select(
        "approach", "instance", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "target_count", matched.alias("matched_target_count"), F.coalesce("first_rank", F.lit(0)).alias("first_rank"),
        F.coalesce("file_hit", F.lit(0)).alias("file_hit"), (matched / F.col("target_count")).alias("target_coverage"), (matched > 0).cast("int").alias("hit"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), (matched == F.col("target_count")).cast("int").alias("complete"),
    )


def summarise(instances: DataFrame, by: list[str] = ("approach",), places: int = 4) -> DataFrame:
    """Macro averages in percent, with the number of instances and the mean number of candidates."""
    return instances.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("candidate_count"), places).alias("candidate_count_mean"), *[F.round(100 * F.avg(m), places).alias(m) for m in MEASURES])


def paired(instances: DataFrame, baseline: str, treatment: str, keys: list[str] = ("instance",)) -> DataFrame:
    """Baseline and treatment values of every measure side by side: keys, measure, baseline, treatment."""
    long = lambda name, alias: instances.where(F.col("approach") == name).select(*keys, F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", alias))
    return long(baseline, "baseline").join(long(treatment, "treatment"), [*keys, "measure"])


def contrast(pairs: DataFrame, by: list[str] = ("measure",), tolerance: float = 1e-12) -> DataFrame:
    """Mean difference, wins and losses per measure."""
    d = F.col("treatment") - F.col("baseline")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(d), 6).alias("delta"), F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"))


def with_all(df: DataFrame, by: str, values: dict[str, Column], name: str = "ALL") -> DataFrame:
    """Aggregates per value of ``by`` and over everything, whose row is called ``name``."""
    return df.rollup(by).agg(F.grouping(by).alias("g"), *[c.alias(n) for n, c in values.items()]).withColumn(by, F.when(F.col("g") == 1, F.lit(name)).otherwise(F.col(by))).drop("g")


def leave_one_out(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of each group and mean of everything else: totals minus the group's sums, no second pass."""
    groups = df.groupBy(by).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = groups.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return groups.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(F.when(F.col("tn") > F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))), 6).alias("mean_without"))


def overlap_buckets(df: DataFrame, count: str, values: dict[str, Column]) -> DataFrame:
    """Overlapping buckets 1, 2, 3+ and 2+ of a count."""
    c = F.col(count)
    bucket = F.array_compact(F.array(F.when(c == 1, "1"), F.when(c == 2, "2"), F.when(c >= 3, "3+"), F.when(c >= 2, "2+")))
    return df.withColumn("bucket", F.explode(bucket)).groupBy("bucket").agg(*[v.alias(n) for n, v in values.items()])


def exclusive_hits(hits: DataFrame) -> DataFrame:
    """Per source the instances that it alone hits, and all it hits (hits: source, instance, hit)."""
    total = hits.groupBy("instance").agg(F.sum("hit").alias("by"))
    return hits.join(total, "instance").groupBy("source").agg(F.sum("hit").alias("hits"), F.count_if((F.col("hit") == 1) & (F.col("by") == 1)).alias("exclusive"))


def leave_one_source_out(hits: DataFrame) -> DataFrame:
    """Instances hit by any source, and by any other than one left out."""
    total = hits.groupBy("instance").agg(F.sum("hit").alias("by"))
    rows = hits.join(total, "instance")
    return rows.groupBy("source").agg(F.count_if(F.col("by") > 0).alias("hit_by_all"), F.count_if(F.col("by") - F.col("hit") > 0).alias("hit_without"))


def transitions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of both, only_baseline, only_treatment and neither, with zero rows for absent cells."""
    cells = F.explode(F.array(*map(F.lit, ("both", "only_baseline", "only_treatment", "neither")))).alias("transition")
    spine = pairs.select(*by).distinct().select(*by, cells)
    kind = F.when((F.col("baseline") > 0) & (F.col("treatment") > 0), "both").when(F.col("baseline") > 0, "only_baseline").when(F.col("treatment") > 0, "only_treatment").otherwise("neither")
    counted = pairs.groupBy(*by, kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, [*by, "transition"], "left").na.fill(0, ["n"])


def binned_coverage(df: DataFrame, coverage: str, outcome: str, bins: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Mean outcome at fixed coverage values, empty bins kept."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(b,) for b in bins], "bin double")
    got = df.groupBy(F.col(coverage).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate"))
    return spine.join(got, "bin", "left").na.fill(0, ["n"])


def outcome_gap(df: DataFrame, outcome: str, value: str) -> DataFrame:
    """Mean of a value where the outcome is 1 and where it is 0, and their gap."""
    yes, no = F.avg(F.when(F.col(outcome) == 1, F.col(value))), F.avg(F.when(F.col(outcome) == 0, F.col(value)))
    return df.agg(F.round(yes, 6).alias("with_outcome"), F.round(no, 6).alias("without"), F.round(yes - no, 6).alias("gap"))


def ratio_and_mean(df: DataFrame, by: list[str], part: str, whole: str, flag: str) -> DataFrame:
    """Ratio of sums beside a mean of flags: micro recall and macro completeness."""
    return df.groupBy(*by).agg(F.round(F.sum(part) / F.sum(whole), 6).alias("micro"), F.round(F.avg(F.col(flag).cast("double")), 6).alias("macro"))


def flag_counts(df: DataFrame, column: str, separator: str = r"\+") -> DataFrame:
    """Rows per flag of a joined list, and rows that carry it alone."""
    flags = F.split(F.col(column), separator)
    return df.where(F.length(column) > 0).select(F.explode(flags).alias("flag"), (F.size(flags) == 1).alias("alone")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("exclusive"))


def percentiles(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Three percentiles that differ: interpolated, nearest rank, and the element at the truncated index n * q."""
    # values are counted before a window runs over the distinct ones
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("truncated_index")).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*by)
    upto, n = F.sum("c").over(group.orderBy("truncated_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("c").over(group)
    place = F.least(n - 1, F.floor(n * F.lit(q))) + 1
    at = counts.withColumn("upto", upto).withColumn("place", place).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
    both = df.groupBy(*by).agg(F.percentile(value, q).alias("interpolated"), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("nearest_rank"))
    return both.join(at.select(*by, "truncated_index"), by, "left")


def sum_maps(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Maps of counts added key by key."""
    long = df.select(*by, F.explode(column)).groupBy(*by, "key").agg(F.sum("value").alias("value"))
    return long.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(column))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two raters over rows where both rated: n, agreement, kappa."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    rows, columns = cells.groupBy(F.col("x").alias("v")).agg(F.sum("c").alias("rx")), cells.groupBy(F.col("y").alias("v")).agg(F.sum("c").alias("cy"))
    chance = rows.join(columns, "v").agg(F.sum(F.col("rx") * F.col("cy")).alias("chance"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    n = F.col("n").cast("double")
    expected, observed = F.coalesce("chance", F.lit(0)) / (n * n), F.col("same") / n
    return total.crossJoin(F.broadcast(chance)).select("n", F.round(observed, 9).alias("agreement"), F.round(F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected)), 9).alias("kappa"))


def preference_shares(df: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Label counts and shares in three scopes: all rows, each rater, and items on which all raters agree."""
    agreed = df.groupBy(item).agg(F.count_distinct(label).alias("kinds"), F.min(label).alias(label)).where("kinds = 1").select(F.lit("consensus").alias("scope"), label)
    parts = [df.select(F.lit("all").alias("scope"), label), df.select(F.col(rater).cast("string").alias("scope"), label), agreed]
    counts = reduce(DataFrame.unionByName, parts).groupBy("scope", label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("scope").agg(F.sum("n").alias("total"))
    return counts.join(totals, "scope").select("scope", label, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
