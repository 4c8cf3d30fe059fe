"""Ranked lists: ranks, top-k, fusion, unions, completion, interleaving.

A ranking is a long table: query, key, rank (from 1) and payload columns. Every operator ends in an explicit tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.context import materialise


def rank_by(df: DataFrame, query: str | list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Position (from 1) of each row within its query."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def top_k(df: DataFrame, query: str | list[str], k: int, *order: Column | str) -> DataFrame:
    """First ``k`` rows of each query; the limit reaches below the shuffle."""
    return rank_by(df, query, *order).where(F.col("rank") <= k)


def similarity_order(df: DataFrame, query: str, similarity: str, position: str) -> DataFrame:
    """Rank by similarity, non-numbers last, then by list position."""
    return rank_by(df, query, F.coalesce(F.col(similarity).cast("double"), F.lit(float("-inf"))).desc(), position)


def first_ranks(df: DataFrame, query: str = "query", key: str = "key") -> DataFrame:
    """Least rank of each key; later copies are ignored, but the ranks they took stay taken."""
    payload = [c for c in df.columns if c not in (query, key, "rank")]
    best = F.min(F.struct("rank", *payload)).alias("best") if payload else F.min(F.struct("rank")).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(query, key).agg(best).select(query, key, "best.*")


def dedupe_in_order(df: DataFrame, query: str = "query", key: str = "key", position: str = "rank") -> DataFrame:
    """First copy of each key, numbered anew."""
    first = df.where(F.col(key).isNotNull()).withColumn("copy", F.row_number().over(Window.partitionBy(query, key).orderBy(position))).where("copy = 1").drop("copy")
    return first.withColumn(position, F.row_number().over(Window.partitionBy(query).orderBy(position)))


def reciprocal_rank_fusion(sources: list[tuple[str, DataFrame]], weights: dict[str, float] | None = None, k: int = 60, limit: int | None = None, query: str = "query", key: str = "key", tie: list[str] = ()) -> DataFrame:
    """Weighted reciprocal-rank fusion of any number of rankings.

    Score is the sum of weight / (k + rank). Ties go to keys in more sources, then to the best rank, the first source, the
    ``tie`` columns of that source and the key. ``source_ranks`` maps every source that has the key to its rank.
    One shuffle by (query, key) and one by query.
    """
    parts = []
    for at, (name, df) in enumerate(sources):
        ranks = first_ranks(df.select(query, key, "rank", *tie), query, key)
        parts.append(ranks.withColumn("at", F.lit(at)).withColumn("name", F.lit(name)).withColumn("part", F.lit(float((weights or {}).get(name, 1.0))) / (k + F.col("rank"))))
    union = reduce(DataFrame.unionByName, parts)
    # added in source order, so that equal inputs give equal sums
    scores = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    fused = union.groupBy(query, key).agg(
        F.aggregate(scores, F.lit(0.0), lambda s, x: s + x).alias("score"), F.count(F.lit(1)).cast("int").alias("present"), F.min("rank").alias("best_rank"),
        F.min(F.struct("at", *tie)).alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rank")))).alias("source_ranks"),
    )
    fused = fused.select(query, key, "score", "present", "best_rank", F.col("first.at").alias("first_source"), *[F.col(f"first.{t}").alias(t) for t in tie], "source_ranks")
    fused = rank_by(fused, query, F.round("score", 12).desc(), F.col("present").desc(), "best_rank", "first_source", *tie, key)
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def file_fusion(sources: list[tuple[str, DataFrame]], k: int = 60, query: str = "query", file: str = "file") -> DataFrame:
    """Reciprocal-rank fusion of file rankings; ties by number of sources, best rank and path."""
    fused = reciprocal_rank_fusion(sources, None, k, None, query, file).drop("rank", "first_source")
    return rank_by(fused, query, F.round("score", 12).desc(), F.col("present").desc(), "best_rank", file)


MISSING_RANK = 9999


def min_rank_union(native: DataFrame, projected: DataFrame, query: str = "query", key: str = "key", tie: list[str] = ()) -> DataFrame:
    """Union ordered by the better of two ranks; natively ranked rows first, then by both ranks and the tie columns.

    A key that a ranking holds twice keeps its last rank there.
    """
    left = native.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.max("rank").alias("native_rank"), *[F.max_by(t, "rank").alias(f"l_{t}") for t in tie])
    right = projected.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.max("rank").alias("projected_rank"), *[F.max_by(t, "rank").alias(f"r_{t}") for t in tie])
    both = left.join(right, [query, key], "full_outer")
    a, b = F.coalesce("native_rank", F.lit(MISSING_RANK)), F.coalesce("projected_rank", F.lit(MISSING_RANK))
    both = both.select(query, key, "native_rank", "projected_rank", *[F.coalesce(f"l_{t}", f"r_{t}").alias(t) for t in tie])
    return rank_by(both, query, F.least(a, b), F.col("native_rank").isNull(), a, b, *tie, key)


def prefix_fill(primary: DataFrame, secondary: DataFrame, budget: int, prefix: int | None = None, query: str = "query", key: str = "key") -> DataFrame:
    """The first ``prefix`` distinct keys of the primary ranking (default: half the budget, rounded up), then the rest from the secondary one.

    Scores run 2.00, 1.99, ... by position.
    """
    prefix = -(-budget // 2) if prefix is None else prefix
    rows = primary.where(F.col("rank") <= prefix).select(query, key, F.lit(0).alias("source"), "rank").unionByName(secondary.select(query, key, F.lit(1).alias("source"), "rank"))
    rows = rows.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.min(F.struct("source", "rank")).alias("at"))
    out = rank_by(rows.select(query, key, F.col("at.source").alias("source"), F.col("at.rank").alias("source_rank")), query, "source", "source_rank", key)
    return out.where(F.col("rank") <= budget).withColumn("similarity", F.round(2.0 - 0.01 * (F.col("rank") - 1), 6))


def round_robin(sources: list[DataFrame], limit: int | None = None, query: str = "query", key: str = "key") -> DataFrame:
    """Interleave rankings depth by depth; the first copy of a key stays."""
    rows = reduce(DataFrame.unionByName, [df.select(query, key, "rank", F.lit(at).alias("source")) for at, df in enumerate(sources)])
    first = rows.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.min(F.struct("rank", "source")).alias("at"))
    out = rank_by(first.select(query, key, F.col("at.rank").alias("depth"), F.col("at.source").alias("source")), query, "depth", "source", key)
    return out if limit is None else out.where(F.col("rank") <= limit)


def bucket_round_robin(df: DataFrame, query: str, bucket: str, *order: Column | str) -> DataFrame:
    """Interleave buckets in bucket order: all firsts, all seconds, ..."""
    inside = df.withColumn("depth", F.row_number().over(Window.partitionBy(query, bucket).orderBy(*order)))
    return rank_by(inside, query, "depth", bucket, *order)


def append_anti(base: DataFrame, more: DataFrame, query: str = "query", key: str = "key") -> DataFrame:
    """Rows of ``more`` whose key the base does not hold, after the base."""
    return prefix_fill(base, more, 2**31 - 1, 2**31 - 1, query, key)


def file_primary(df: DataFrame, query: str = "query", file: str = "file", file_rank: str | None = None) -> DataFrame:
    """Stable order by file: its explicit rank, else after all explicit ones by first appearance."""
    whole = Window.partitionBy(query, file)
    explicit = F.min(F.col(file_rank) if file_rank else F.lit(None).cast("int")).over(whole)
    order = F.coalesce(explicit.cast("long"), F.lit(1_000_000) + F.min("rank").over(whole))
    return rank_by(df.withColumn("file_order", order).withColumnRenamed("rank", "list_rank"), query, "file_order", "list_rank")


def reciprocal_score(rank: Column) -> Column:
    return 1.0 / rank


def stable_random_order(df: DataFrame, query: str, *identity: str) -> DataFrame:
    """A random order that every run repeats: by the SHA-256 of query and identity."""
    return rank_by(df.withColumn("digest", F.sha2(F.concat_ws("|", F.col(query).cast("string"), *[F.col(c).cast("string") for c in identity]), 256)), query, "digest")


def same_file_tail(anchors: DataFrame, pool: DataFrame, query: str = "query", key: str = "key") -> DataFrame:
    """Pool rows in the anchors' files, nearest first: distance is the gap between line intervals, 0 when they overlap."""
    a = anchors.select(query, "file", F.col("start_line").alias("a_start"), F.coalesce("end_line", "start_line").alias("a_end"), F.col(key).alias("a_key"))
    known = anchors.select(query, key).distinct()
    near = pool.join(known, [query, key], "left_anti").join(a, [query, "file"])
    gap = F.greatest(F.lit(0), F.col("a_start") - F.coalesce("end_line", "start_line"), F.col("start_line") - F.col("a_end"))
    best = near.withColumn("gap", gap).groupBy(query, key, "file", "start_line").agg(F.min("gap").alias("gap"))
    return rank_by(best, query, "gap", "file", "start_line", key)


def same_file_top(anchors: DataFrame, pool: DataFrame, k: int, query: str = "query", key: str = "key", width: int = 64) -> DataFrame:
    """The first ``k`` of ``same_file_tail`` for a pool that all queries share, without reading whole files per anchor.

    Pool rows (key, file, start_line, end_line) stand in bins of lines, and anchors look into the bins around them. Queries that have
    not found k rows within the width, nor all there are in their files, look again at eight times the width.
    """
    span = lambda df, *more: df.where("start_line IS NOT NULL").select(*more, key, "file", "start_line", F.coalesce("end_line", "start_line").alias("end_line")).distinct()
    rows, left = materialise(span(pool), "tail-pool"), span(anchors, query)
    known = materialise(anchors.select(query, key).distinct(), "tail-known")
    files = left.select(query, "file").distinct()
    sizes = files.join(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file").groupBy(query).agg(F.sum("n").alias("n"))
    own = known.join(rows, key).join(files, [query, "file"], "left_semi").groupBy(query).agg(F.count(F.lit(1)).alias("own"))
    there = materialise(sizes.join(own, query, "left").select(query, (F.col("n") - F.coalesce("own", F.lit(0))).alias("there")), "tail-there")
    low, high = rows.unionByName(left.select(*rows.columns)).agg(F.min("start_line"), F.max("end_line")).first()
    out = None
    while True:
        last = low is None or width >= high - low
        near = left.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start_line") - width) / width), F.floor((F.col("end_line") + width) / width))))
        near = near.select(query, "file", "bin", F.col("start_line").alias("a_start"), F.col("end_line").alias("a_end"))
        binned = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
        gap = F.greatest(F.lit(0), F.col("a_start") - F.col("end_line"), F.col("start_line") - F.col("a_end"))
        met = near.join(binned, ["file", "bin"]).withColumn("gap", gap).where(F.col("gap") <= width)
        met = met.groupBy(query, key, "file", "start_line").agg(F.min("gap").alias("gap")).join(known, [query, key], "left_anti")
        best = materialise(top_k(met, query, k, "gap", "file", "start_line", key), "tail-best")
        found = there.join(best.groupBy(query).agg(F.count(F.lit(1)).alias("found")), query, "left").na.fill(0, ["found"])
        done = found.where(F.lit(last) | (F.col("found") >= F.least(F.lit(k), F.col("there")))).select(query)
        part = best.join(done, query, "left_semi")
        out = part if out is None else out.unionByName(part)
        left = left.join(done, query, "left_anti")
        if last or left.isEmpty():
            return out
        width *= 8
