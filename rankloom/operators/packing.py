"""Budgets, bands and context: how much of a ranking fits, and which part."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIMARY_SPLIT, PER_BAND, PER_FILE = 10, 4, 2
#: Lines of a class that a context takes at most (fixed value).
MOST_SCOPE = 180


def pack_prefix(df: DataFrame, budgets: list[int], query: str = "query", rank: str = "rank", tokens: str = "tokens") -> DataFrame:
    """Rows of the longest rank prefix within each token budget, with the running total.

    Cost is additive, so the prefix is where a running sum stays within the budget; one row too large ends it.
    """
    spark = df.sparkSession
    total = F.sum(tokens).over(Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = spark.createDataFrame([(x,) for x in budgets], "budget int")
    return df.withColumn("total", total).crossJoin(F.broadcast(b)).where(F.col("total") <= F.col("budget"))


def pack_summary(packed: DataFrame, candidates: DataFrame, budgets: list[int], query: str = "query") -> DataFrame:
    """Per query and budget: candidates, selected rows, tokens used and fill; queries without a fit count as zero."""
    b = candidates.sparkSession.createDataFrame([(x,) for x in budgets], "budget int")
    spine = candidates.groupBy(query).agg(F.count(F.lit(1)).alias("candidates")).crossJoin(F.broadcast(b))
    got = packed.groupBy(query, "budget").agg(F.count(F.lit(1)).alias("selected"), F.max("total").alias("used"))
    return spine.join(got, [query, "budget"], "left").na.fill(0, ["selected", "used"]).withColumn("fill", F.round(F.col("used") / F.col("budget"), 6))


def pack_exact(df: DataFrame, budget: int, render, count, query: str = "query") -> DataFrame:
    """The same for a cost that is not additive: ``count(render(rows))`` is searched by bisection in one query's rows.

    ``df``: query, rank, key, text. Returns query, key, rank, used.
    """
    kind = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = rows.sort_values("rank").to_dict("records")
        low, high = 0, len(items)
        while low < high:
            middle = (low + high + 1) // 2
            if count(render(items[:middle])) <= budget:
                low = middle
            else:
                high = middle - 1
        used = count(render(items[:low])) if low else 0
        return pd.DataFrame([(r[query], r["key"], r["rank"], used) for r in items[:low]], columns=[query, "key", "rank", "used"])

    return df.groupBy(query).applyInPandas(run, f"{query} {kind[query]}, key {kind['key']}, rank int, used long")


def packable(df: DataFrame, cap: int = 50, query: str = "query", key: str = "key") -> DataFrame:
    """Candidates with source text, first copy of each key, at most ``cap`` of them."""
    from rankloom.operators.ranking import dedupe_in_order

    return dedupe_in_order(df.where(F.length(F.trim("text")) > 0), query, key).where(F.col("rank") <= cap)


def pack_greedy(df: DataFrame, budget: int, render, count, query: str = "query") -> DataFrame:
    """Rows in rank order, each taken if the rendered context with it stays within the budget; the first always is.

    ``df``: query, rank, key, text; as many rows as ``packable`` leaves. Returns query, key, rank, used.
    """
    kind = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[dict] = []
        for item in rows.sort_values("rank").to_dict("records"):
            if not taken or count(render([*taken, item])) <= budget:
                taken.append(item)
        used = count(render(taken)) if taken else 0
        return pd.DataFrame([(r[query], r["key"], r["rank"], used) for r in taken], columns=[query, "key", "rank", "used"])

    return df.groupBy(query).applyInPandas(run, f"{query} {kind[query]}, key {kind['key']}, rank int, used long")


def demote_and_drop(df: DataFrame, budget: int, render, count, query: str = "query") -> DataFrame:
    """The bands' rows made to fit: sources become metadata from the end, then metadata go from the end, band by band.

    ``df``: query, rank, key, band (primary or tail), text. ``render`` gets rows with a ``mode``, source or metadata. In a step the last
    source of each band that has more than one is demoted, the tail's first; when no band has, the last metadata row of
    each goes. A context that never fits is empty. Returns query, key, rank, band, mode, used; a query has a few rows.
    """
    kind = dict(df.dtypes)

    def step(items: list[dict]) -> bool:
        last = lambda band, mode: [r for r in items if r["band"] == band and r["mode"] == mode]
        sources = [found for band in ("tail", "primary") if len(found := last(band, "source")) > 1]
        for found in sources:
            found[-1]["mode"] = "metadata"
        gone = [] if sources else [found[-1] for band in ("tail", "primary") if (found := last(band, "metadata"))]
        for r in gone:
            items.remove(r)
        return bool(sources or gone)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = [r | {"mode": "source"} for r in rows.sort_values("rank").to_dict("records")]
        while items and count(render(items)) > budget:
            if not step(items):
                items = []
        used = count(render(items)) if items else 0
        return pd.DataFrame([(r[query], r["key"], r["rank"], r["band"], r["mode"], used) for r in items], columns=[query, "key", "rank", "band", "mode", "used"])

    return df.groupBy(query).applyInPandas(run, f"{query} {kind[query]}, key {kind['key']}, rank int, band string, mode string, used long")


def rank_bands(df: DataFrame, split: int = PRIMARY_SPLIT, per_band: int = PER_BAND, per_file: int = PER_FILE, query: str = "query") -> DataFrame:
    """Primary band (rank up to ``split``) and tail, each with at most ``per_file`` rows of a file and ``per_band`` rows.

    A key counts at its first rank in a band, and one taken in the first band is not taken again in the second.
    """
    rows = df.select(query, "key", "file", F.col("rank").cast("int").alias("rank"))

    def band(part: DataFrame, name: str) -> DataFrame:
        for by, most, column in ((["key"], 1, "nth"), (["file"], per_file, "nth"), ([], per_band, "position")):
            part = part.withColumn(column, F.row_number().over(Window.partitionBy(query, *by).orderBy("rank"))).where(F.col(column) <= most)
        return part.select(query, "key", "file", "rank", F.lit(name).alias("band"), "position")

    first = band(rows.where(F.col("rank") <= split), "primary")
    later = rows.where(F.col("rank") > split).join(first.select(query, "key"), [query, "key"], "left_anti")
    return first.unionByName(band(later, "tail"))


def class_scope(items: DataFrame, classes: DataFrame, contents: DataFrame, most: int = MOST_SCOPE, query: str = "query") -> DataFrame:
    """Items widened to the class around them: the columns they came with, start_line, end_line and text replaced, and context_class.

    ``items``: query, key, file, signature, start_line, end_line, text. ``classes``: file, name (simple), start, end. ``contents``: file, content.
    The class is the smallest of those that the signature names last before its own name, else of those that hold the start line. An
    item with a text in a class of more than ``most`` lines stays as it is; without one, or outside the named class, the
    first ``most`` lines are taken.
    """
    parts = F.filter(F.split(F.trim(F.regexp_extract(F.coalesce("signature", F.lit("")), "^([^(:]*)", 1)), r"\."), lambda x: x != "")
    named = items.select(query, "key", "file", F.col("start_line").alias("at"), F.posexplode_outer(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("place", "name"))
    by_name = named.join(classes, ["file", "name"]).withColumn("way", F.lit(0))
    around = items.select(query, "key", "file", F.col("start_line").alias("at")).join(classes, "file").where("start <= at AND at <= end AND at > 0").withColumn("way", F.lit(1)).withColumn("place", F.lit(0))
    found = by_name.unionByName(around).groupBy(query, "key", "file").agg(F.min(F.struct("way", (-F.col("place")).alias("last"), (F.col("end") - F.col("start")).alias("span"), "start", "end", "name")).alias("c"))
    rows = items.join(found, [query, "key", "file"], "left").join(contents.select("file", F.split("content", "\r\n|\n|\r").alias("lines")), "file", "left")
    long = F.col("c.span") >= most
    inside = F.col("start_line").between(F.col("c.start"), F.col("c.end"))
    widened = F.col("c").isNotNull() & F.col("lines").isNotNull() & ~(long & inside & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    last = F.least(F.col("c.end"), F.col("c.start") + most - 1)
    excerpt = F.array_join(F.slice("lines", F.col("c.start"), last - F.col("c.start") + 1), "\n")
    new = {"start_line": F.col("c.start"), "end_line": last, "text": excerpt}
    picked = [F.when(widened, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns]
    return rows.select(*picked, F.when(widened, F.col("c.name")).alias("context_class"))


def diverse_order(df: DataFrame, query: str = "query") -> DataFrame:
    """Files first: the best row of each leading file (1, 3 or 6 files by pool size), then all others in rank order."""
    from rankloom.operators.ranking import rank_by

    size = F.count(F.lit(1)).over(Window.partitionBy(query))
    lead = F.when(size <= 3, 1).when(size <= 10, 3).otherwise(6)
    in_file = F.row_number().over(Window.partitionBy(query, "file").orderBy("rank"))
    rows = df.withColumn("lead", lead).withColumn("in_file", in_file)
    first = F.when(F.col("in_file") == 1, F.row_number().over(Window.partitionBy(query).orderBy(F.col("in_file") != 1, "rank")))
    rows = rows.withColumn("file_order", first)
    ahead = (F.col("in_file") == 1) & (F.col("file_order") <= F.col("lead"))
    return rank_by(rows.withColumn("ahead", ahead).withColumnRenamed("rank", "list_rank"), query, F.col("ahead").desc(), "list_rank", "key").drop("lead", "in_file", "file_order")


def one_per_file(df: DataFrame, limit: int, query: str = "query") -> DataFrame:
    """Best row of each file, at most ``limit``."""
    from rankloom.operators.ranking import rank_by

    best = df.withColumn("in_file", F.row_number().over(Window.partitionBy(query, "file").orderBy("rank"))).where("in_file = 1").drop("in_file")
    return rank_by(best.withColumnRenamed("rank", "list_rank"), query, "list_rank", "key").where(F.col("rank") <= limit)


def render_by_file(df: DataFrame, query: str = "query") -> DataFrame:
    """One text per query: files in order of their best rank, under each its rows in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    files = df.groupBy(query, "file").agg(F.min("rank").alias("first"), F.concat(F.lit("### "), F.first("file"), F.lit("\n"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n")).alias("block"))
    blocks = F.array_sort(F.collect_list(F.struct("first", "file", "block")))
    return files.groupBy(query).agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def render_window(df: DataFrame, limit: int = 20, query: str = "query") -> DataFrame:
    """Numbered lines 'NN. path :: signature' of the first ``limit`` rows."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.format_string("%02d. %s :: %s", "rank", "file", "signature").alias("line"))))
    return df.where(F.col("rank") <= limit).groupBy(query).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("window"))


def evaluation_slots(df: DataFrame, instance: str, variant: str, text: str, prompt: str) -> DataFrame:
    """Same text and prompt share a slot; slots are numbered by first appearance in variant order."""
    digest = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(prompt), F.lit(""))), 256)
    rows = df.withColumn("digest", digest)
    first = rows.groupBy(instance, "digest").agg(F.min(variant).alias("first"))
    first = first.withColumn("slot", F.row_number().over(Window.partitionBy(instance).orderBy("first", "digest"))).drop("first")
    return rows.join(first, [instance, "digest"])


def first_applicable(df: DataFrame, instance: str, attempt: str, applied: str, value: str) -> DataFrame:
    """Value of the first attempt that applied."""
    return df.where(F.col(applied)).groupBy(instance).agg(F.min_by(value, attempt).alias(value), F.min(attempt).alias(attempt))


def balanced_shards(df: DataFrame, group: str, shards: int) -> dict[str, int]:
    """Groups to shards: the largest group to the least loaded shard. Sizes of groups alone reach the driver."""
    load, out = [0] * shards, {}
    for r in sorted(df.groupBy(group).count().collect(), key=lambda r: (-r["count"], r[group])):
        at = min(range(shards), key=lambda k: (load[k], k))
        out[r[group]] = at
        load[at] += r["count"]
    return out


#: What is shown of the items of a breadth context by position, and of a retry's (fixed values).
BREADTH_MODES, RETRY_MODES = ["primary", "secondary", "secondary", "secondary", "metadata", "metadata"], ["primary", "secondary", "secondary", "metadata"]
FOCUS_ITEMS, RETRY_FILES, RETRY_PER_FILE = 4, 2, 3


def _placed(df: DataFrame, query: str, modes: list[str] | None, *order: Column | str) -> DataFrame:
    rows = df.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return rows if modes is None else rows.withColumn("mode", F.element_at(F.array(*map(F.lit, modes)), F.least("position", F.lit(len(modes)))))


def breadth_items(df: DataFrame, query: str = "query") -> DataFrame:
    """The first item of each of the first six files (query, key, file, rank), with position and mode: many files, little of each."""
    first = df.withColumn("nth", F.row_number().over(Window.partitionBy(query, "file").orderBy("rank"))).where("nth = 1").drop("nth")
    return _placed(first, query, BREADTH_MODES, "rank").where(F.col("position") <= len(BREADTH_MODES))


def focus_items(df: DataFrame, query: str = "query") -> DataFrame:
    """The first file's first four candidates (its items, if none is one) and the first item of the next file, with position.

    ``df``: query, key, file, rank, candidate. One file in depth and a look at another.
    """
    whole = Window.partitionBy(query)
    rows = df.withColumn("lead", F.min_by("file", "rank").over(whole))
    inside = F.col("file") == F.col("lead")
    rows = rows.withColumn("any", F.max((inside & F.col("candidate")).cast("int")).over(whole) == 1)
    usable = F.when(inside, F.col("candidate") | ~F.col("any")).otherwise(True)
    side = inside.cast("int").alias("side")
    rows = rows.where(usable).withColumn("other", 1 - side)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(query, "other").orderBy("rank")))
    kept = rows.where((F.col("other") == 0) & (F.col("nth") <= FOCUS_ITEMS) | (F.col("other") == 1) & (F.col("nth") == 1))
    return _placed(kept.drop("lead", "any", "nth"), query, None, "other", "rank").drop("other")


def retry_items(df: DataFrame, targets: DataFrame, query: str = "query") -> DataFrame:
    """At most three items of each of the first two files that an attempt named (query, file, place), with position and mode."""
    named = targets.groupBy(query, "file").agg(F.min("place").alias("place"))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("place", "file"))).where(F.col("n") <= RETRY_FILES).select(query, "file")
    rows = df.join(named, [query, "file"]).withColumn("nth", F.row_number().over(Window.partitionBy(query, "file").orderBy("rank")))
    return _placed(rows.where(F.col("nth") <= RETRY_PER_FILE).drop("nth"), query, RETRY_MODES, "rank")
