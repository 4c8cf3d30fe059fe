"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A document's size is its number of words. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the total of all sizes; a target stops at ``MAX_REPEATS`` times its source's size and the excess goes to the others by
weight until none is above. A source whose target is ``r`` times its size takes ``floor(r)`` certain copies of each
document. The words that are then wanted come from a sample without replacement: a document's inclusion probability is proportional
to its size class (the power of two that its size reaches), such that the expected words are those wanted; classes for which
this would exceed one are certain units and are peeled off first. Every document gets a hashed uniform ``u`` and ranks by its random
odds ``u / (1 - u)`` over its inclusion odds. The first documents by rank whose words do not exceed those wanted get
one more copy, and one further document, if it closes the gap that is left better than none: the one whose size is nearest the gap.

Ranks are held as 52-bit integers. The cut in the rank order is found without sorting a source: words are summed by the leading
bits, the running sum goes over these sums, and the one interval with the cut is split again until it holds few rows. Whether a
document is taken follows from its own row and its source's cut, so texts are never shuffled.

Cases: null and empty texts have size 0 and take part with no words. Null source is a source. ``u`` hashes id, source and text:
rows that agree in all three are taken alike, as are ties of rank, so a group of repeated rows at the cut is in or out as a
whole. Very long texts are counted whole; one that exceeds what is wanted is only taken to close the gap. Empty tables give empty
results. If all sizes are 0, all targets are 0. Columns that are called like the result's are ignored by ``mix`` and kept by
``mixed_documents``. Every rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.frames import fresh
from rankloom.llm.storage import stash

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
RANK_BITS = 52
#: Leading bits by which an interval of ranks is split.
SPLIT_BITS = 11
#: An interval with the cut is split until it holds no more rows than this.
EDGE_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def uniform_of(doc_id: Column, source: Column, text: Column) -> Column:
    """A number between 0 and 1 (both exclusive) from the MD5 of id, source and the text's MD5."""
    nothing = F.lit("")
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), nothing), F.coalesce(source, nothing), F.md5(F.coalesce(text, nothing).cast("binary")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << RANK_BITS))


def size_class(size: Column) -> Column:
    """The largest power of two that the size reaches; 0 for 0."""
    return F.when(size > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size)) - 1)).otherwise(F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """sid, source, source_size, target of sources (source, source_size): one row per source, which is what the windows sort.

    Sources reach their limit in the order of size over weight; when the next one would not, none of the rest does.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight)
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = lambda c: F.coalesce(F.sum(c).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", (F.sum("source_size").over(every) - most * before("source_size")).cast("double")).withColumn("weights", F.sum("weight").over(every) - before("weight"))
    over = (F.col("weight") * (F.col("left") / F.col("weights")) > most * F.col("source_size")).cast("int")
    rows = rows.withColumn("full", F.min(over).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    share = F.first(F.when(~F.col("full"), F.col("left") / F.col("weights")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * share)
    return rows.select("sid", "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, class and uniform of each document, written once to the shared folder."""
    size = words_of(docs["text"])
    return stash(docs.select(docs["doc_id"], docs["source"], size.alias("size"), size_class(size).alias("class"), uniform_of(docs["doc_id"], docs["source"], docs["text"]).alias("u")), "sizes")


def chances(base: DataFrame) -> DataFrame:
    """Per source and size class: sid, source, class, source_size, target, certain copies, wanted words, chance of one more."""
    classes = stash(base.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    plan = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    certain = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(0).cast("int")
    plan = plan.withColumn("certain", certain).withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
    named = plan.select(F.col("source").alias("name"), "sid", "source_size", "target", "certain", "wanted")
    rows = classes.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    down = Window.partitionBy("sid").orderBy(F.col("class").desc())  # a source has fewer than 64 classes
    above = F.col("wanted") - F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("class") * F.col("words")).over(Window.partitionBy("sid").orderBy("class").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("above", above).withColumn("mass", mass)
    peeled = ((F.col("wanted") > 0) & (F.col("class") > 0) & (F.col("above") * F.col("class") >= F.col("mass"))).cast("int")
    rows = rows.withColumn("peeled", F.min(peeled).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    rest = F.first(F.when(~F.col("peeled"), F.struct("above", "mass")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chance = F.when(F.col("peeled"), 1.0).when(F.col("class") > 0, F.greatest(rest["above"], F.lit(0.0)) * F.col("class") / rest["mass"]).otherwise(0.0)
    return rows.select("sid", "source", "class", "source_size", "target", "certain", "wanted", chance.alias("chance"))


def place_of(u: Column, chance: Column) -> Column:
    """Rank of a document: its random odds over its inclusion odds ``o``, as ``o / (1 + o)`` in 52 bits; null without a chance."""
    odds, against = u * (1 - chance), (1 - u) * chance
    return F.when(chance > 0, F.floor(odds / (odds + against) * F.lit(float(1 << RANK_BITS))).cast("long"))


def cuts(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: sid, last (largest rank whose prefix does not exceed the wanted words) and closing (rank that closes the gap, or null).

    ``ranked``: sid, size, place. ``sources``: sid, wanted.
    """
    wanted = sources.select("sid", "wanted")
    inside, shift = ranked.withColumn("before", F.lit(0).cast("long")), RANK_BITS - SPLIT_BITS
    while True:
        sums = inside.groupBy("sid", "before", F.shiftright("place", shift).alias("prefix")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("sid").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(wanted, "sid")
        found = stash(sums.where((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted"))).select("sid", "prefix", "before", "n"), "cuts")
        most = found.agg(F.max("n")).first()[0] or 0
        inside = ranked.join(found.select("sid", "prefix", "before"), "sid").where(F.shiftright("place", shift) == F.col("prefix")).drop("prefix")
        if most <= EDGE_ROWS or not shift:
            break
        shift = max(shift - SPLIT_BITS, 0)
    groups = inside.groupBy("sid", "before", "place").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = groups.withColumn("upto", upto).join(wanted, "sid").where(F.col("upto") <= F.col("wanted")).groupBy("sid").agg(F.max("place").alias("place"), F.max("upto").alias("upto"))
    # a source without a cut is needed whole; one whose first rows of the interval do not fit ends before the interval
    last = F.coalesce(F.col("place"), F.shiftleft("prefix", shift) - 1, F.lit((1 << RANK_BITS) + 1).cast("long"))
    edge = wanted.join(found, "sid", "left").join(fits, "sid", "left").select("sid", last.alias("last"), (F.col("wanted") - F.coalesce("upto", "before")).alias("gap"))
    edge = stash(edge, "edges")
    off = F.abs(F.col("size") - F.col("gap"))
    closing = ranked.join(edge, "sid").where((F.col("place") > F.col("last")) & (off < F.col("gap"))).groupBy("sid").agg(F.min(F.struct(off.alias("off"), "place")).alias("best"))
    return edge.join(closing, "sid", "left").select("sid", "last", F.col("best.place").alias("closing"))


def plan_of(base: DataFrame) -> DataFrame:
    """Per source and size class what decides on a document: source, class, source_size, target, certain, chance, last, closing."""
    plan = stash(chances(base), "chances")
    ranked = with_plan(base.where("size > 0"), plan).withColumn("place", place_of(F.col("u"), F.col("chance"))).where("place IS NOT NULL").select("sid", "size", "place")
    found = cuts(ranked, plan.select("sid", "wanted").distinct())
    return stash(plan.join(found, "sid"), "mix-plan")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, class, ...) with the other columns of their source's and class's row; Spark broadcasts the plan by its size."""
    right = plan.withColumnsRenamed({"source": "plan_source", "class": "plan_class"})
    return rows.join(right, rows["source"].eqNullSafe(right["plan_source"]) & (rows["class"] == right["plan_class"])).drop("plan_source", "plan_class")


def _copies(place: Column) -> Column:
    extra = F.coalesce((place <= F.col("last")) | (place == F.col("closing")), place <= F.col("last"), F.lit(False))
    return F.col("certain") + extra.cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    base = sized(docs)
    planned = with_plan(base, plan_of(base))
    copies = _copies(place_of(F.col("u"), F.col("chance")))
    return planned.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, with the columns they came with."""
    row, copies, again = fresh(docs, "mix_row", "mix_copies", "mix_again")
    plan = plan_of(sized(docs))
    size = words_of(docs["text"])
    held = docs.select(F.struct(*docs.columns).alias(row), docs["source"].alias("source"), size_class(size).alias("class"), uniform_of(docs["doc_id"], docs["source"], docs["text"]).alias("u"))
    taken = with_plan(held, plan).select(row, _copies(place_of(F.col("u"), F.col("chance"))).alias(copies)).where(F.col(copies) > 0)
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(f"{row}.*")
