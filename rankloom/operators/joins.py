"""Key joins with contracts, and matches by prefix, suffix, part and similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.context import materialise


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    union = reduce(DataFrame.unionByName, [df.select(key).distinct().withColumn("at", F.lit(k)) for k, df in enumerate(frames)])
    return union.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(frames)).select(key)


def equal_keys(left: DataFrame, right: DataFrame, keys: list[str], message: str = "keys differ") -> DataFrame:
    """Full-key equality join; fails on a row without its partner."""
    l, r = left.withColumn("in_left", F.lit(True)), right.withColumn("in_right", F.lit(True))
    both = l.join(r, keys, "full_outer")
    fails = F.assert_true(F.col("in_left").isNotNull() & F.col("in_right").isNotNull(), message)
    return both.withColumn("checked", fails.isNull()).where("checked").drop("in_left", "in_right", "checked")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side: a contract holds when this is empty."""
    a = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(*keys).distinct().join(left.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("right")))


def merge_update(old: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with updated columns where an update exists; updates of unknown keys are left to ``unmatched``."""
    new = updates.select(key, F.lit(True).alias("updated"), *[F.col(c).alias(f"new_{c}") for c in columns])
    both = old.join(new, key, "left")
    return both.select(*[F.when(F.col("updated"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns], F.coalesce("updated", F.lit(False)).alias("updated"))


def reuse_by_hash(rows: DataFrame, outcomes: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """Outcomes of the same key whose text is the same by SHA-256."""
    known = outcomes.select(key, F.sha2(F.col(text), 256).alias("digest"), *columns).dropDuplicates([key, "digest"])
    return rows.withColumn("digest", F.sha2(F.col(text), 256)).join(known, [key, "digest"], "left")


def fan_out(variants: DataFrame, slots: DataFrame, reports: DataFrame, key: str, text: str) -> DataFrame:
    """Reports of canonical slots for every variant; fails when a variant's text is not its slot's."""
    joined = variants.join(slots.select(key, "variant", "slot"), [key, "variant"]).join(reports.withColumnRenamed(text, "slot_text"), [key, "slot"])
    return joined.withColumn("same", F.assert_true(F.sha2(text, 256) == F.sha2("slot_text", 256), "slot holds another text").isNull()).where("same").drop("same", "slot_text")


def prefix_match(left: DataFrame, right: DataFrame, group: str, name: str, prefix: str) -> DataFrame:
    """Names equal to a prefix or below it (prefix.x): every dotted prefix of the name is looked up by equality."""
    parts = F.split(F.col(name), r"\.")
    steps = left.withColumn(prefix, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    return steps.join(right, [group, prefix])


def suffix_match(left: DataFrame, right: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Paths of a group where one ends with the other.

    Every ending of a path, as long as some path of the other side, is a key that the other side's whole paths are looked up by: rows
    grow with the lengths of paths, not with pairs of a group.
    """

    def endings(paths: DataFrame, name: str, others: DataFrame, other: str) -> DataFrame:
        sizes = others.select(group, F.length(other).alias("size")).distinct()  # of every group, only lengths that it has
        sized = sizes.groupBy(group).agg(F.collect_set("size").alias("sizes"))
        fits = F.filter("sizes", lambda n: n <= F.length(name))
        return paths.join(sized, group).withColumn(other, F.explode(F.transform(fits, lambda n: F.substring(F.col(name), F.length(name) - n + 1, n)))).drop("sizes")

    out = [group, *[c for c in left.columns if c != group], *[c for c in right.columns if c != group]]
    ends = endings(left, a, right, b).join(right, [group, b]).select(*out)
    # equal paths are there already
    ended = endings(right, b, left, a).where(F.length(a) < F.length(b)).join(left, [group, a]).select(*out)
    return ends.unionByName(ended)


#: Characters of the pieces by which substrings are looked up.
PIECE = 3


def _holders(texts: DataFrame, group: str, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of both where the text of a group holds the part.

    A part is looked up by its rarest piece among the texts of its group (by itself, where it is shorter than a piece); texts are posted under
    the pieces that some part is looked up by, and what meets is compared in full.
    """
    n = F.length(F.col(text))
    every = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col(text), i, F.lit(size)))
    none = F.array().cast("array<string>")
    pieces = F.concat(F.array(F.lit("")), *[F.when(n >= size, every(size)).otherwise(none) for size in range(1, PIECE + 1)])
    distinct = texts.select(group, text).distinct()
    posted = distinct.select(group, text, F.explode(F.array_distinct(pieces)).alias("piece"))
    counted = posted.groupBy(group, "piece").agg(F.count(F.lit(1)).alias("n"))
    m = F.length(F.col(part))
    own = F.when(m < PIECE, F.array(F.col(part))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(m - PIECE + 1, F.lit(1))), lambda i: F.substring(F.col(part), i, F.lit(PIECE))))
    asked = parts.where(F.col(part).isNotNull()).select(group, part).distinct().withColumn("pieces", F.array_distinct(own))
    held = asked.select(group, part, F.size("pieces").alias("size"), F.explode("pieces").alias("piece")).join(counted, [group, "piece"])
    # a part with a piece that no text has is in none
    rarest = held.groupBy(group, part).agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count(F.lit(1)).alias("known"), F.max("size").alias("size")).where("known = size")
    met = posted.join(rarest.select(group, part, "piece"), [group, "piece"]).where(F.contains(F.col(text), F.col(part))).select(group, text, part)
    return met.join(texts, [group, text]).join(parts, [group, part])


def contains_match(left: DataFrame, right: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Paths of a group where one holds the other."""
    out = [group, *[c for c in left.columns if c != group], *[c for c in right.columns if c != group]]
    held = _holders(left, group, a, right, b).select(*out)
    holding = _holders(right, group, b, left, a).where(F.col(a) != F.col(b)).select(*out)
    return held.unionByName(holding)


def longest_prefix(left: DataFrame, right: DataFrame, name: str, prefix: str) -> DataFrame:
    """The longest dotted prefix of a name that the right table knows."""
    parts = F.split(F.col(name), r"\.")
    steps = left.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn(prefix, F.array_join(F.slice(parts, F.lit(1), F.col("n")), "."))
    order = Window.partitionBy(*left.columns).orderBy(F.col("n").desc())
    return steps.join(right, prefix).withColumn("r", F.dense_rank().over(order)).where("r = 1").drop("r", "n")


def exact_or_members(labels: DataFrame, entities: DataFrame, group: str) -> DataFrame:
    """Labels joined to entities of their name; a label without one gives the direct members of the class it names."""
    exact = labels.join(entities, [group, "name"])
    rest = labels.join(entities.select(group, "name").distinct(), [group, "name"], "left_anti")
    members = entities.withColumn("owner", F.regexp_replace("name", r"\.[^.]*$", "")).where("owner <> name")
    below = rest.withColumnRenamed("name", "owner").join(members, [group, "owner"])
    return exact.select(*labels.columns, *[c for c in entities.columns if c not in (group, "name")], F.col("name").alias("entity")).unionByName(below.select(group, F.col("owner").alias("name"), *[c for c in labels.columns if c not in (group, "name")], *[c for c in entities.columns if c not in (group, "name")], F.col("name").alias("entity")))


def cascade(left: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str, ordinal: str) -> DataFrame:
    """Look a row up by one key list after another; the first level that knows it wins, there the least ordinal."""
    out = left
    names = []
    for n, (right, keys) in enumerate(levels):
        names.append(f"v{n}")
        out = out.join(right.groupBy(*keys).agg(F.min_by(value, ordinal).alias(names[-1])), keys, "left")
    return out.withColumn(value, F.coalesce(*names)).withColumn("level", F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names)])).drop(*names)


def name_variations(name: Column) -> Column:
    """Last one, two and three dotted parts of a name."""
    parts = F.split(name, r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(parts))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over the longer length (1 for two empty texts)."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 1.0 if not x and not y else 0.0
        # a row of the table is held as the bits of one integer: a zero bit where the length grows
        places: dict[str, int] = {}
        for k, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << k
        full = row = (1 << len(x)) - 1
        for c in y:
            same = row & places.get(c, 0)
            row = ((row + same) | (row - same)) & full
        return (len(x) - row.bit_count()) / max(len(x), len(y))

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def _pairs_of(texts: DataFrame, block: str, name: str) -> DataFrame:
    """(block, text, gram, n): how often each pair of neighbouring characters stands in a text."""
    places = F.when(F.length(name) > 1, F.sequence(F.lit(1), F.length(name) - 1)).otherwise(F.array().cast("array<int>"))
    grams = texts.select(block, name, F.explode(F.transform(places, lambda i: F.substring(F.col(name), i, F.lit(2)))).alias("gram"))
    return grams.groupBy(block, name, "gram").agg(F.count(F.lit(1)).alias("n"))


def _most_ratio(shared: Column, a: Column, b: Column) -> Column:
    """The greatest sequence ratio that texts of lengths a and b with so many shared neighbour pairs can have.

    A common subsequence of length m leaves at least 3 m - a - b - 1 of the pairs of neighbours together: every character that is not in it
    parts at most two pairs of its own text, or one of the other's.
    """
    longest = F.least(F.floor((shared + a + b + 1) / 3), a, b)
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(longest / F.greatest(a, b))


def fuzzy_best(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float = 0.0) -> DataFrame:
    """(block, a, b, ratio): for each left text the right text of its block with the greatest sequence ratio; ties to the smaller text.

    Pairs of neighbouring characters are counted by an equi-join and bound the ratio. The text with the best bound is compared first;
    then only texts whose bound reaches what it gave, and of those that share no pair only lengths that can reach it. Nothing
    that could be best is left out. Rows with a null text are.
    """
    asked = left.where(F.col(a).isNotNull()).select(block, a).distinct()
    known = right.where(F.col(b).isNotNull()).select(block, b).distinct()
    met = _pairs_of(asked, block, a).join(_pairs_of(known, block, b).withColumnRenamed("n", "m"), [block, "gram"])
    shared = met.groupBy(block, a, b).agg(F.sum(F.least("n", "m")).alias("shared"))
    shared = materialise(shared.withColumn("bound", _most_ratio(F.col("shared"), F.length(a), F.length(b))), "fuzzy-shared")
    first = shared.groupBy(block, a).agg(F.min(F.struct((-F.col("bound")).alias("o"), F.col(b))).alias("f")).select(block, a, F.col(f"f.{b}").alias(b))
    reached = asked.join(first.withColumn("reached", sequence_ratio(F.col(a), F.col(b))).drop(b), [block, a], "left")
    reached = materialise(reached.withColumn("reached", F.greatest(F.coalesce("reached", F.lit(0.0)), F.lit(least))), "fuzzy-reached")
    near = shared.join(reached, [block, a]).where(F.col("bound") >= F.col("reached")).select(block, a, b)
    sized = known.withColumn("size", F.length(b))
    sizes = sized.groupBy(block).agg(F.collect_set("size").alias("sizes"))  # distinct lengths of a block
    fits = F.filter("sizes", lambda n: _most_ratio(F.lit(0), F.length(a), n) >= F.col("reached"))
    apart = reached.join(sizes, block).select(block, a, F.explode(fits).alias("size")).join(sized, [block, "size"]).select(block, a, b).join(shared, [block, a, b], "left_anti")
    scored = near.unionByName(apart).withColumn("ratio", sequence_ratio(F.col(a), F.col(b))).where(F.col("ratio") >= least)
    best = scored.groupBy(block, a).agg(F.min(F.struct((-F.col("ratio")).alias("o"), F.col(b))).alias("f"))
    return best.select(block, a, F.col(f"f.{b}").alias(b), (-F.col("f.o")).alias("ratio"))


#: Least score of a resolved path, and what the same folder and a name that starts alike add (fixed values).
LEAST_PATH_SCORE, SAME_FOLDER, SAME_START = 0.72, 0.15, 0.1


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, as the standard library's sequence matcher counts them."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def resolve_paths(wanted: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, wanted, path, score) of wanted paths: the path itself where the group has it, else the most similar one.

    Candidates have the wanted extension, if there is one. Only pairs whose lengths can reach the least score are compared; of
    equal scores the path that sorts last wins.
    """
    extension = lambda c: F.regexp_extract(c, r"[^/.][^/]*(\.[^./]*)$", 1)
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    w, p = F.col("wanted"), F.col("path")
    asked = wanted.select(group, F.replace(w, F.lit("\\"), F.lit("/")).alias("wanted")).distinct()
    exact = asked.join(files.select(group, p.alias("wanted")).distinct(), [group, "wanted"]).select(group, "wanted", w.alias("path"), F.lit(1.0).alias("score"))
    rest = asked.join(exact.select(group, "wanted"), [group, "wanted"], "left_anti").withColumn("ext", extension(w))
    known = files.select(group, "path").distinct()
    typed = rest.where("ext <> ''").join(known.withColumn("ext", extension(p)), [group, "ext"]).unionByName(rest.where("ext = ''").join(known, group).select(group, "ext", "wanted", "path"))
    stem = F.regexp_replace(F.element_at(F.split(w, "/"), -1), r"(?<=[^.])\.[^.]*$", "")
    bonus = F.when((folder(w) != "") & (folder(w) == folder(p)), SAME_FOLDER).otherwise(0.0)
    bonus = bonus + F.when((F.element_at(F.split(w, "/"), -1) != "") & F.startswith(F.element_at(F.split(p, "/"), -1), stem), SAME_START).otherwise(0.0)
    most = 2 * F.least(F.length(w), F.length(p)) / (F.length(w) + F.length(p))
    scored = typed.withColumn("bonus", bonus).where(most + F.col("bonus") >= LEAST_PATH_SCORE).withColumn("score", matching_ratio(w, p) + F.col("bonus"))
    best = scored.where(F.col("score") >= LEAST_PATH_SCORE).groupBy(group, "wanted").agg(F.max(F.struct("score", "path")).alias("b"))
    return exact.unionByName(best.select(group, "wanted", "b.path", "b.score"))


def path_similarity(a: Column, b: Column) -> Column:
    """2000 for the same folder, up to 300 for the file name, 10 per shared part and 1 per ordered pair of neighbours."""
    pa, pb = F.split(a, "/"), F.split(b, "/")
    fa, fb = F.element_at(pa, -1), F.element_at(pb, -1)
    folder = F.when(F.slice(pa, F.lit(1), F.size(pa) - 1) == F.slice(pb, F.lit(1), F.size(pb) - 1), 2000).otherwise(0)
    longer = F.greatest(F.length(fa), F.length(fb))
    file = F.when(longer == 0, 0.0).otherwise(300.0 * (1 - F.levenshtein(fa, fb) / longer))
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.concat_ws("/", x, y))
    return folder + file + 10 * F.size(F.array_intersect(pa, pb)) + F.size(F.array_intersect(pairs(pa), pairs(pb)))


#: Files of a folder that are compared one by one, deletions by which near names meet in larger ones, the longest names that two of them are
#: taken from, and the parts of a path all of whose sets are looked up.
FEW_FILES, DELETIONS, LONG_NAME, FEW_PARTS = 64, 2, 24, 4


def _without(names: Column) -> Column:
    """The names, and each without one of its characters."""
    cut = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(names, F.flatten(F.transform(names, cut))))


def _shared_sets(path: Column) -> Column:
    """All sets of a path's parts and pairs of neighbouring parts, as sorted arrays."""
    parts = F.split(path, "/")
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts)), lambda x, y: F.concat_ws("/", x, y))
    # parts hold no separator, so they are no pairs
    held = F.array_sort(F.array_distinct(F.concat(parts, F.slice(pairs, F.lit(1), F.size(parts) - 1))))
    return F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.size(held)).cast("int") - 1), lambda m: F.filter(held, lambda x, i: F.getbit(m, i) == 1))


def fuzzy_paths(wanted: DataFrame, files: DataFrame, group: str, k: int = 3) -> DataFrame:
    """(group, wanted, path, likeness, rank): the k files of the group most like each wanted path, ties to the smaller path.

    Files of the same folder come first, whatever their names: they share all parts of the folder, and nothing else adds up to what the folder
    gives. Of a large folder, names meet by what is left of them after one or two deletions; a wanted name is done when its k-th file is
    nearer than any that needs one deletion more. Names that are not are compared with the files of their folder whose lengths can
    reach the k-th. Only paths with fewer than k files in their folder look at the rest of the group: paths that end with a separator are as like
    a file as the parts they share, and are looked up by them; others are compared with all. Repeated paths count once, nulls are left out.

    All joins are sort-merge joins, in any session: tables written are small beside the names and sets that they are exploded to, so the planner
    would take many times what it may for small enough to broadcast, and the driver's memory would grow with the input.
    """
    merged = lambda df: df.hint("merge")
    name = lambda c: F.substring_index(c, "/", -1)
    split = lambda df, c: df.where(F.col(c).isNotNull() & F.col(group).isNotNull()).select(group, c).distinct().withColumn("folder", F.substring(F.col(c), F.lit(1), F.length(c) - F.length(name(F.col(c)))))
    known = materialise(split(files, "path").withColumn("file", name(F.col("path"))), "paths")
    sizes = known.groupBy(group, "folder").agg(F.count(F.lit(1)).alias("n"))
    asked = split(wanted, "wanted").withColumn("name", name(F.col("wanted"))).join(merged(sizes), [group, "folder"], "left").na.fill(0, ["n"])
    asked = materialise(asked, "wanted-paths")
    apart = F.levenshtein("name", "file") / F.greatest(F.length("name"), F.length("file"), F.lit(1))

    like = F.round(path_similarity(F.col("wanted"), F.col("path")), 6)

    def best(pairs: DataFrame, inside: bool = True) -> DataFrame:
        # in one folder only names differ
        scored = pairs.select(group, "wanted", "path", apart.alias("apart"), (F.round(300.0 * (1 - apart), 6) if inside else like).alias("likeness"))
        order = Window.partitionBy(group, "wanted").orderBy(F.col("likeness").desc(), "path")
        kept = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return kept.withColumn("likeness", like) if inside else kept

    out = [group, "wanted", "path", "likeness"]
    left, found = asked.where((F.col("n") > FEW_FILES) & (F.col("name") != "")), [best(asked.where(F.col("n") <= FEW_FILES).join(merged(known), [group, "folder"]))]
    found.append(best(asked.where((F.col("n") > FEW_FILES) & (F.col("name") == "")).join(merged(known), [group, "folder"])))
    large = known.join(merged(sizes.where(F.col("n") > FEW_FILES)), [group, "folder"], "left_semi")
    for round_ in range(1, DELETIONS + 1):
        keys = lambda c: _without(F.array(F.col(c))) if round_ == 1 else _without(_without(F.array(F.col(c))))  # noqa: E731, B023
        able = left if round_ == 1 else left.where(F.length("name") <= LONG_NAME)
        near = large if round_ == 1 else large.where(F.length("file") <= LONG_NAME + round_)
        pairs = able.withColumn("key", F.explode(keys("name"))).join(merged(near.withColumn("key", F.explode(keys("file")))), [group, "folder", "key"]).select(group, "wanted", "name", "path", "file").distinct()
        some = materialise(best(pairs), "near-names")
        kth = some.groupBy(group, "wanted").agg(F.max("apart").alias("reached"), F.count(F.lit(1)).alias("met")).where(F.col("met") >= k)
        size = F.length("name")
        judged = left.drop("reached").join(merged(kth), [group, "wanted"], "left")
        # a file that is not met takes at least one deletion more, and is at most so much longer
        done = F.coalesce(F.col("reached") < (round_ + 1) / (size + round_ + 1) - 1e-8, F.lit(False))
        judged = materialise(judged.select(group, "wanted", "folder", "name", "n", "reached", done.alias("done")), "judged-names")
        found.append(some)
        left = judged.where("NOT done").drop("done")
    # files that were not met, of lengths that can reach the k-th
    lengths = large.groupBy(group, "folder").agg(F.collect_set(F.length("file")).alias("lengths"))
    least = F.when(F.length("name") <= LONG_NAME, DELETIONS + 1).otherwise(2)
    fits = lambda m: F.coalesce(F.greatest(least, F.abs(m - F.length("name"))) / F.greatest(m, F.length("name")) <= F.col("reached") + 1e-8, F.lit(True))
    sized = left.join(merged(lengths), [group, "folder"]).withColumn("size", F.explode(F.filter("lengths", fits))).drop("lengths")
    found.append(best(sized.join(merged(large.withColumn("size", F.length("file"))), [group, "folder", "size"])))

    alone = asked.where(F.col("n") < k)
    by_parts = (F.col("name") == "") & (F.size(F.split("wanted", "/")) <= FEW_PARTS)
    other = known.withColumnRenamed("folder", "at")
    found.append(best(alone.where(~by_parts).join(merged(other), group).where(F.col("at") != F.col("folder")), False))
    # of the files that share a set of parts, the first k can be among the best, and as many may be in the folder itself
    shared = other.where(F.size(F.split("path", "/")) <= FEW_PARTS).withColumn("key", F.explode(_shared_sets(F.col("path"))))
    order = Window.partitionBy(group, "key").orderBy("path")
    first = shared.withColumn("r", F.row_number().over(order)).where(F.col("r") < 2 * k).drop("r")
    met = alone.where(by_parts).withColumn("key", F.explode(_shared_sets(F.col("wanted")))).join(merged(first), [group, "key"]).where(F.col("at") != F.col("folder"))
    deep = alone.where(by_parts).join(merged(other.where(F.size(F.split("path", "/")) > FEW_PARTS)), group).where(F.col("at") != F.col("folder"))
    found += [best(met.select(group, "wanted", "name", "path", "file").distinct(), False), best(deep, False)]
    union = reduce(DataFrame.unionByName, [df.select(*out) for df in found]).distinct()
    return union.withColumn("rank", F.row_number().over(Window.partitionBy(group, "wanted").orderBy(F.col("likeness").desc(), "path"))).where(F.col("rank") <= k)
