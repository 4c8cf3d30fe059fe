"""Typed property graphs as node and edge tables: bounded shortest paths, evidence paths, scores, closures.

Iterations cut their lineage by writing the frontier to the checkpoint folder; each is one join and one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.context import cut, materialise
from rankloom.functions.text import cosine, levenshtein_similarity

WEAK, NORMAL, STRONG = 1.0, 0.5, 0.25
DECAY, VECTOR_WEIGHT = 0.6, 0.3


def two_way(links: DataFrame, forward: str = "forward", backward: str = "backward") -> DataFrame:
    """Both directions of links (src, dst, forward, backward, weight) as distinct edges (src, dst, description, weight)."""
    out = links.select("src", "dst", F.col(forward).alias("description"), "weight").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(backward).alias("description"), "weight"))
    return out.dropDuplicates(["src", "dst", "description", "weight"])


def upsert_nodes(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] = ()) -> DataFrame:
    """First value wins for ``keep_old`` columns of known nodes, the newest for all others; unknown nodes are added."""
    a, b = old.withColumn("seq", F.lit(0)), new.withColumn("seq", F.lit(1))
    rest = [c for c in old.columns if c not in key]
    pick = [(F.min_by(c, "seq") if c in keep_old else F.max_by(c, "seq")).alias(c) for c in rest]
    return a.unionByName(b).groupBy(*key).agg(*pick).select(*old.columns)


def project(edges: DataFrame, nodes: DataFrame | None = None, labels: list[str] | None = None, uniform: bool = False) -> DataFrame:
    """src, dst, weight of the edges between nodes of the given labels; missing weights are 1, uniform ones all 1."""
    out = edges.select("src", "dst", F.lit(1.0).alias("weight") if uniform else F.coalesce("weight", F.lit(1.0)).alias("weight"))
    if labels is not None:
        known = nodes.where(F.col("label").isin(labels)).select("node")
        out = out.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return out.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def shortest_paths(edges: DataFrame, roots: DataFrame, bound: float) -> DataFrame:
    """Cheapest path from each root to every node within a cost bound: root, node, cost, path (array of nodes).

    Frontier relaxation until nothing changes: only nodes whose cost fell in the last round are expanded. Of equal costs the
    smaller path wins. Weights must not be negative.
    """
    best = cut(roots.select("root", F.col("root").alias("node"), F.lit(0.0).alias("cost"), F.array(F.col("root")).alias("path")))
    frontier = best
    while True:
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.round(F.col("cost") + F.col("weight"), 9).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        step = step.where(F.col("cost") <= bound).groupBy("root", "node").agg(F.min(F.struct("cost", "path")).alias("b")).select("root", "node", "b.cost", "b.path")
        old = best.select("root", "node", F.struct("cost", "path").alias("was"))
        better = cut(step.join(old, ["root", "node"], "left").where(F.col("was").isNull() | (F.struct("cost", "path") < F.col("was"))).select("root", "node", "cost", "path"))
        if better.isEmpty():
            return best
        best = cut(best.unionByName(better).groupBy("root", "node").agg(F.min(F.struct("cost", "path")).alias("b")).select("root", "node", "b.cost", "b.path"))
        frontier = better


def path_details(paths: DataFrame, edges: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Steps of each path with node labels and edge descriptions (of parallel edges the smallest)."""
    n = F.size("path")
    steps = paths.where(n > 1).select(*key, F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), n - 1).alias("src"), F.slice("path", F.lit(2), n - 1).alias("dst"))).alias("at", "step"))
    steps = steps.select(*key, "at", F.col("step.src").alias("src"), F.col("step.dst").alias("dst"))
    label = nodes.select("node", "label").dropDuplicates(["node"])
    steps = steps.join(edges.groupBy("src", "dst").agg(F.min("description").alias("description")), ["src", "dst"], "left")
    steps = steps.join(label.select(F.col("node").alias("src"), F.col("label").alias("src_label")), "src", "left").join(label.select(F.col("node").alias("dst"), F.col("label").alias("dst_label")), "dst", "left")
    item = F.struct("at", "src", "src_label", "dst", "dst_label", "description")
    return steps.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("details"))


#: What the root's own row scores, which comes before all others.
ROOT_SCORE = 2.0
SCORED_LABELS = ("Method", "Class", "Issue")


def component_score(is_issue: Column, vector: Column, text: Column, cost: Column, decay: Column | float = DECAY, weight: Column | float = VECTOR_WEIGHT) -> Column:
    """Issues: vector similarity decayed by cost; others: a mix of vector and text similarity, decayed."""
    decay, weight = (x if isinstance(x, Column) else F.lit(x) for x in (decay, weight))
    fade = F.pow(decay, cost)
    return F.when(is_issue, vector * fade).otherwise((weight * vector + (1 - weight) * text) * fade)


def components(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Raw similarities of what shortest paths (root, node, cost) reach: root, node, label, name, file_path, root_text, cosine, likeness, cost.

    ``nodes``: node, label, name, file_path, vector, text. Methods, classes and issues with a vector count, but neither the root nor
    methods that are tests.
    """
    root = nodes.select(F.col("node").alias("root"), F.col("vector").alias("root_vector"), F.col("text").alias("root_text"))
    held = paths.select("root", "node", "cost").where("node <> root").join(nodes, "node").join(root, "root")
    test = (F.col("label") == "Method") & F.col("name").contains("test") & ~F.col("name").contains("pytest")
    held = held.where(F.col("label").isin(*SCORED_LABELS) & F.col("vector").isNotNull() & ~F.coalesce(test, F.lit(False)))
    likeness = levenshtein_similarity(F.col("root_text"), F.coalesce("text", F.lit("")))
    return held.select("root", "node", "label", "name", "file_path", "root_text", cosine(F.col("root_vector"), F.col("vector")).alias("cosine"), likeness.alias("likeness"), "cost")


def rerank_components(found: DataFrame, parameters: list[tuple[float, float]], boost: float = 0.0) -> DataFrame:
    """Scores and ranks of ``components`` under every (decay, weight), the root first, with a boost for named identifiers."""
    from rankloom.operators.ranking import rank_by

    spark = found.sparkSession
    p = spark.createDataFrame([(float(d), float(w)) for d, w in parameters], "decay double, weight double")
    issue = F.col("label") == "Issue"
    score = component_score(issue, F.col("cosine"), F.col("likeness"), F.col("cost"), F.col("decay"), F.col("weight"))
    score = score + F.when(issue, 0.0).otherwise(boost * identifier_boost(F.col("name"), F.col("file_path"), F.col("root_text")))
    scored = found.crossJoin(F.broadcast(p)).select("root", "node", "label", score.alias("score"), "decay", "weight")
    pinned = found.select("root").distinct().crossJoin(F.broadcast(p)).select("root", F.col("root").alias("node"), F.lit("Issue").alias("label"), F.lit(ROOT_SCORE).alias("score"), "decay", "weight")
    both = scored.unionByName(pinned).withColumn("score", F.round("score", 9)).withColumn("other", (F.col("node") != F.col("root")).cast("int"))
    return rank_by(both, ["root", "decay", "weight"], "other", F.col("score").desc(), "node").drop("other")


def identifier_boost(name: Column, path: Column, text: Column) -> Column:
    """1 when a name of more than 3 letters stands in the text, and a half when the path's last step does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = (F.length(name) > 3) & F.contains(low, F.lower(name))
    filed = F.contains(low, F.lower(F.element_at(F.split(path, "/"), -1)))
    return F.when(named, 1.0).otherwise(0.0) + F.when(filed, 0.5).otherwise(0.0)


def evidence_paths(edges: DataFrame, nodes: DataFrame, roots: str | DataFrame, first_not: list[str], middle_not: list[str], targets: list[str], hops: int = 4) -> DataFrame:
    """Shortest label-restricted paths of 1 to ``hops`` edges from a root, or from each root of a table, to target nodes.

    The first inner node must not have a label of ``first_not``, later inner ones none of ``middle_not``. Returns node, distance,
    support (distinct first nodes of shortest paths) and path (the smallest), and root where a table was given.

    A search by layers: a layer holds each node once, with the smallest path to it, so work grows with nodes and edges and not with walks.
    A shortest walk that does not come back to its root is simple: leaving out a loop moves later nodes nearer, where the same
    labels are barred. Support is counted by going back through the layers from the targets, as distinct pairs of target and node.
    """
    many = isinstance(roots, DataFrame)
    e = edges.select("src", "dst").distinct()
    label = nodes.select(F.col("node").alias("dst"), "label").dropDuplicates(["dst"])
    step = materialise(e.join(label, "dst").select("src", "dst", "label"), "evidence-edges")
    start = roots.select("root").distinct() if many else edges.sparkSession.createDataFrame([(roots,)], T.StructType([T.StructField("root", edges.schema["src"].dataType)]))
    inner = lambda n: ~F.col("label").isin(first_not if n == 1 else middle_not)
    layers = []
    front = start.select("root", F.col("root").alias("src"), F.array("root").alias("path"))
    for n in range(1, hops + 1):
        met = front.join(step, "src").where("dst <> root")
        layer = met.groupBy("root", F.col("dst").alias("at"), "label").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        layers.append(materialise(layer, "evidence-layer"))
        front = layers[-1].where(inner(n)).select("root", F.col("at").alias("src"), "path")
    known = reduce(DataFrame.unionByName, [layer.where(F.col("label").isin(targets)).select("root", "at", "path", F.lit(n).alias("distance")) for n, layer in enumerate(layers, 1)])
    best = materialise(known.groupBy("root", "at").agg(F.min_by("path", "distance").alias("path"), F.min("distance").alias("distance")), "evidence-best")
    pairs = None
    for n in range(hops, 0, -1):
        here = best.where(F.col("distance") == n).select("root", F.col("at").alias("target"), F.col("at"))
        pairs = here if pairs is None else here.unionByName(pairs)
        if n > 1:  # one layer back: predecessors that may be inner there
            before = layers[n - 2].where(inner(n - 1)).select("root", F.col("at").alias("src"))
            back = pairs.join(step.select("src", F.col("dst").alias("at")), "at").join(before, ["root", "src"], "left_semi")
            pairs = materialise(back.select("root", "target", F.col("src").alias("at")).distinct(), "evidence-back")
    support = pairs.groupBy("root", F.col("target").alias("at")).agg(F.count_distinct("at").alias("support"))
    found = best.join(support, ["root", "at"]).select(*(["root"] if many else []), F.col("at").alias("node"), "distance", "support", "path")
    return found


def evidence_files(edges: DataFrame, nodes: DataFrame, root: str, through: str = "Issue", target: str = "File", hops: int = 3) -> DataFrame:
    """Files that paths through one label reach: least distance and number of last inner nodes."""
    e = edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("dst"), "label").dropDuplicates(["dst"]), "dst")
    walk = e.where(F.col("src") == root).select(F.col("src").alias("before"), F.col("dst").alias("at"), "label", F.lit(1).alias("distance"))
    found = walk.where(F.col("label") == target)
    for n in range(2, hops + 1):
        inner = walk.where(F.col("label") == through).select("at").distinct()
        walk = inner.join(e.withColumnRenamed("src", "at"), "at").where(F.col("dst") != root).select(F.col("at").alias("before"), F.col("dst").alias("at"), "label", F.lit(n).alias("distance"))
        found = found.unionByName(walk.where(F.col("label") == target))
    return found.groupBy(F.col("at").alias("file")).agg(F.min("distance").alias("distance"), F.count_distinct("before").alias("support"))


def rank_scores(edges: DataFrame, root: str, alpha: float = 0.85, rounds: int = 24, cut_every: int = 6) -> DataFrame:
    """Random-walk scores: teleport to every node, the mass of dangling nodes dropped, a fixed number of rounds, largest score 1.

    The root starts with all the mass. Returns node, score.
    """
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    out = cut(edges.join(degree, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")))
    score = nodes.withColumn("score", F.when(F.col("node") == root, 1.0).otherwise(0.0))
    for k in range(rounds):
        flow = out.join(score, out["src"] == score["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("flow"))
        score = nodes.join(flow, "node", "left").select("node", (F.lit((1 - alpha) / max(n, 1)) + alpha * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if (k + 1) % cut_every == 0:
            score = cut(score)
    top = score.agg(F.max("score").alias("top"))
    return score.crossJoin(F.broadcast(top)).select("node", F.round(F.col("score") / F.col("top"), 9).alias("score"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes reachable from each root, the root included: root, node, depth. Semi-naive: only new pairs are expanded."""
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    new, depth = seen, 0
    while True:
        depth += 1
        step = new.join(edges, new["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))


def expand_neighbours(seeds: DataFrame, edges: DataFrame, decay: float = 0.55) -> DataFrame:
    """Seed files and their import neighbours: a neighbour gets the decayed score, at least 1; the best score stays."""
    next_ = seeds.join(edges, seeds["file"] == edges["src"]).select("query", F.col("dst").alias("file"), F.greatest(F.lit(1), F.floor(F.col("score") * decay)).cast("long").alias("score"), F.lit(1).alias("distance"))
    both = seeds.select("query", "file", F.col("score").cast("long").alias("score"), F.lit(0).alias("distance")).unionByName(next_)
    return both.groupBy("query", "file").agg(F.max("score").alias("score"), F.min("distance").alias("distance"))

