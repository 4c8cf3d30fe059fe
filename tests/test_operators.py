import difflib
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rankloom.operators import audit, graph, intervals, joins, metrics, packing, parsers, patches, projection, ranking, retrieval, stats


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def keys(df):
    return [r.key for r in df.orderBy("rank").collect()]


def rank_table(spark, names, query=1):
    return frame(spark, "query int, key string, rank int", *[(query, k, n) for n, k in enumerate(names, 1)])


def test_fusion_adds_reciprocal_ranks_and_breaks_ties(spark):
    a, b = rank_table(spark, ["x", "y", "x", "z"]), rank_table(spark, ["y", "w"])
    fused = ranking.reciprocal_rank_fusion([("a", a), ("b", b)], {"a": 1.0, "b": 2.0})
    rows = {r.key: r for r in fused.collect()}
    assert rows["y"].score == pytest.approx(1 / 62 + 2 / 61) and rows["z"].score == pytest.approx(1 / 64)
    assert rows["y"].source_ranks == {"a": 2, "b": 1} and rows["x"].first_source == 0
    assert keys(fused) == ["y", "w", "x", "z"]
    swapped = ranking.reciprocal_rank_fusion([("a", a), ("b", a)])
    assert keys(swapped) == ["x", "y", "z"]


def test_unions_fills_and_turns(spark):
    a, b = rank_table(spark, ["p", "q", "r"]), rank_table(spark, ["q", "s", "t"])
    assert keys(ranking.min_rank_union(a, b)) == ["p", "q", "s", "r", "t"]
    assert keys(ranking.prefix_fill(a, b, 4)) == ["p", "q", "s", "t"] and keys(ranking.prefix_fill(a, b, 10, 0)) == ["q", "s", "t"]
    assert keys(ranking.round_robin([a, b])) == ["p", "q", "s", "r", "t"]
    assert keys(ranking.append_anti(a, b)) == ["p", "q", "r", "s", "t"]
    filled = ranking.prefix_fill(a, b, 3).orderBy("rank").collect()
    assert [r.similarity for r in filled] == [2.0, 1.99, 1.98]


def test_first_ranks_keep_gaps_and_dedupe_closes_them(spark):
    df = rank_table(spark, ["x", "y", "x", "z"])
    assert {r.key: r.rank for r in ranking.first_ranks(df).collect()} == {"x": 1, "y": 2, "z": 4}
    assert {r.key: r.rank for r in ranking.dedupe_in_order(df).collect()} == {"x": 1, "y": 2, "z": 3}


def test_orders(spark):
    df = frame(spark, "query int, key string, s string, pos int", (1, "a", "0.5", 1), (1, "b", None, 2), (1, "c", "0.9", 3), (1, "d", "0.5", 4))
    assert keys(ranking.similarity_order(df.withColumn("s", F.col("s").cast("double")), "query", "s", "pos")) == ["c", "a", "d", "b"]
    files = frame(spark, "query int, key string, file string, rank int", (1, "a", "f", 1), (1, "b", "g", 2), (1, "c", "f", 3))
    assert keys(ranking.file_primary(files)) == ["a", "c", "b"]
    assert keys(ranking.bucket_round_robin(files.withColumnRenamed("rank", "r"), "query", "file", "r")) == ["a", "b", "c"]
    assert keys(ranking.stable_random_order(files.drop("rank"), "query", "key")) == keys(ranking.stable_random_order(files.drop("rank").repartition(3), "query", "key"))


def test_bm25_matches_the_formula(spark):
    texts = {1: "alpha beta beta gamma", 2: "alpha delta", 3: "epsilon", 4: "beta beta beta"}
    docs = frame(spark, "doc_id int, text string", *texts.items())
    queries = frame(spark, "query int, text string", (7, "alpha alpha beta"))
    for counted in (False, True):
        got = {r.doc_id: r.score for r in retrieval.bm25(docs, queries, query_frequency=counted).collect()}
        tokens = {d: t.split() for d, t in texts.items()}
        mean = statistics.mean(map(len, tokens.values()))
        for d, ws in tokens.items():
            want = 0.0
            for term, qtf in (("alpha", 2), ("beta", 1)):
                df = sum(term in x for x in tokens.values())
                tf = ws.count(term)
                if tf:
                    want += (qtf if counted else 1) * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            assert got.get(d, 0.0) == pytest.approx(want)


def test_file_first_takes_enough_files(spark):
    files = frame(spark, "query int, file string, score double", (1, "f", 0.9), (1, "g", 0.8), (1, "h", 0.7))
    members = frame(spark, "query int, file string, key string, score double", (1, "f", "a", 0.1), (1, "f", "b", 0.5), (1, "g", "c", 0.9), (1, "h", "d", 1.0))
    assert keys(retrieval.file_first(files, members, 2, 1)) == ["b", "a"] and keys(retrieval.file_first(files, members, 3, 1)) == ["c", "b", "a"]


def test_projection_key_precedence(spark):
    base = dict(query=1, file="f", file_rank=1, name="n", signature="n", start_line=1, title_symbol=0, title_source=0, exact_symbol=0, exact_source=0, narrative_symbol=0, narrative_source=0, diagnostic_symbol=0, source_only=0, is_boilerplate=0)
    rows = [
        dict(base, key="late", start_line=9), dict(base, key="title", title_symbol=1, file_rank=5), dict(base, key="source", title_source=2), dict(base, key="exact", exact_symbol=3), dict(base, key="boiler", is_boilerplate=1),
        dict(base, key="diagnostic", diagnostic_symbol=1), dict(base, key="title", title_symbol=0), dict(base, key="early", start_line=0),
    ]
    ranked = projection.project_entities(spark.createDataFrame(rows), "key")
    assert keys(ranked) == ["title", "source", "exact", "early", "late", "boiler", "diagnostic"]


def test_file_evidence_and_seeds(spark):
    df = frame(spark, "query int, file string, rank int, support int, distance int, anchor_match boolean, matches array<string>", (1, "f", 1, 2, 0, False, ["b"]), (1, "g", 2, None, 3, None, None), (1, "f", 3, 5, 2, True, ["a", "b"]), (1, "", 4, 1, 1, True, None))
    got = {r.file: r for r in projection.file_evidence(df).collect()}
    assert (got["f"].best_rank, got["f"].support, got["f"].distance, got["f"].anchor_match, got["f"].matches) == (1, 5, 2, True, ["a", "b"]) and set(got) == {"f", "g"}
    assert [(r.file, r.support, r.file_rank) for r in projection.ranked_file_seeds(df, 5, 3).orderBy("file_rank").collect()] == [("f", 2, 1), ("g", 1, 2)]
    seeds = frame(spark, "query int, file string, rank int, distance int, support int, anchor boolean", (1, "a", 1, 3, 1, False), (1, "b", 2, 1, 1, True), (1, "a", 3, 2, 4, False))
    assert [r.file for r in projection.graph_file_seeds(seeds).orderBy("file_rank").collect()] == ["b", "a"]


def test_evidence_order_prefers_exact_anchors(spark):
    schema = "query int, issue string, name string, signature string, file string, path_text string, support int, distance int, anchor_match boolean, start_line int"
    issue = "calling `pkg.do_thing` breaks the parser"
    df = frame(spark, schema, (1, issue, "other", "other", "pkg/parser.py", "", 9, 1, True, 1), (1, issue, "do_thing", "pkg.do_thing", "pkg/x.py", "", 0, 2, False, 5), (1, issue, "__repr__", "__repr__", "pkg/y.py", "", 0, 2, False, 5))
    assert [r.name for r in projection.evidence_order(df).orderBy("rank").collect()] == ["do_thing", "other", "__repr__"]


def test_intervals(spark):
    points = frame(spark, "f string, point int", ("a", 5), ("a", 12), ("a", 99), ("b", 5))
    spans = frame(spark, "f string, name string, start int, end int", ("a", "outer", 1, 20), ("a", "inner", 4, 8), ("a", "twin", 4, 8), ("b", "other", 6, 9))
    for width in (None, 4):
        got = {(r.f, r.point): r.name for r in intervals.innermost(points, spans, "f", tie=("name",), width=width).collect()}
        assert got == {("a", 5): "inner", ("a", 12): "outer"}
    held = intervals.enclosing(spans.where("name = 'inner'"), spans.where("name = 'outer'"), "f", "name").collect()
    assert [r.outer_name for r in held] == ["outer"]
    assert intervals.overlapping(spans.where("f = 'a'"), spans.where("f = 'a'"), "f").count() == 9
    numbers = frame(spark, "f string, n int", *[("a", x) for x in (1, 2, 3, 7, 8, 8, 20)])
    assert sorted((r.first, r.last, r.length) for r in intervals.islands(numbers, "f", "n").collect()) == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(1)
    left = [(k, rnd.randrange(4), rnd.randrange(100)) for k in range(80)]
    right = [(k, rnd.randrange(4), rnd.randrange(100)) for k in range(60)]
    a, b = frame(spark, "id int, g int, t long", *left), frame(spark, "near int, g int, u long", *right)
    got = {r.id: r.near for r in intervals.nearest(a, b, "g", "t", "u", "near").collect()}
    want = {i: min((abs(u - t), u, n) for n, h, u in right if h == g)[2] for i, g, t in left if any(h == g for _, h, _ in right)}
    assert got == want


def test_contract_joins(spark):
    a, b = frame(spark, "k int, x int", (1, 1), (2, 2)), frame(spark, "k int, y int", (1, 5), (2, 6))
    assert joins.equal_keys(a, b, ["k"]).count() == 2
    with pytest.raises(Exception, match="keys differ"):
        joins.equal_keys(a, b.where("k = 1"), ["k"]).collect()
    assert [(r.k, r.side) for r in joins.unmatched(a, b.where("k = 1"), ["k"]).collect()] == [(2, "left")]
    assert [r.k for r in joins.in_all([a, b.where("k = 2"), a], "k").collect()] == [2]
    assert {(r.k, r.x, r.updated) for r in joins.merge_update(a, frame(spark, "k int, x int", (2, None)), "k", ["x"]).collect()} == {(1, 1, False), (2, None, True)}


def test_name_joins(spark):
    left = frame(spark, "g int, sig string", (1, "A.f"), (1, "AB.f"), (1, "A"))
    assert sorted(r.sig for r in joins.prefix_match(left, frame(spark, "g int, cls string", (1, "A")), "g", "sig", "cls").collect()) == ["A", "A.f"]
    paths = frame(spark, "g int, a string", (1, "src/x.py"))
    assert joins.suffix_match(paths, frame(spark, "g int, b string", (1, "x.py"), (1, "y.py")), "g", "a", "b").count() == 1
    assert joins.longest_prefix(frame(spark, "m string", ("a.b.c",)), frame(spark, "p string, f int", ("a", 1), ("a.b", 2)), "m", "p").first().f == 2
    labels, entities = frame(spark, "g int, name string", (1, "A"), (1, "B.m"), (1, "C")), frame(spark, "g int, name string, line int", (1, "A.x", 1), (1, "A.y", 2), (1, "B.m", 3), (1, "C", 4), (1, "C.z", 5))
    assert sorted((r.name, r.entity) for r in joins.exact_or_members(labels, entities, "g").collect()) == [("A", "A.x"), ("A", "A.y"), ("B.m", "B.m"), ("C", "C")]
    first, second = frame(spark, "k string, v int, n int", ("a", 1, 2), ("a", 7, 1)), frame(spark, "s string, v int, n int", ("z", 9, 1))
    got = joins.cascade(frame(spark, "k string, s string", ("a", "z"), ("b", "z"), ("b", "q")), [(first, ["k"]), (second, ["s"])], "v", "n")
    assert sorted(((r.v, r.level) for r in got.collect()), key=str) == [(7, 0), (9, 1), (None, None)]
    assert spark.range(1).select(joins.name_variations(F.lit("a.b.c.d")).alias("v")).first().v == ["d", "c.d", "b.c.d"]
    best = joins.fuzzy_best(frame(spark, "g int, a string", (1, "abcd")), frame(spark, "g int, b string", (1, "abxd"), (1, "zzzz")), "g", "a", "b").first()
    assert best.b == "abxd" and best.ratio == 0.75
    near = joins.fuzzy_paths(frame(spark, "g int, wanted string", (1, "a/b/c.py")), frame(spark, "g int, path string", (1, "a/b/d.py"), (1, "x/c.py"), (1, "q.txt")), "g", 1).first()
    assert near.path == "a/b/d.py"


def test_strict_evaluation(spark):
    candidates = frame(spark, "approach string, instance int, rank int, file string, kind string, name string", ("a", 1, 1, "f", "function", "g"), ("a", 1, 2, "f", "assignment", "x"), ("a", 1, 3, "h", "function", "k"), ("b", 1, 1, "z", "function", "q"))
    targets = frame(spark, "instance int, target string, target_type string, file string, name string", (1, "t1", "function", "f", "x"), (1, "t2", "function", "h", "k"), (2, "t3", "file", "f", ""))
    got = {(r.approach, r.instance): r for r in metrics.evaluate(candidates, targets).collect()}
    assert (got["a", 1].matched_target_count, got["a", 1].first_rank, got["a", 1].hit, got["a", 1].complete, got["a", 1].target_coverage) == (1, 3, 1, 0, 0.5)
    assert got["a", 1].mrr == pytest.approx(1 / 3) and got["a", 1].file_hit == 1 and got["b", 1].hit == 0 and got["b", 2].candidate_count == 0
    file_target = metrics.evaluate(candidates.where("rank = 1"), frame(spark, "instance int, target string, target_type string, file string, name string", (1, "t", "file", "f", "")))
    assert {r.approach: r.hit for r in file_target.collect()} == {"a": 1, "b": 0}


def test_agreement_and_percentiles(spark):
    df = frame(spark, "a int, b int", *([(1, 1)] * 6 + [(1, 0)] * 4 + [(0, 1)] * 4 + [(0, 0)] * 6))
    r = metrics.kappa(df, "a", "b").first()
    assert (r.n, r.agreement, r.kappa) == (20, 0.6, 0.2)
    p = metrics.percentiles(frame(spark, "g int, v double", *[(1, float(v)) for v in range(1, 11)]), ["g"], "v", 0.95).first()
    assert (p.interpolated, p.nearest_rank, p.truncated_index) == (pytest.approx(9.55), 10.0, 10.0)
    flags = {r.flag: (r.n, r.exclusive) for r in metrics.flag_counts(frame(spark, "e string", ("a+b",), ("a",), ("",)), "e").collect()}
    assert flags == {"a": (2, 1), "b": (1, 0)}


@pytest.mark.parametrize(("wins", "losses"), [(0, 0), (1, 0), (5, 5), (53, 6), (35, 3), (60, 57), (33, 19), (900, 700)])
def test_mcnemar_is_exact(spark, wins, losses):
    n = wins + losses
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, j) for j in range(min(wins, losses) + 1)) / 2**n)
    got = spark.createDataFrame([(wins, losses)], "w int, l int").select(stats.mcnemar(F.col("w"), F.col("l")).alias("p"), stats.mcnemar(F.col("w"), F.col("l"), None).alias("q")).first()
    assert got.p == pytest.approx(want, rel=1e-9) and (got.q is None) == (n == 0)


def test_sign_flip_counts_all_assignments(spark):
    def p(*values):
        return stats.sign_flip(frame(spark, "e string, c int, v double", *[("x", k, float(v)) for k, v in enumerate(values)]), ["e"], "v", "c").first().p

    assert p(1, 1) == 0.5 and p(0, 0) == 1.0 and p(1, 1, 1) == 0.25 and p(3, -1) == 1.0


def test_bootstraps_follow_their_definitions(spark):
    pairs = frame(spark, "m string, c string, baseline double, treatment double", *[("hit", f"r{k % 4}", float(k % 2), float((k % 3) > 0)) for k in range(40)])
    r = stats.clustered_bootstrap(pairs, ["m"], "c", 500).first()
    sums = {}
    for row in pairs.collect():
        s, n = sums.get(row.c, (0.0, 0))
        sums[row.c] = (s + row.treatment - row.baseline, n + 1)
    rng, names, draws = random.Random(7), sorted(sums), []
    for _ in range(500):
        picked = [sums[rng.choice(names)] for _ in names]
        draws.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    cuts = statistics.quantiles(draws, n=40, method="inclusive")
    assert (r.low, r.high) == (pytest.approx(cuts[0]), pytest.approx(cuts[-1])) and r.delta == pytest.approx(sum(s for s, _ in sums.values()) / 40)
    low, high = stats.numpy_interval([0.0, 1.0] * 20, 300)
    assert low < 0.5 < high and stats.iid_interval([2.0], 10) == (2.0, 2.0) and stats.two_group_interval({"a": (2.0, 2, 1.0, 2)}, 5) == (0.5, 0.5)


EDGES = [("r", "a", "x", 0.5), ("a", "b", "x", 0.5), ("r", "b", "x", 1.5), ("b", "c", "x", 1.0), ("c", "r", "x", 0.25), ("b", "d", "x", 9.0)]


def test_bounded_shortest_paths(spark):
    edges = frame(spark, "src string, dst string, description string, weight double", *EDGES)
    got = {r.node: (r.cost, r.path) for r in graph.shortest_paths(graph.project(edges), frame(spark, "root string", ("r",)), 2.0).collect()}
    assert got == {"r": (0.0, ["r"]), "a": (0.5, ["r", "a"]), "b": (1.0, ["r", "a", "b"]), "c": (2.0, ["r", "a", "b", "c"])}


def test_graph_tables(spark):
    links = frame(spark, "src string, dst string, forward string, backward string, weight double", ("i", "f", "refers", "referred by", 1.0), ("i", "f", "refers", "referred by", 1.0))
    edges = graph.two_way(links)
    assert edges.count() == 2
    nodes = frame(spark, "node string, label string", ("i", "Issue"), ("f", "File"))
    paths = frame(spark, "root string, node string, path array<string>", ("i", "f", ["i", "f"]))
    d = graph.path_details(paths, edges, nodes, ["root", "node"]).first().details
    assert [(x.src_label, x.description, x.dst_label) for x in d] == [("Issue", "refers", "File")]
    up = graph.upsert_nodes(frame(spark, "id int, state string, title string", (1, "open", "t")), frame(spark, "id int, state string, title string", (1, "closed", "u"), (2, "open", "v")), ["id"], ["state"])
    assert {r.id: (r.state, r.title) for r in up.collect()} == {1: ("open", "u"), 2: ("open", "v")}
    assert {r.node for r in graph.closure(frame(spark, "src int, dst int", (1, 2), (2, 3), (3, 1), (4, 5)), frame(spark, "root int", (1,))).collect()} == {1, 2, 3}
    near = graph.expand_neighbours(frame(spark, "query int, file string, score int", (1, "a", 10), (1, "b", 1)), frame(spark, "src string, dst string", ("a", "c"), ("b", "d"), ("a", "b")))
    assert {r.file: (r.score, r.distance) for r in near.collect()} == {"a": (10, 0), "b": (5, 0), "c": (5, 1), "d": (1, 1)}


def test_evidence_paths_restrict_labels(spark):
    edges = frame(spark, "src string, dst string", ("r", "i1"), ("i1", "f1"), ("r", "f2"), ("f2", "m1"), ("i1", "i2"), ("i2", "f1"), ("r", "m2"), ("m2", "m1"))
    nodes = frame(spark, "node string, label string", ("r", "Issue"), ("i1", "Issue"), ("i2", "Issue"), ("f1", "File"), ("f2", "File"), ("m1", "Method"), ("m2", "Method"))
    got = {r.node: (r.distance, r.support, r.path) for r in graph.evidence_paths(edges, nodes, "r", ["Method"], [], ["Method"]).collect()}
    assert got["m1"] == (2, 1, ["r", "f2", "m1"]) and got["m2"][0] == 1
    files = {r.file: (r.distance, r.support) for r in graph.evidence_files(edges, nodes, "r").collect()}
    assert files == {"f2": (1, 1), "f1": (2, 2)}


def test_rank_scores_follow_the_walk(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")]
    score = dict.fromkeys("abcd", 0.0) | {"a": 1.0}
    out = {n: [y for x, y in links if x == n] for n in "abcd"}
    for _ in range(24):
        new = dict.fromkeys("abcd", 0.15 / 4)
        for n, outs in out.items():
            for m in outs:
                new[m] += 0.85 * score[n] / len(outs)
        score = new
    got = {r.node: r.score for r in graph.rank_scores(frame(spark, "src string, dst string", *links), "a").collect()}
    assert got == pytest.approx({n: s / max(score.values()) for n, s in score.items()}, abs=1e-8)


def test_packing(spark):
    df = frame(spark, "query int, key string, rank int, tokens int, text string, file string", (1, "a", 1, 5, "aaaaa", "f"), (1, "b", 2, 6, "bbbbbb", "f"), (1, "c", 3, 1, "c", "f"), (2, "d", 1, 99, "d" * 99, "g"))
    packed = packing.pack_prefix(df, [5, 11, 12])
    got = {(r.query, r.budget): (r.selected, r.used) for r in packing.pack_summary(packed, df, [5, 11, 12]).collect()}
    assert got == {(1, 5): (1, 5), (1, 11): (2, 11), (1, 12): (3, 12), (2, 5): (0, 0), (2, 11): (0, 0), (2, 12): (0, 0)}
    exact = packing.pack_exact(df, 13, lambda rows: "\n".join(r["text"] for r in rows), len)
    assert sorted((r.key, r.used) for r in exact.collect()) == [("a", 12), ("b", 12)]
    assert packing.render_by_file(df).where("query = 1").first().context == "### f\naaaaa\nbbbbbb\nc"


def test_bands_and_files(spark):
    df = frame(spark, "query int, key string, file string, rank int", *[(1, f"k{n % 13}", f"f{n % 3}", n) for n in range(1, 31)])
    rows = packing.rank_bands(df).orderBy("band", "position").collect()
    assert [r["rank"] for r in rows if r.band == "primary"] == [1, 2, 3, 4] and [r["rank"] for r in rows if r.band == "tail"] == [11, 12, 13, 18]
    assert [r.file for r in packing.one_per_file(df, 2).orderBy("rank").collect()] == ["f1", "f2"]
    slots = packing.evaluation_slots(frame(spark, "i int, v string, p string, h string", (1, "a", "x", "h"), (1, "b", "y", "h"), (1, "c", "x", "h")), "i", "v", "p", "h")
    assert {r.v: r.slot for r in slots.collect()} == {"a": 1, "b": 2, "c": 1}
    assert packing.first_applicable(frame(spark, "i int, n int, ok boolean, p string", (1, 1, False, "x"), (1, 3, True, "z"), (1, 2, True, "y")), "i", "n", "ok", "p").first().p == "y"
    shards = packing.balanced_shards(frame(spark, "r string", *[(x,) for x in "aaaaabbbccd"]), "r", 2)
    assert shards == {"a": 0, "b": 1, "c": 1, "d": 0}


PATCH = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,4 +1,4 @@
 def f():
-    return 1
+    return 2
 
 x = 1
@@ -10,0 +11,2 @@
+def g():
+    pass
"""


def test_diffs(spark):
    df = frame(spark, "id int, patch string", (1, PATCH))
    lines = patches.patch_lines(df, "id", "patch")
    assert {(r.file, r.line_no) for r in patches.changed_lines(lines, "id").collect()} == {("m.py", 2), ("m.py", 3), ("m.py", 11)}
    p = patches.hunk_profile(lines, "id").first()
    assert (p.hunks, p.added, p.removed, p.only_added, p.mixed) == (2, 3, 1, 1, 1)
    base = frame(spark, "id int, file string, name string, kind string, start int, end int", (1, "m.py", "f", "function", 1, 2), (1, "m.py", "x", "assignment", 4, 4))
    after = frame(spark, "id int, file string, name string, kind string, start int, end int", (1, "m.py", "f", "function", 1, 2), (1, "m.py", "g", "function", 11, 12))
    assert [(r.name, r.kind, r.evidence) for r in patches.patch_targets(lines, base, after, "id").collect()] == [("f", "function", "removed_line+added_line")]
    only = patches.patch_targets(lines.where("hunk = 2"), base, after, "id").collect()
    assert [(r.kind, r.evidence) for r in only] == [("file", "file_fallback")]
    cover = patches.line_coverage(frame(spark, "id int, file string, start int, end int", (1, "m.py", 1, 2)), patches.changed_lines(lines, "id"), "id").first()
    assert (cover.covered, cover.total, cover.complete) == (1, 3, 0)
    source = "def f():\n    return 1\n\nx = 1\n5\n6\n7\n8\n9\n10\n11"
    assert patches.apply_patch(source, PATCH) == "def f():\n    return 2\n\nx = 1\n5\n6\n7\n8\n9\n10\ndef g():\n    pass\n11"
    assert spark.range(1).select(patches.minimal_patch(F.lit(PATCH)).alias("m")).first().m.split("\n") == ["-return1", "+return2", "+defg():", "+pass"]


SOURCE = '''import os
from . import sib
from pkg.mod import thing

X = {"b", "a"}

class A:
    """Doc."""
    y: int = 2

    async def go(self):
        return helper(1)

    class B:
        def f(self, a=1): pass

def helper(v):
    return os.path.join(v)
'''


def test_parsers(spark):
    files = frame(spark, "path string, content string", ("pkg/x.py", SOURCE), ("bad.py", "def ("), ("pkg/sib.py", ""), ("pkg/mod.py", ""))
    got = {(r.kind, r.name) for r in parsers.entities(files, ["path"]).collect()}
    assert got == {("assignment", "X"), ("class", "A"), ("assignment", "A.y"), ("function", "A.go"), ("class", "A.B"), ("function", "A.B.f"), ("function", "helper")}
    assert ("function", "A.go") not in {(r.kind, r.name) for r in parsers.entities(files, ["path"], with_async=False).collect()}
    assert {(r.caller, r.callee) for r in parsers.calls(files, ["path"]).collect()} == {("A.go", "helper"), ("helper", "os.path.join")}
    edges = parsers.import_edges(parsers.imports(files, ["path"]), files)
    assert {(r.src, r.dst) for r in edges.collect()} == {("pkg/x.py", "pkg/sib.py"), ("pkg/x.py", "pkg/mod.py")}


def test_audits(spark):
    rows = frame(spark, "id int, text string", (12, "see #12"), (12, "see #123"), (3, "diff --git a b"))
    assert [r.leaks for r in audit.leak_flags(rows, F.col("text"), F.col("id")).collect()] == [True, False, True]
    a, b = rank_table(spark, ["x", "y"]), rank_table(spark, ["y", "x"])
    assert audit.same_sequences(a, a).first().same and not audit.same_sequences(a, b).first().same
    kept = frame(spark, "id int, details array<struct<dst:string,dst_label:string>>", (1, [("root", "Issue"), ("f", "File")]), (2, [("issue#4", "Issue")]), (3, None))
    assert sorted(r.id for r in audit.history_free(kept).collect()) == [1, 3]
    assert audit.reuse_rate(frame(spark, "g int, a string, b string", (1, "x", "x"), (1, "x", "y")), ["g"], "a", "b").first().reuse == 0.5


def word_rows(spark, n, seed):
    rnd = random.Random(seed)
    text = lambda k: " ".join(f"w{int(rnd.paretovariate(0.7)) % 60}" for _ in range(k))
    docs = [(k, text(rnd.randrange(0, 40)) if rnd.random() < 0.95 else None, rnd.choice(["a", "b", "c", None])) for k in range(n)] + [(None, "w1 w2", "a")]
    return spark.createDataFrame(docs, "doc_id long, text string, pool string"), spark.createDataFrame([(k, text(6)) for k in range(7)] + [(90, "zzz"), (91, None)], "query long, text string")


@pytest.mark.parametrize("options", [{}, {"pool": "pool", "query_frequency": True, "k1": 1.2}])
def test_ranking_in_chunks_is_ranking_by_joins(spark, monkeypatch, options):
    docs, queries = word_rows(spark, 300, 1)
    got = lambda: sorted(map(str, retrieval.bm25_top(docs, queries, 4, **options).select("query", "doc_id", *options.keys() & {"pool"}, "score", "rank").collect()))
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 100)
    chunks = got()
    monkeypatch.setattr(retrieval, "MOST_WANTED", 3)
    assert len(chunks) > 10 and chunks == got()


def test_overlap_in_chunks_is_overlap_by_joins(spark, monkeypatch):
    docs, queries = word_rows(spark, 200, 2)
    got = lambda: sorted(map(tuple, retrieval.overlap_top(docs, queries, 5).select("query", "doc_id", "score", "rank").collect()))
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 60)
    chunks = got()
    monkeypatch.setattr(retrieval, "MOST_WANTED", 3)
    assert chunks == got()


def test_nearest_values_against_all_pairs(spark):
    rnd = random.Random(3)
    items = [(k, rnd.choice([5, 100, 100, rnd.randrange(30000), None])) for k in range(400)]
    queries = [(k, rnd.choice([0, 7, 100, 29000, 10**6])) for k in range(9)] + [(50, None)]
    got = retrieval.nearest_values(spark.createDataFrame(items, "key long, value int"), spark.createDataFrame(queries, "query long, value int"), 6)
    want = [(q, key, r) for q, v in queries if v is not None for r, (_, key) in enumerate(sorted((abs(x - v), key) for key, x in items if x is not None)[:6], 1)]
    assert sorted((r.query, r.key, r["rank"]) for r in got.collect()) == sorted(want)
    empty = spark.createDataFrame([], "key long, value int")
    assert retrieval.nearest_values(empty, spark.createDataFrame(queries, "query long, value int"), 6).count() == 0


def test_dense_queries_in_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    vector = lambda: [rnd.randrange(-3, 4) / 2 for _ in range(4)]
    rows = [(k, vector(), f"f{k % 7}") for k in range(60)]
    items = spark.createDataFrame([*rows, (60, None, "f1"), (61, [1.0], "f2"), (62, [None, 1.0, 1.0, 1.0], "f3"), (63, [0.0] * 4, "f4")], "key long, vector array<double>, file string").repartition(3)
    asked = [(k, vector()) for k in range(6)]
    queries = spark.createDataFrame([*asked, (9, None), (10, [0.0] * 4)], "query long, vector array<double>")

    def cosine(v, w):
        n = math.sqrt(sum(x * x for x in v) * sum(x * x for x in w))
        return round(sum(x * y for x, y in zip(v, w)) / n, 6) if n else 0.0

    scores = {q: sorted((-cosine(v, w), k, f) for k, v, f in [*rows, (63, [0.0] * 4, "f4")]) for q, w in [*asked, (10, [0.0] * 4)]}
    want = {(q, k, n + 1) for q, s in scores.items() for n, (_, k, _) in enumerate(s[:5])}
    first = set()
    for q, s in scores.items():
        files = sorted({f: min(x[0] for x in s if x[2] == f) for f in {x[2] for x in s}}.items(), key=lambda x: (x[1], x[0]))
        taken, members = [], 0
        for n, (f, _) in enumerate(files):
            if members < 12 or n < 2:
                taken.append(f)
            members += sum(x[2] == f for x in s)
        first |= {(q, k, n + 1, taken.index(f) + 1) for n, (_, k, f) in enumerate([x for x in s if x[2] in taken][:12])}
    for cells in (retrieval.DENSE_CELLS, 8):
        monkeypatch.setattr(retrieval, "DENSE_CELLS", cells)
        assert {(r.query, r.key, r.rank) for r in retrieval.dense_top(items, queries, 5).collect()} == want
        assert {(r.query, r.key, r.rank, r.file_rank) for r in retrieval.dense_file_first(items, queries, 12, 2).collect()} == first


def test_binned_intervals_are_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice("ab"), s, s + rnd.randrange(-2, 40)) for k in range(60) for s in [rnd.randrange(-50, 100)]]
    df = spark.createDataFrame(rows, "name long, f string, start int, end int")
    inner = df.select("name", "f", (F.col("start") + 3).alias("start"), (F.col("start") + 5).alias("end"))
    for make in (lambda **w: intervals.overlapping(df.where("start <= end"), df.where("start <= end"), "f", **w).select("name", "other_name"), lambda **w: intervals.enclosing(inner, df, "f", "name", **w).select("name", "outer_name")):
        assert sorted(map(tuple, make().collect())) == sorted(map(tuple, make(width=7).collect())) != []


def test_percentiles_without_collecting(spark):
    rows = spark.createDataFrame([("a", v) for v in (3, 1, 2, 2, None)] + [("b", 9), ("c", None)], "g string, v int")
    got = {r.g: (r.interpolated, r.nearest_rank, r.truncated_index) for r in metrics.percentiles(rows, ["g"], "v", 0.5).collect()}
    assert got["a"] == (2.0, 2, 2) and got["b"] == (9.0, 9, 9) and got["c"] == (None, None, None)


def test_greedy_and_demoting_builders(spark):
    rows = [(1, k, f"k{k}", "primary" if k <= 3 else "tail", "x" * size) for k, size in enumerate([50, 30, 40, 30, 10], 1)]
    df = spark.createDataFrame(rows, "query int, rank int, key string, band string, text string")
    render = lambda items: "".join(r["text"] if r.get("mode", "source") == "source" else "m" for r in items)
    greedy = lambda budget: [r.key for r in packing.pack_greedy(df, budget, render, len).orderBy("rank").collect()]
    assert greedy(95) == ["k1", "k2", "k5"] and greedy(10) == ["k1"]
    fit = lambda budget: [(r.key, r["mode"]) for r in packing.demote_and_drop(df, budget, render, len).orderBy("rank").collect()]
    s, m = "source", "metadata"
    assert fit(200) == [("k1", s), ("k2", s), ("k3", s), ("k4", s), ("k5", s)]
    assert fit(115) == [("k1", s), ("k2", s), ("k3", m), ("k4", s), ("k5", m)]
    assert fit(83) == [("k1", s), ("k2", m), ("k3", m), ("k4", s), ("k5", m)]
    assert fit(81) == [("k1", s), ("k2", m), ("k4", s)] and fit(80) == [("k1", s), ("k4", s)] and fit(79) == []


def test_bands_by_windows(spark):
    rows = [(1, f"k{k % 17}", f"f{k % 3}", k) for k in range(1, 40)]
    got = packing.rank_bands(spark.createDataFrame(rows, "query int, key string, file string, rank int"))
    want, seen = [], set()
    for band, part in (("primary", rows[:10]), ("tail", rows[10:])):
        files, taken, first = {}, 0, set()
        for _, key, file, rank in part:
            if taken == 4 or key in seen or key in first:
                continue
            first.add(key)
            if files.get(file, 0) == 2:
                continue
            files[file] = files.get(file, 0) + 1
            taken += 1
            want.append((key, rank, band, taken))
        seen |= {w[0] for w in want}
    assert sorted((r.key, r["rank"], r.band, r.position) for r in got.collect()) == sorted(want)


def test_resolved_paths(spark):
    files = ["pkg/core/parser.py", "pkg/core/parsers.py", "pkg/util.py", "docs/parser.rst", "pkg/core/parser.pyx"]
    wanted = ["pkg/core/parser.py", "pkg/core/parse.py", "pkg\\\\utils.py".replace("\\\\", "\\"), "zzz.py", "docs/parse.rst", "none.java"]
    df = spark.createDataFrame([("r", w) for w in wanted], "repo string, wanted string")
    known = spark.createDataFrame([("r", f) for f in files] + [("q", "zzz.py")], "repo string, path string")
    got = {r.wanted: (r.path, r.score) for r in joins.resolve_paths(df, known, "repo").collect()}
    for w in (x.replace("\\", "/") for x in wanted):
        scored = []
        for f in files:
            if os.path.splitext(w)[1] and os.path.splitext(f)[1] != os.path.splitext(w)[1]:
                continue
            score = difflib.SequenceMatcher(None, w, f).ratio() + 0.15 * (os.path.dirname(w) != "" and os.path.dirname(w) == os.path.dirname(f))
            scored.append((score + 0.1 * os.path.basename(f).startswith(os.path.splitext(os.path.basename(w))[0]), f))
        best = (1.0, w) if w in files else max((x for x in scored if x[0] >= 0.72), default=None)
        assert got.get(w) == (best and (best[1], pytest.approx(best[0]))), w
    assert got["pkg/core/parse.py"][0] == "pkg/core/parser.py" and "none.java" not in got


def test_subsequence_ratio_against_the_table(spark):
    rnd = random.Random(9)
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randrange(9))), "".join(rnd.choice("abc") for _ in range(rnd.randrange(90)))) for _ in range(40)]

    def length(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = row[:]
            for k, d in enumerate(y, 1):
                row[k] = last[k - 1] + 1 if c == d else max(last[k], row[k - 1])
        return row[-1]

    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", joins.sequence_ratio("a", "b").alias("v")).collect():
        assert r.v == (1.0 if not r.a and not r.b else length(r.a, r.b) / max(len(r.a), len(r.b)))


def test_items_widen_to_their_class(spark):
    content = "\n".join(f"line {k}" for k in range(1, 401))
    classes = spark.createDataFrame([("a.py", "Small", 10, 20), ("a.py", "Inner", 12, 15), ("a.py", "Large", 100, 350)], "file string, name string, start int, end int")
    items = [("k1", "Small.f(x)", 13, "t"), ("k2", "f", 13, "t"), ("k3", "Large.g", 120, "t"), ("k4", "Large.g", 120, " "), ("k5", "Large.g", 5, "t"), ("k6", "top", 50, "t"), ("k7", "Small.Inner.f: y", 300, "t"), ("k8", None, None, "t")]
    df = spark.createDataFrame([(1, k, "a.py", s, at, at, t) for k, s, at, t in items], "query int, key string, file string, signature string, start_line int, end_line int, text string")
    got = {r.key: (r.context_class, r.start_line, r.end_line, r.text.count("line")) for r in packing.class_scope(df, classes, spark.createDataFrame([("a.py", content)], "file string, content string")).collect()}
    assert got == {"k1": ("Small", 10, 20, 11), "k2": ("Inner", 12, 15, 4), "k3": (None, 120, 120, 0), "k4": ("Large", 100, 279, 180), "k5": ("Large", 100, 279, 180), "k6": (None, 50, 50, 0), "k7": ("Inner", 12, 15, 4), "k8": (None, None, None, 0)}
