"""Operators that count or search instead of making pairs, against plain Python over all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import graph, joins, projection, stats


def test_projection_counts_against_all_pairs(spark):
    rnd = random.Random(3)
    words = ["parser", "parsers", "running", "my_name", "pkg.mod", "HTTPServer", "the", "queries", "xy", "retry", "Classes", "__init__", "node"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    entities = [(f"f{rnd.randrange(4)}", rnd.choice([*words, None]), text(2), k if k % 5 else None, text(rnd.randrange(12))) for k in range(40)]
    df = spark.createDataFrame(entities, "file string, name string, signature string, start_line int, source string").withColumn("key", F.col("signature"))
    issues = [(q, text(2), text(6) + ("\nTraceback x\n" + text(3) if q % 2 else "")) for q in range(6)]
    terms = tx.section_terms(tx.sections(spark.createDataFrame(issues, "query int, title string, body string"), "query", F.col("title"), F.col("body")))
    files = spark.createDataFrame([(q, f"f{k}", k) for q in range(6) for k in range(4) if (q + k) % 3], "query int, file string, best_rank int")
    got = {(r.query, r.file, r.name, r.signature, r.start_line): tuple(r[c] for c in projection.COUNTS) + (r.file_rank, r.is_boilerplate) for r in projection.projection_features(df, terms, files).collect()}
    symbol = F.concat_ws("\n", "name", "signature", "file")
    sets = df.select("*", tx.split_terms(symbol).alias("s"), tx.exact_terms(symbol).alias("se"), tx.split_terms(F.col("source")).alias("t"), tx.exact_terms(F.col("source")).alias("te")).collect()
    want = {}
    for q in terms.collect():
        for f in files.collect():
            for e in sets:
                if f.query == q[0] and f.file == e.file:
                    s, se, t, te = map(set, (e.s, e.se, e.t, e.te))
                    title, exact, narrative, diagnostic, issue = map(set, (q.title_terms, q.exact_terms, q.narrative_terms, q.diagnostic_terms, q.issue_terms))
                    counts = (len(title & s), len(title & t), len(exact & se), len(exact & te), len(narrative & s), len(narrative & t), len(diagnostic & se), len((issue & t) - (issue & s)))
                    want[q[0], e.file, e.name, e.signature, e.start_line] = (*counts, f.best_rank or 999, got[q[0], e.file, e.name, e.signature, e.start_line][-1])
    assert got == want and any(c[6] for c in want.values())
    everything = projection.project_entities(projection.projection_features(df, terms, files), "signature")
    for k in (1, 3, 15):
        best = projection.best_projected(df, terms, files, k, "signature")
        assert sorted(map(str, best.collect())) == sorted(map(str, everything.where(F.col("rank") <= k).select(*best.columns).collect()))


def signs(values):
    t = abs(sum(values)) - 1e-12
    sums = [sum(x * s for x, s in zip(values, flip)) for flip in itertools.product((1, -1), repeat=len(values))]
    return sum(abs(x) >= t for x in sums) / len(sums)


def test_sign_flip_in_the_middle(spark, monkeypatch):
    rnd = random.Random(7)
    groups = {f"g{n}": [rnd.choice([0.0, 0.5, 1.0, -1.0, rnd.random()]) for _ in range(n)] for n in range(1, 13)}
    df = spark.createDataFrame([(g, f"c{k:02}", v) for g, vs in groups.items() for k, v in enumerate(vs)], "g string, c string, v double")
    want = {g: pytest.approx(signs(vs), abs=1e-9) for g, vs in groups.items()}
    assert {r.g: r.p for r in stats.sign_flip(df, ["g"], "v", "c").collect()} == want
    monkeypatch.setattr(stats, "MIDDLE", 4)  # the other signs as rows
    assert {r.g: r.p for r in stats.sign_flip(df, ["g"], "v", "c").collect()} == want


def test_sign_flip_of_forty_clusters(spark):
    df = spark.createDataFrame([("a", k, 1.0) for k in range(40)] + [("b", k, 0.5) for k in range(36)] + [("b", k, -0.5) for k in range(36, 42)], "g string, c int, v double")
    got = {r.g: (r.clusters, r.p) for r in stats.sign_flip(df, ["g"], "v", "c").collect()}
    from math import comb

    tail = sum(comb(42, k) for k in range(36, 43)) * 2 / 2**42
    assert got == {"a": (40, 0.0), "b": (42, pytest.approx(tail, abs=1e-9))}


def walks(edges, labels, root, first_not, middle_not, targets, hops):
    after = {}
    for a, b in set(edges):
        after.setdefault(a, []).append(b)
    found, front = {}, [(root,)]
    for n in range(1, hops + 1):
        front = [p + (b,) for p in front for b in after.get(p[-1], []) if b not in p]
        for p in front:
            if labels.get(p[-1]) in targets:
                found.setdefault(p[-1], []).append(p)
        front = [p for p in front if p[-1] in labels and labels[p[-1]] not in (first_not if n == 1 else middle_not)]
    out = {}
    for node, paths in found.items():
        d = min(map(len, paths))
        best = [p for p in paths if len(p) == d]
        out[node] = (d - 1, len({p[1] for p in best}), min(best))
    return out


def test_evidence_paths_against_all_walks(spark):
    rnd = random.Random(11)
    for _ in range(2):
        names = [f"n{k}" for k in range(14)]
        labels = {n: rnd.choice(["I", "F", "M", "D"]) for n in names[:-1]}
        edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(45)]
        args = (["M"], ["D", "F"], ["F", "M"], 4)
        want = {r: walks(edges, labels, r, *args) for r in names[:3]}
        e, n = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(labels.items()), "node string, label string")
        rows = graph.evidence_paths(e, n, spark.createDataFrame([(r,) for r in names[:3]], "root string"), *args).collect()
        got = {r: {x.node: (x.distance, x.support, tuple(x.path)) for x in rows if x.root == r} for r in names[:3]}
        assert got == want
        assert {x.node: x.support for x in graph.evidence_paths(e, n, names[0], *args).collect()} == {k: v[1] for k, v in want[names[0]].items()}


def test_evidence_paths_through_a_hub(spark):
    hub = [("r", f"a{k}") for k in range(100)] + [(f"a{k}", "hub") for k in range(100)] + [("hub", f"b{k}") for k in range(10_000)] + [(f"b{k}", "t") for k in range(10_000)]
    nodes = spark.createDataFrame([(x, "T" if x == "t" else "N") for x in {b for _, b in hub}], "node string, label string")
    r = graph.evidence_paths(spark.createDataFrame(hub, "src string, dst string"), nodes, "r", [], [], ["T"], 4).collect()
    assert [(x.node, x.distance, x.support, x.path) for x in r] == [("t", 4, 100, ["r", "a0", "hub", "b0", "t"])]


def test_suffix_and_substring_joins(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab/é") for _ in range(rnd.randrange(n)))
    left = [(rnd.choice("gh"), word(9), k) for k in range(60)] + [("g", None, 99)]
    right = [(rnd.choice("gh"), word(5), k) for k in range(40)] + [("g", "abababababé", 98), (None, "a", 97)]
    a, b = spark.createDataFrame(left, "g string, path string, i int"), spark.createDataFrame(right, "g string, part string, j int")
    pairs = [(x, y) for x in left for y in right if x[0] == y[0] and x[1] is not None and y[1] is not None]
    ends = sorted((x[2], y[2]) for x, y in pairs if x[1].endswith(y[1]) or y[1].endswith(x[1]))
    holds = sorted((x[2], y[2]) for x, y in pairs if y[1] in x[1] or x[1] in y[1])
    assert sorted((r.i, r.j) for r in joins.suffix_match(a, b, "g", "path", "part").collect()) == ends
    assert sorted((r.i, r.j) for r in joins.contains_match(a, b, "g", "path", "part").collect()) == holds


def test_same_file_rows_near_anchors(spark):
    from rankloom.operators import ranking

    rnd = random.Random(9)
    line = lambda: rnd.choice([rnd.randrange(50), rnd.randrange(5000), None])
    pool = [(f"k{k}", f"f{rnd.randrange(3)}", s, None if s is None or k % 4 == 0 else s + rnd.randrange(300)) for k in range(150) for s in [line()]] + [("z", "lonely", 5, 9)]
    anchors = [(q, k, f, s, e) for q in range(6) for k, f, s, e in rnd.sample(pool, 3)] + [(9, "z", "lonely", 5, 9), (10, "new", "f1", 100_000, None), (11, "no", "missing", 1, 2)]
    a, p = spark.createDataFrame(anchors, "query int, key string, file string, start_line int, end_line int"), spark.createDataFrame(pool, "key string, file string, start_line int, end_line int")
    every = ranking.same_file_tail(a.where("start_line IS NOT NULL"), p.where("start_line IS NOT NULL").join(a.select("query", "file").distinct(), "file")).join(a.select("query", "key"), ["query", "key"], "left_anti")
    for k in (4, 1000):
        # rows of keys that are anchors without a line stay out on both sides
        want = {}
        for r in sorted(every.collect(), key=lambda r: r["rank"]):
            want.setdefault(r.query, []).append((r.key, r.gap))
        got = {}
        for r in ranking.same_file_top(a, p, k).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.key, r.gap))
        assert got == {q: rows[:k] for q, rows in want.items()}


def test_fingerprints_of_many_passages(spark):
    from rankloom.operators import audit

    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefg é\U0001f600") for _ in range(n))
    docs = [(k if k % 9 else None, text(rnd.randrange(900))) for k in range(60)] + [(70, None), (71, ""), (72, "a" * 500), (72, "a" * 31)]
    held = []
    for n in [1, 2, 3, 4, 20, 31, 32, 33, 60, 200] * 4:
        own = rnd.choice([t for _, t in docs if t and len(t) > 250])
        at = rnd.randrange(len(own) - n)
        held.append(own[at : at + n])
    passages = [*enumerate([*held, "a" * 31, "a" * 32, "a" * 33, text(40), text(5), "", None])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, p in passages if p and t and p in t}
    for most in (10_000, 20, 0):  # one by one; pieces known to all tasks; all pieces
        assert {tuple(r) for r in audit.contained_passages(*frames, most=most).collect()} == want
    long_ = text(50_000)
    assert len(audit.winnowed(long_)) < 0.1 * len(long_)
    assert all(audit.winnowed(long_[k : k + 32])[0] in set(audit.winnowed(long_).tolist()) for k in range(0, 2000, 7))
    assert len(audit.winnowed("short")) == 0


def test_fuzzy_best_against_all_pairs(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(0, 12)))
    left, right = [(rnd.randrange(3), word()) for _ in range(60)] + [(0, None), (7, "alone")], [(rnd.randrange(3), word()) for _ in range(60)] + [(1, None), (2, "")]

    def ratio(x, y):
        rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                rows[i + 1][j + 1] = rows[i][j] + 1 if c == d else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1] / max(len(x), len(y)) if x or y else 1.0

    for least in (0.0, 0.5, 0.9):
        want = {}
        for g, x in set(left):
            scores = [(-ratio(x, y), y) for h, y in set(right) if h == g and x is not None and y is not None and ratio(x, y) >= least]
            if scores:
                want[g, x] = (min(scores)[1], -min(scores)[0])
        got = joins.fuzzy_best(spark.createDataFrame(left, "g int, a string"), spark.createDataFrame(right, "g int, b string"), "g", "a", "b", least).collect()
        assert {(r.g, r.a): (r.b, r.ratio) for r in got} == want
