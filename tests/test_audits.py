"""Expectations, the stored index, line provenance, temporal provenance and prompt coverage, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import audit, expectations, inverted_index, retrieval
from rankloom.sources import provenance


def test_expectations_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "c", 3.0), (4, None, -1.0)], "k int, s string, v double")
    e = expectations
    wanted = [e.not_null("k"), e.one_of("s", ["a", "b", "c"]), e.between("v", F.lit(0), F.lit(5), 0.5), e.matches("s", "^[a-c]$", 0.75), e.total("sum", F.sum("v"), 3, 3), e.total("none", F.sum(F.col("v")).cast("int") * None, 0)]
    got = {r.expectation: (r.rows, r.failed, r.value, r.ok) for r in e.report({"t": (df, wanted)}).collect()}
    assert got == {
        "k is not null": (4, 1, None, False), "s is known": (4, 1, None, False), "v is in range": (4, 2, None, True), "s has its form": (4, 1, None, True), "sum": (4, None, 3.0, True), "none": (4, None, None, False),
    }
    assert all(r.ok for r in e.report({"t": (df.limit(0), wanted[:4])}).collect())
    with pytest.raises(AssertionError, match="t: k is not null"):
        e.assert_all(e.report({"t": (df, wanted)}))


def test_observed_table_passes_through(spark):
    df, watch = expectations.observed(spark.range(10).toDF("k"), [expectations.between("k", F.lit(0), F.lit(8))])
    assert df.count() == 10 and expectations.verdict("t", [expectations.not_null("k")], watch.get)[0][2:4] == (10, 1)


def test_reconciliation(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, None), (3, 1.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 2.5), (2, 1.0 + 1e-12, None), (4, 0.0, 0.0)], "k int, x double, y double")
    got = sorted((tuple(r) for r in expectations.reconcile(a, b, ["k"], ["x", "y"]).collect()), key=str)
    assert got == [(1, "y", 2.0, 2.5), (3, "x", 1.0, None), (3, "y", 1.0, None), (4, "x", None, 0.0), (4, "y", None, 0.0)]


def ranks(df):
    return sorted((r.query, r.doc_id, r.score, r.rank) for r in df.select("query", "doc_id", "score", "rank").collect())


def test_index_gives_the_ranking_of_a_scan(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 60}"
    docs = [(k * 37, " ".join(word() for _ in range(rnd.randrange(40)))) for k in range(400)] + [(-5, "w1 w2"), (99999, None), (99998, "")]
    df = spark.createDataFrame([*docs, (None, "w1")], "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(word() for _ in range(rnd.randrange(1, 6)))) for q in range(12)] + [(50, "unknown"), (51, None), (None, "w1")], "query long, text string")
    path = f"file://{tmp_path}/index"
    inverted_index.append(df.where("doc_id % 2 = 0 OR doc_id IS NULL"), path, buckets=8)
    inverted_index.append(df.where("doc_id % 2 <> 0"), path, buckets=8)
    for k in (1, 5, 1000):
        assert ranks(inverted_index.search(spark, path, queries, k)) == ranks(retrieval.bm25_top(df, queries, k))
    plan = spark.read.parquet(f"{path}/postings").where("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def replay(hunks):
    files = {}
    for h in sorted((h for h in hunks if h[0] is not None and h[1] is not None), key=lambda h: (h[0], h[1], -(h[3] or -1), h[4] or 0, h[5] or 0, h[2] or "")):
        file, _, commit, start, old, new = h
        lines = files.setdefault(file, [])
        at = min(max((start or 1) - 1, 0), len(lines))
        lines[at : at + max(old or 0, 0)] = [commit] * max(new or 0, 0)
    return files


def test_lines_replayed_from_hunks(spark):
    rnd = random.Random(6)
    hunks = [(f"f{rnd.randrange(5)}", k, f"c{rnd.randrange(40)}", rnd.randrange(-2, 200), rnd.randrange(6), rnd.randrange(5)) for k in range(900)]
    hunks += [("big", k, f"c{k}", 1 + (k * 7919) % (2 * k + 1), k % 3 == 0, 2) for k in range(2000)]
    hunks += [(None, 1, "x", 1, 0, 1), ("f0", None, "x", 1, 0, 1), ("gone", 1, "x", 1, 0, 3), ("gone", 2, "y", 1, 9, 0), ("nulls", 1, None, None, None, 2)]
    hunks = [(*h[:4], int(h[4]) if h[4] is not None else None, h[5]) for h in hunks]
    df = spark.createDataFrame(hunks, "file string, position int, commit string, start_line long, old_lines long, new_lines long").repartition(3)
    rows = provenance.line_provenance(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.start_line)):
        lines = got.setdefault(r.file, [])
        assert r.start_line == len(lines) + 1 and (not lines or lines[-1] != r.commit)
        lines += [r.commit] * (r.end_line - r.start_line + 1)
    assert got == {f: lines for f, lines in replay(hunks).items() if lines}
    assert max(map(len, got.values())) > 2000


def test_query_of_line_provenance_against_replay(spark):
    from rankloom.plans import queries
    from rankloom.plans.audits import order_hunks

    sf = "/root/testdata/sf0.001"
    want = {f: lines for f, lines in replay([tuple(r) for r in order_hunks(spark, sf).collect()]).items() if lines}
    rows = queries()["line_provenance"](spark, sf).collect()
    assert {f: sum(r.end_line - r.start_line + 1 for r in rows if r.file == f) for f in {r.file for r in rows}} == {f: len(x) for f, x in want.items()}
    assert all(want[r.file][r.start_line - 1] == r.commit == want[r.file][r.end_line - 1] for r in rows)


def test_history_after_the_cutoff_changes_the_ranking(spark):
    structural = spark.createDataFrame([(1, "a", 1, ["issue#1"]), (1, "b", 2, None), (1, "c", 3, ["issue#2", "issue#1"]), (1, "a", 4, []), (2, "d", 1, ["pr#9"]), (3, "e", 1, ["issue#1"])], "query int, key string, rank int, nodes array<string>")
    artifacts = spark.createDataFrame([("issue#1", 5, 6), ("issue#2", 5, 99)], "artifact string, created int, modified int")
    cutoffs = spark.createDataFrame([(1, 10), (2, 10), (3, 5), (4, 1)], "query int, cutoff int")
    other = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "x", 1)], "query int, key string, rank int")
    got = {r.query: (r.history_rows, r.ineligible_rows, r.history_only, r.same_top20, r.same_top50) for r in audit.temporal_provenance(structural, artifacts, cutoffs, [("other", other)], []).collect()}
    assert got == {1: (2, 1, 1, False, False), 2: (1, 1, 1, False, False), 3: (1, 1, 1, False, False), 4: (0, 0, 0, True, True)}
    fine = audit.temporal_provenance(structural.where("key <> 'c'"), artifacts, cutoffs.where("query = 1"), [("other", other)], []).first()
    assert fine.same_top20 and fine.ineligible_rows == 0 and fine.current_digest == fine.strict_digest


def test_prompts_are_read_back(spark):
    block = lambda sig, a, b, source: f"- signature : {sig}\n- start_line : {a}\n- end_line : {b}\n" + ("- source_authority : x\n" if source else "")
    prompts = [("v", 1, block("m.f", 1, 5, True) + block("m.g", 7, 9, False) + block("zzz", 0, 0, True)), ("v", 2, "nothing"), ("w", 1, block("m.g(x)", 7, 9, True))]
    methods = [("v", 1, 10, 1, "m.f", 1, 5, "a.py", "function", "f"), ("v", 1, 11, 2, "m.g(x, y)", 7, 9, "a.py", "function", "g"), ("w", 1, 11, 1, "m.g(x)", 7, 8, "a.py", "function", "g")]
    targets = [(1, "t1", "function", "a.py", "f"), (1, "t2", "function", "a.py", "g"), (2, "t3", "file", "a.py", "")]
    got = audit.prompt_coverage(
        spark.createDataFrame(prompts, "variant string, instance int, text string"),
        spark.createDataFrame(methods, "variant string, instance int, id int, ordinal int, signature string, start_line int, end_line int, file string, kind string, name string"),
        spark.createDataFrame(targets, "instance int, target string, target_type string, file string, name string"),
    ).collect()
    assert {(r.variant, r.instance): (r.rendered, r.with_source, r.target_count, r.matched, r.hit, r.complete) for r in got} == {
        ("v", 1): (3, 1, 2, 1, 1, 0), ("v", 2): (0, 0, 1, 0, 0, 0), ("w", 1): (1, 1, 2, 1, 1, 0),
    }
    assert all(r.tokens == math.ceil(len(t) / 4) for r in got for v, i, t in prompts if (v, i) == (r.variant, r.instance))


def test_qualified_names_to_files(spark):
    from rankloom.operators import linking

    files = [
        "a/src/main/java/org/x/Foo.java", "a/src/main/java/org/x/Foo/Bar.java", "b/src/main/java/org/x/Foo.java", "b/src/main/java/org/test/Only.java", "b/src/main/java/Top.java", "build/src/main/java/org/x/Foo.java",
        "c/org/x/Lost.java", "b/src/main/java/org/y/Only.java", "b/src/main/java/org/y/readme.txt",
    ]
    names = ["org.x.Foo.Bar.baz", "org.x.Foo.run", "org.x", "Only.go", "q.Foo$In.m", "Lost", "org.y.readme", "", "..", "Top", "lower.case"]
    df = spark.createDataFrame([("g", f) for f in files] + [("bare", "p/Q.java"), ("bare", "p/r/S.java")], "g string, path string")
    asked = spark.createDataFrame([("g", n) for n in names] + [("bare", "p.Q.x"), ("bare", "p.r"), ("bare", "z.S")], "g string, name string")
    got = {}
    for r in linking.type_files(asked, df, "g").collect():
        got.setdefault((r.g, r.name), set()).add((r.kind, r.path))
    a, b = "a/src/main/java/", "b/src/main/java/"
    assert got == {
        ("g", "org.x.Foo.Bar.baz"): {("file", a + "org/x/Foo/Bar.java"), ("file", b + "org/x/Foo.java")}, ("g", "org.x.Foo.run"): {("file", a + "org/x/Foo.java"), ("file", b + "org/x/Foo.java")},
        ("g", "org.x"): {("package", a + "org/x"), ("package", b + "org/x")}, ("g", "Only.go"): {("file", b + "org/y/Only.java")}, ("g", "q.Foo$In.m"): {("file", a + "org/x/Foo.java"), ("file", b + "org/x/Foo.java")},
        ("g", "Top"): {("file", b + "Top.java")}, ("bare", "p.Q.x"): {("file", "p/Q.java")}, ("bare", "p.r"): {("package", "p/r")}, ("bare", "z.S"): {("file", "p/r/S.java")},
    }


def test_items_of_context_builders(spark):
    from rankloom.operators import packing

    rows = [(1, f"k{n}", f, n, c) for n, (f, c) in enumerate([("a", False), ("b", True), ("a", True), ("a", True), ("c", True), ("a", False), ("a", True), ("a", True), ("a", True), *[(x, True) for x in "defgh"]], 1)]
    rows += [(2, "x", "a", 1, False), (2, "y", "a", 2, False)]
    df = spark.createDataFrame(rows, "query int, key string, file string, rank int, candidate boolean")
    order = lambda d, q: [(r.key, *([r.mode] if "mode" in d.columns else [])) for r in d.where(f"query = {q}").orderBy("position").collect()]
    assert order(packing.breadth_items(df), 1) == [("k1", "primary"), ("k2", "secondary"), ("k5", "secondary"), ("k10", "secondary"), ("k11", "metadata"), ("k12", "metadata")]
    assert order(packing.focus_items(df), 1) == [("k3",), ("k4",), ("k7",), ("k8",), ("k2",)] and order(packing.focus_items(df), 2) == [("x",), ("y",)]
    named = spark.createDataFrame([(1, "c", 2), (1, "a", 1), (1, "d", 3), (1, "a", 9)], "query int, file string, place int")
    assert order(packing.retry_items(df, named), 1) == [("k1", "primary"), ("k3", "secondary"), ("k4", "secondary"), ("k5", "metadata")]
