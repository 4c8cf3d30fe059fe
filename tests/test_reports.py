import pytest
from pyspark.sql import functions as F

from rankloom.functions import code
from rankloom.operators import linking, reports


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_file_hits_and_histograms(spark):
    ranked = frame(spark, "query int, file string, rank int", (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 1))
    targets = frame(spark, "query int, file string", (1, "b"), (2, "z"))
    assert {r.top: r.hit_rate for r in reports.file_hits(ranked, targets, [1, 2]).collect()} == {1: 0.0, 2: 50.0}
    h = reports.rank_histogram(frame(spark, "g int, first_rank int", (1, 0), (1, 1), (1, 3), (1, 40)), ["g"])
    m = reports.mechanism_summary(h, ["g"]).first()
    assert (m.observed, m.missed, m.top1, m.top5, m.top15, m.beyond15, m.top1_percent) == (3, 1, 1, 2, 2, 1, 33.33)
    c = reports.cache_summary(frame(spark, "ranks map<int,int>", ({2: 1, 5: 3},), ({0: 1},), ({1: 0, 4: 1},), (None,))).first()
    assert (c.n, c.mrr, c.hit_rate) == (4, pytest.approx((0.5 + 0.25) / 4), 0.5)
    assert [r.symbol for r in reports.distinct_symbol_ranks(frame(spark, "query int, symbol string, rank int", (1, "x", 1), (1, "x", 2), (1, "y", 3))).orderBy("symbol_rank").collect()] == ["x", "y"]


def test_contrasts(spark):
    pairs = frame(spark, "eligible boolean, base_file_hit int, treat_file_hit int, base_hit int, treat_hit int, base_first_rank int, treat_first_rank int", (True, 1, 1, 0, 1, 0, 2), (True, 1, 1, 1, 1, 5, 3), (True, 1, 0, 1, 0, 1, 0), (False, 1, 1, 1, 1, 1, 1))
    o = reports.opportunity_matched(pairs, "hit").first()
    assert (o.n, o.baseline, o.treatment, o.delta, o.wins, o.ties, o.losses) == (2, 50.0, 100.0, 50.0, 1, 1, 0)
    s = reports.rank_shift(pairs).first()
    assert (s.n, s["shift"], s.earlier, s.same, s.later) == (2, -1.0, 1, 1, 0)
    g = frame(spark, "approach string, instance int, hit int", ("c", 1, 0), ("c", 2, 1), ("t", 1, 1), ("t", 2, 1))
    r = reports.against_control(g, "c", ["hit"]).first()
    assert (r.hit, r.hit_wins, r.hit_losses, r.p) == (100.0, 1, 0, 1.0)


def test_run_states(spark):
    dataset = frame(spark, "instance_id string", *[(x,) for x in "abcde"])
    predictions = frame(spark, "instance_id string, model_patch string, model_name_or_path string", ("a", "p", "m"), ("b", "", "m"), ("c", "p", "m"), ("d", "p", "m"))
    outcome = frame(spark, "instance_id string, resolved boolean", ("a", True), ("c", False))
    states = reports.run_states(dataset, predictions, outcome)
    assert {r.instance_id: r.state for r in states.collect()} == {"a": "resolved", "b": "empty_patch", "c": "unresolved", "d": "error", "e": "incomplete"}
    assert {r.state: r.n for r in reports.run_report(states).collect()}["completed"] == 2
    bad = predictions.unionByName(frame(spark, "instance_id string, model_patch string, model_name_or_path string", ("a", "q", "m"), ("z", None, "m")))
    assert {(r.instance_id, r.problem) for r in reports.prediction_checks(bad, dataset).collect()} == {("a", "duplicate"), ("z", "unknown"), ("z", "missing_field")}
    runs = frame(spark, "id string, outcome string", ("a", "failed"), ("a", "clean"), ("b", "unfinished"))
    assert {r.id: r.state for r in reports.retry_states(runs, frame(spark, "id string", ("a",), ("b",)), "id").collect()} == {"a": "complete", "b": "retry"}
    with pytest.raises(Exception, match="two clean runs"):
        reports.retry_states(runs, frame(spark, "id string", ("x",)), "id").collect()


def test_prompts(spark):
    prompt = "head\n- signature : A.f(x)\n- start_line : 3\n- end_line : 9\n- source_authority : base\ncode\n- signature : g\n- start_line : 1\n- end_line : 2\n- signature : lost\n"
    blocks = reports.rendered_blocks(frame(spark, "id int, text string", (1, prompt)), "id", "text")
    methods = frame(spark, "id_ int, signature string, start_line int, end_line int, id string, ordinal int", (1, "A.f(x)", 3, 9, "m1", 0), (1, "A.f(x)", 30, 90, "m2", 1), (1, "g(y)", 1, 2, "m3", 2)).withColumnRenamed("id", "mid").withColumnRenamed("id_", "id").withColumnRenamed("mid", "m")
    got = reports.resolve_blocks(blocks.withColumnRenamed("id", "k"), methods.withColumnRenamed("id", "k").withColumnRenamed("m", "id"), "k").orderBy("at").collect()
    assert [(r.signature, r.has_source, r.id, r.level) for r in got] == [("A.f(x)", 1, "m1", 0), ("g", 0, "m3", 2), ("lost", 0, None, None)]
    profile = {r.measure: r.value for r in reports.dataset_profile(frame(spark, "instance int, target_type string", (1, "function"), (1, "file"), (2, "file"), (3, "function"))).collect()}
    assert (profile["instances"], profile["targets"], profile["mixed"], profile["file_only"], profile["entity_only"], profile["two_targets"]) == (3, 4, 1, 1, 1, 1)


def test_links(spark):
    issues = frame(spark, "repo string, issue long, text string, created int, updated int", ("r", 1, 'see #2 and src/m.py\n  File "/x/src/m.py", line 3, in go', 1, 1), ("r", 2, "fixes #3", 1, 1), ("r", 3, "none", 1, 99))
    assert {(r.src, r.dst) for r in linking.issue_references(issues, issues).collect()} == {(1, 2), (2, 3)}
    reached = linking.expand_issues(issues.where("issue = 1").select("repo", "issue"), issues, F.lit(10)).collect()
    assert {(r.issue, r.depth) for r in reached} == {(1, 0), (2, 1)}
    files = frame(spark, "repo string, path string", ("r", "src/m.py"), ("r", "lib/src/m.py"), ("r", "other.py"))
    assert {r.path for r in linking.file_links(issues, files).collect()} == {"src/m.py", "lib/src/m.py"}
    entities = frame(spark, "repo string, path string, name string", ("r", "src/m.py", "A.go"), ("r", "src/m.py", "helper_fn"), ("r", "other.py", "B.go"))
    assert {(r.path, r.name) for r in linking.trace_links(issues, entities).collect()} == {("src/m.py", "A.go")}
    refs = frame(spark, "repo string, issue long, reference string", ("r", 1, "helper_fn"), ("r", 1, "pkg.helper_fn"), ("r", 1, "word"))
    assert {(r.reference, r.name, r.weight) for r in linking.resolve_references(refs, entities).collect()} == {("helper_fn", "helper_fn", 0.25), ("pkg.helper_fn", "helper_fn", 1.0)}
    calls = frame(spark, "repo string, path string, caller string, callee string", ("r", "src/m.py", "A.run", "self.go"), ("r", "other.py", "B.go", "helper_fn"))
    assert {(r.caller, r.to_path, r.name) for r in linking.resolve_calls(calls, entities).collect()} == {("A.run", "src/m.py", "A.go"), ("B.go", "src/m.py", "helper_fn")}
    none = frame(spark, "repo string, issue long, path string, n int", ("r", 1, "other.py", 3))
    scores = {r.path: r.score for r in linking.seed_scores(issues.where("issue = 1"), files, none, none).collect()}
    assert scores["other.py"] == 3 * 120 + 3 * 15 and scores["src/m.py"] >= 1000


def test_context_and_spans(spark):
    issues = frame(spark, "repo string, issue long, text string", ("r", 1, "parser crash"))
    context = frame(spark, "repo string, id string, text string, time int", ("r", "a", "Parser fix", 1), ("r", "b", "parser crash", 2), ("r", "late", "parser crash", 99))
    assert [r.id for r in linking.context_top(issues, context, F.lit(10), 5).orderBy("rank").collect()] == ["b", "a"]
    ranked = frame(spark, "query int, rank int, file string, name string", (1, 1, "f", "pkg.pkg.A.f"), (1, 2, "f", "A.f"), (1, 3, "f", "gone"), (1, 4, "f", "pkg.A.f"))
    spans = frame(spark, "file string, name string, start_line int, end_line int", ("f", "A.f", 3, 5), ("f", "pkg.A.f", 8, 9))
    got = linking.resolve_spans(ranked, spans).orderBy("rank").collect()
    assert [(r["rank"], r.name, r.start_line) for r in got] == [(1, "pkg.A.f", 8), (2, "A.f", 3)]
    h = linking.hydrate(frame(spark, "k string", ("x",), ("y",)), frame(spark, "k string, line int, n int", ("x", 9, 2), ("x", 7, 1)), ["k"], ["line"], "n")
    assert {r.k: r.line for r in h.collect()} == {"x": 7, "y": None}
    a = frame(spark, "query int, file string, label string, rank int", (1, "f", "A.go(x)", 1))
    b = frame(spark, "query int, file string, label string, rank int", (1, "f", "go", 1), (1, "g", "go", 2), (1, "f", "B.stop", 3), (1, "f", "C", 4))
    assert [r.label for r in linking.fill_by_labels(a, b, 3).orderBy("rank").collect()] == ["A.go(x)", "go", "B.stop"]


def test_code_functions(spark):
    assert code.canonical_signature_of('X = {"b", "a"}') == "X = {'a', 'b'}" and code.canonical_signature_of("X = {1: 2}") == "X = {1: 2}" and code.canonical_signature_of("f(a = {})") == "f(a = {})"
    source = 'def f():\n    """Doc."""\n    return 1  # one\n\n# end\n'
    assert code.stripped_code_of(source) == "def f():\n    return 1" and code.stripped_code_of("def (") == "def ("
    assert code.normal_patch_of(source, source + "# more\n") == "" and "+    return 2" in code.normal_patch_of(source, source.replace("1", "2"))
    answer = "### a/b.py\n<<<<<<< SEARCH\nx = 1\n=======\nx = 2\n>>>>>>> REPLACE\n"
    assert code.edit_blocks(answer) == [("a/b.py", "x = 1", "x = 2")] and code.apply_edits("y\nx = 1\n", [("x = 1", "x = 2")]) == "y\nx = 2\n"
    with pytest.raises(ValueError, match="2 times"):
        code.apply_edits("a a", [("a", "b")])
    df = frame(spark, "s string", ("X = {2, 1}",), (None,))
    assert [r.v for r in df.select(code.canonical_signature("s").alias("v")).collect()] == ["X = {1, 2}", None]
    assert [r.v for r in df.select(code.is_valid_python("s").alias("v")).collect()] == [True, True]
    paths = frame(spark, "d array<struct<src:string,description:string,dst:string>>", ([("root", "refers", "f"), ("f", "has", "m")],))
    assert paths.select(code.render_path(F.col("d")).alias("v")).first().v == "m <-has- f <-refers- root"
