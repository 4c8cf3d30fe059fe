import pytest
from pyspark.sql import functions as F

from rankloom.functions import identity as ident
from rankloom.functions import predicates as pred
from rankloom.functions import text as tx


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)

    def value(column):
        return row.select(column.alias("v")).first().v

    return value


def lit(x):
    return F.lit(x)


def test_identifiers_and_terms(one):
    assert one(tx.identifier_tokens(lit("Foo_1 bar.Baz 9x"))) == ["foo_1", "bar", "baz", "x"]
    assert one(tx.split_terms(lit("parsingQueries in HTTPServer classes"))) == ["parsing", "pars", "queries", "query", "querie", "httpserver", "classes", "classe"]
    assert one(tx.evidence_terms(lit("parsingQueries with classes"))) == ["parsing", "queries", "classes"]
    assert "parser" in one(tx.java_terms(lit("theParser")))
    assert one(tx.split_terms(F.lit(None).cast("string"))) == []


def test_exact_and_anchor_terms(one):
    assert sorted(one(tx.exact_terms(lit("pkg.mod.Thing and some_name")))) == ["mod", "name", "pkg", "pkg.mod.thing", "some_name", "thing"]
    assert sorted(one(tx.code_like_terms(lit("plain words a.bcd snake_case camelCase v12")))) == ["a.bcd", "bcd", "camelcase", "case", "snake", "snake_case", "v12"]
    assert sorted(one(tx.anchor_terms(lit("see `mod.func` and my_var or camelCase plain")))) == ["camelcase", "func", "mod", "mod.func", "my_var"]
    assert sorted(one(tx.candidate_terms(lit("A.bcd"), lit("efg")))) == ["a.bcd", "bcd", "efg"]


def test_sections_carry_a_traceback(spark):
    body = 'Fails with my_func\n  File "x.py", line 3\nstill prose `code.span`\nTraceback (most recent call last):\nfoo bar\nValueError: no'
    rows = spark.createDataFrame([(1, "Title word", body), (2, None, None)], "id int, title string, body string")
    got = {r.id: r for r in tx.sections(rows, "id", F.col("title"), F.col("body")).collect()}
    assert got[1].narrative == "Fails with my_func\nstill prose `code.span`" and got[1].diagnostic.split("\n") == ['  File "x.py", line 3', "Traceback (most recent call last):", "foo bar", "ValueError: no"]
    assert got[1].code_spans == "code.span" and got[2].title == "" and got[2].narrative == ""
    terms = tx.section_terms(tx.sections(rows, "id", F.col("title"), F.col("body"))).where("id = 1").first()
    assert {"code.span", "span", "my_func", "title"} <= set(terms.exact_terms) and "valueerror" in terms.diagnostic_terms


def test_text_clean_up(one):
    assert one(tx.clean_issue(lit("a<!-- x\ny -->b\n\n\n\nc"))) == "a\nb\n\nc"
    assert one(tx.redact_reference(lit("see #12, issue 12 and #123"), lit(12))) == "see [target fixing reference removed], [target fixing reference removed] and #123"
    assert one(tx.redact_reference(lit("https://github.com/a/b/pull/12#x, fixes 12, a/#12, PR 12."), lit("12"))) == "[target fixing reference removed] fixes 12, a/#12, [target fixing reference removed]."
    assert one(tx.reference_ids(lit("Fixes #3, closes 9, https://github.com/a/b/pull/44 https://github.com/c/d/pull/45 and x#5 or #6, #7-x"), lit("a/b"))) == [3, 6, 44]
    assert one(tx.reference_ids(lit("https://code.djangoproject.com/ticket/77"), lit("a/b"))) == [] and one(tx.reference_ids(lit("https://code.djangoproject.com/ticket/77"), lit("django/django"))) == [77]
    assert one(tx.file_mentions(lit("in a/b.py and c.rst, D.java"))) == ["a/b.py", "D.java"]
    assert one(tx.code_blocks(lit("x\n```py\na\nb\n```\ny"))) == ["a\nb\n"]
    assert one(tx.diff_of_answer(lit("<patch>\nabc</patch>"))) == "abc" and one(tx.json_of_answer(lit('t ```json\n{"a":1}\n```'))) == '{"a":1}'


def test_budgets_and_measures(one):
    assert one(tx.token_proxy(lit("abcde"))) == 2 and one(tx.token_proxy(lit("abcde"), 1.3)) == 3
    cut = one(tx.truncate_keep_ends(lit("a" * 50 + "b" * 50), 25))
    assert len(cut) == 25 and cut.startswith("aaa") and cut.endswith("bbb") and "..." in cut
    assert one(tx.truncate_to_tokens(lit("abcdefghij"), 2)) == "abcdefgh"
    assert one(tx.compact(lit(" a \n b "))) == "a b" and len(one(tx.compact(lit("ab " * 100), 20))) <= 20
    assert one(tx.seconds_of(lit("1:02:03.5"))) == 3723.5
    assert one(tx.levenshtein_similarity(lit("abcd"), lit("abxd"))) == 0.75 and one(tx.levenshtein_similarity(lit(""), lit(""))) == 1.0
    assert one(tx.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) == 0.0
    assert one(tx.context_score(tx.context_tokens(lit("Parse version 1.2.3")), lit("it parses 1.2.3"))) == 2


def test_paths_and_symbols(one):
    for value, want in (("a/./x/y.py", "./x/y.py"), ("./././m.py", "m.py"), ("x\\y.py", "x/y.py"), (".github/a", ".github/a"), (None, "")):
        got = one(ident.repository_path(F.lit(value).cast("string")))
        assert got == (want if value != "a/./x/y.py" else "x/y.py")
    assert one(ident.seed_path(lit(".github/a"))) == "github/a"
    assert one(ident.symbol_base(lit("A.f(x, y)"))) == "A.f" and one(ident.symbol_base(lit("X = 3 (y)"))) == "X"
    assert one(ident.entity_kind(lit("class"), lit("A"), lit(""))) == "class" and one(ident.entity_kind(lit(""), lit("x = 1"), lit("x = 1"))) == "assignment" and one(ident.entity_kind(lit(""), lit("f(a = 1)"), lit("  def f(a = 1)"))) == "function"
    assert one(ident.candidate_kind(lit("x = 1"), lit(""))) == "assignment"
    assert one(ident.canonical_key(lit("a/m.py"), lit("function"), lit("A.f(x)"))) == "m.py|function|A.f" and one(ident.canonical_key(lit(""), lit("function"), lit("f"))) is None
    assert one(ident.local_symbol(lit("pkg.mod.A.f(x)"), lit("src/pkg/mod.py"))) == "A.f" and one(ident.local_symbol(lit("A.f"), lit("src/pkg/mod.py"))) == "A.f" and one(ident.local_symbol(lit("mod.g"), lit("x.txt"))) == "mod.g"
    assert one(ident.is_boilerplate(lit("A.__init__"))) is False and one(ident.is_boilerplate(lit("A.__repr__"))) is True and one(ident.is_boilerplate_evidence(lit("A.__init__"), lit("a.py"))) is True
    assert one(ident.repository_of(lit("org__repo-123"))) == "org__repo"
    assert one(ident.relative_path(lit("root/a.py"), lit("root"))) == "a.py"
    with pytest.raises(Exception, match="leaves"):
        one(ident.relative_path(lit("../a.py"), lit("root")))


def test_predicates(one):
    assert one(pred.is_test_name(lit("TestFoo"))) and not one(pred.is_test_name(lit("pytest_x")))
    assert one(pred.skips_production(lit("a/tests/b.py"))) and not one(pred.skips_production(lit("a/contest/b.py")))
    assert one(pred.is_java_candidate(lit("src/A.java"))) and not one(pred.is_java_candidate(lit("build/A.java")))
    assert one(pred.is_code_reference(lit("pkg.func"))) and one(pred.is_code_reference(lit("my_func"))) and not one(pred.is_code_reference(lit("word"))) and not one(pred.is_code_reference(lit("me@x.org")))
    assert one(pred.is_maintenance(lit("Bump version\n\nfix"))) and one(pred.is_repair(lit("x\nFixes bug"))) and not one(pred.is_repair(lit("a\nb\nc\nfix")))
    none, errors = F.lit(None).cast("array<string>"), lambda *e: F.array(*map(lit, e))
    assert one(pred.is_no_op(errors("x", "No changes were made"), lit(""), lit(0), lit(0))) and not one(pred.is_no_op(errors("No changes were made"), lit(""), lit(1), lit(0)))
    assert one(pred.is_no_op(none, lit("<<<<<<< SEARCH\na"), lit(0), lit(0))) and not one(pred.is_no_op(none, lit("<<<<<<< SEARCH\na"), lit(0), lit(1)))
    assert one(pred.needs_context(none, lit("I need more context here"))) and one(pred.needs_context(errors("No edit commands found"), F.lit(None).cast("string"))) and not one(pred.needs_context(none, lit("fine")))
    assert one(pred.is_refusal(none, lit("We Need access to x"))) and not one(pred.is_refusal(none, lit("I cannot help with that")))
    for name, want in (("np.array_x", True), ("np.zeros", False), ("np.Matrix", True), ("np.Array", False), ("pkg.write", False), ("Pkg.write", True), ("Pkg.append", False), ("tests.a_b", False), ("a/testFoo.py", False), ("contest.func", True), ("x.rst", False), ("utils.py", False), ("a/utils.py", True), ("URL", True), ("ABCDEFGHIJKLM", False), ("CamelCase", True), ("Word", False), ("__init__", False), ("assert_x", False), ("`my_func`", True), ("x.org", False), ("a.b", False), ("", False), (None, False)):
        assert one(pred.is_code_reference(F.lit(name).cast("string"))) is want, name
    for path, want in (("a/LICENSE.txt", True), ("license", True), ("a/security/x.md", True), ("security/x.md", False), ("a/.github/ISSUE_TEMPLATE/x.md", True), ("authors.md", False), ("a\\contributing\\b", True)):
        assert one(pred.is_boilerplate_doc(lit(path))) is want, path
    assert one(pred.skips_production(lit("a/__tests__/b"))) and not one(pred.skips_production(lit("vendor/b.py")))
    assert one(pred.is_maintenance(lit("\n Apply RUF100"))) and one(pred.is_maintenance(lit("release notes"))) and not one(pred.is_maintenance(lit("merge branch\nblack")))
    assert one(pred.is_repair(lit("a\nb\nraises an Exception"))) and not one(pred.is_repair(lit("closes it")))
    assert one(pred.target_stratum(lit(1), lit(0))) == "entity_only" and one(pred.hit_stratum(lit(1), lit(0))) == "only_a"
    assert one(pred.directional_alignment(lit("only_b"), lit("b"))) is True and one(pred.directional_alignment(lit("both"), lit("b"))) is None
    assert one(pred.is_infrastructure_failure(F.array(lit("x"), lit("Connection Error: y")))) and one(pred.has_test_word(lit("foo_test.py")))


def test_cutoff_truth_table(spark):
    rows = spark.createDataFrame([(1, 100, 900), (2, 100, 1100), (3, 1100, 1100), (4, 100, None), (5, None, 900)], "id int, created int, updated int")
    strict = pred.visible_at(F.col("created"), F.col("updated"), F.lit(1000))
    loose = pred.visible_at(F.col("created"), F.col("updated"), F.lit(1000), strict=False)
    got = {r.id: (r.s, r.l) for r in rows.select("id", strict.alias("s"), loose.alias("l")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, True), 5: (False, False)}
    assert spark.range(1).select(pred.epoch(F.lit("nonsense"), F.lit("1970-01-01T00:01:00Z")).alias("e")).first().e == 60.0


def test_whole_texts_are_compared_without_python(spark):
    """The distance of whole texts costs too much in Python at size; strips of 16,384 rows and characters of two code units count."""
    import random

    rnd = random.Random(4)
    word = lambda n, of="abcd": "".join(rnd.choices(of, k=n))
    lengths = [0, 1, 63, 64, 65, 128, 300]
    pairs = [(word(n, of), word(m, of)) for n in lengths for m in lengths for of in ("a", "abc", "ab😀é")]
    pairs += [("same " + word(50) + " end", "same " + word(70) + " end"), (word(17_000), word(900, "abcdé😀")), (word(16_384), word(16_384)), (None, "x"), ("x", None)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.levenshtein_similarity(F.col("a"), F.col("b")).alias("likeness"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = None if r.a is None or r.b is None else 1.0 if not r.a and not r.b else 1 - tx.edit_distance(r.a, r.b) / max(len(r.a), len(r.b))
        assert r.likeness == want
