"""What a query costs must grow no faster than its tables: texts are read once, tasks hold little, rows that only ties could need are not sent."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from rankloom.functions.text import PLAIN, identifier_tokens
from rankloom.operators import audit, inverted_index, projection, retrieval

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_passages_are_found_by_their_anchors():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(60))) for _ in range(200)] + [None, ""]
    passages = sorted({t[a : a + n] for t in texts if t for a in range(3) for n in (1, 3, 8, 9, 12, 30) if t[a : a + n]})
    want = {(i, k) for i, t in enumerate(texts) if t for k, p in enumerate(passages) if p in t}
    known = audit.Passages(passages)
    assert known.found(pa.array(texts)) == want
    assert known.found(pa.array([*texts, "x"]).slice(5, 40)) == {(i - 5, k) for i, k in want if 5 <= i < 45}


def test_texts_do_not_meet_passages_in_a_nested_loop(spark):
    docs, passages = spark.createDataFrame([(1, "one passage here")], "doc_id long, text string"), spark.createDataFrame([(7, "passage"), (8, "passage h"), (9, "none")], "item_id long, text string")
    found = audit.contained_passages(docs, passages)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8)] and "NestedLoop" not in plan(found)


def test_rankings_share_one_count_of_terms(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(5, "b b c")], "query long, text string")
    counted = retrieval.counted_terms(docs, asked)
    assert sorted((r.doc_id, r.length, len(r.terms), sum(r.times)) for r in counted.words.collect()) == [(1, 3, 1, 2), (2, 2, 2, 2), (3, 0, 0, 0)]
    for one in (retrieval.bm25_top, retrieval.overlap_top):
        assert one(docs, asked, 3, counted=counted).collect() == one(docs, asked, 3).collect()


@pytest.mark.parametrize("stretch", [1, 7, 1 << 21])
def test_terms_are_counted_by_bytes_as_by_words(monkeypatch, stretch):
    monkeypatch.setattr(retrieval, "COUNT_CHARACTERS", stretch)
    rnd, (find, forms) = random.Random(3), PLAIN[identifier_tokens]
    long = "abcdefgh%sabcdefgh"  # told by more than its first and last bytes and its length
    for _ in range(60):
        texts = [None if rnd.random() < 0.05 else "".join(rnd.choice("aAbB_19 éK\u212a\u0130ß.k") for _ in range(rnd.choice([0, 1, 5, 40, 200]))) for _ in range(rnd.randrange(12))]
        texts.append(" ".join(long % rnd.choice(["", "x", "y", "xy", "9"]) for _ in range(3)))
        wanted = retrieval.Wanted([(1, t, 1) for t in sorted({t for text in texts for t in find(text or "") if rnd.random() < 0.5} | {long % "x", long % "z"})])
        got, want = retrieval.Identifiers(wanted.terms).counts(pa.array([*texts, "b"]).slice(0, len(texts))), wanted.split_counts(pa.array(texts), find, forms, {})
        assert [p.tolist() for p in got] == [p.tolist() for p in want]
    for terms, texts in (({}, ["a b", None]), ({"a": 0}, []), ({"a": 0}, ["", None])):
        assert len(retrieval.Identifiers(terms).counts(pa.array(texts, pa.string()))[3]) == len(texts)


def test_a_task_holds_no_list_of_words():
    """What it holds of a text is a few times its characters."""
    text = pa.array(["ab c " * 2_000_000])
    tracemalloc.start()
    try:
        row, term, times, lengths = retrieval.Identifiers({"c": 0}).counts(text)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (row.tolist(), term.tolist(), times.tolist(), lengths.tolist()) == ([0], [0], [2_000_000], [4_000_000]) and held < 10 * 10_000_000


@pytest.mark.parametrize("small", [False, True])
def test_postings_are_listed_and_scored_in_tasks(spark, tmp_path, monkeypatch, small):
    """Neither a row for every word of a text nor one for every query and document is shuffled."""
    rnd = random.Random(4)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 90}"
    rows = [(k * 7 - 900, " ".join(word() for _ in range(rnd.randrange(20)))) for k in range(900)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(q, " ".join(word() for _ in range(4))) for q in range(9)], "query long, text string")
    if small:
        monkeypatch.setattr(inverted_index, "GATHERED", 50)
        monkeypatch.setattr(inverted_index, "SCORE_CELLS", 100)
    path = f"file://{tmp_path}/index"
    inverted_index.append(docs, path, buckets=3)
    postings = spark.read.parquet(f"{path}/postings").selectExpr("term", "range", "n", "most", "least", "explode(arrays_zip(doc_id, tf, length)) AS p").select("term", "range", "most", "least", "p.*").collect()
    assert sorted((r.term, r.doc_id, r.tf, r.length) for r in postings) == sorted((t, k, text.split().count(t), len(text.split())) for k, text in rows for t in set(text.split()))
    assert all(r.range == int(r.doc_id / 1024) and r.tf <= r.most and r.length >= r.least for r in postings)
    found = inverted_index.search(spark, path, asked, 5)
    assert "arrays_zip" not in plan(found)
    assert sorted(map(str, found.select("query", "doc_id", "score", "rank").collect())) == sorted(map(str, retrieval.bm25_top(docs, asked, 5).select("query", "doc_id", "score", "rank").collect()))


def test_lines_of_many_files_leave_a_task_together(spark):
    from rankloom.sources import provenance

    hunks = spark.createDataFrame([(f, 1, f"c{f}", 1, 0, 2) for f in range(500)] + [(7, 2, "last", 2, 1, 0)], "file long, position int, commit string, start_line int, old_lines int, new_lines int")
    found = provenance.line_provenance(hunks.coalesce(1))
    sizes = found.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 500 and len(sizes) <= 8
    assert {(r.file, r.start_line, r.end_line, r.commit) for r in found.collect()} == {(f, 1, 1 if f == 7 else 2, f"c{f}") for f in range(500)}


def test_tasks_split_texts_as_columns_do(spark, monkeypatch):
    """Texts go to tasks as they are, not as lists of tokens."""
    from pyspark.sql import functions as F

    from rankloom.functions import text as tx

    rnd = random.Random(6)
    pieces = ["camelCase", "HTTPServer2Go", "aB1C", "queries", "queryies", "Running", "thes", "s", "the", "_x9", "9lives", "İNG", "\u212aing", "ß", "été", "classes", " ", ".", "\n", "", "if", "ands"]
    rows = [(k, "".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randrange(40)))) for k in range(120)] + [(200, None), (201, "")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(pieces)), (2, "queries queries case İng")], "query long, text string")
    monkeypatch.setattr(retrieval, "KNOWN_TOKENS", 7)
    monkeypatch.setattr(retrieval, "COUNT_CHARACTERS", 50)
    for tokens in (tx.identifier_tokens, tx.split_terms):
        find, forms = tx.PLAIN[tokens]
        want = {r.doc_id: r.t for r in docs.select("doc_id", tokens(F.col("text")).alias("t")).collect()}
        assert {k: [f for t in find(text or "") for f in forms(t)] for k, text in rows} == want
        counted = retrieval.counted_terms(docs, asked, tokens)
        number = counted.wanted.terms
        got = {r.doc_id: (r.length, dict(zip(r.terms, r.times, strict=True))) for r in counted.words.collect()}
        assert got == {k: (len(t), {number[w]: t.count(w) for w in set(t) if w in number}) for k, t in want.items()}


def test_terms_are_counted_in_slices(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (3, 0, 9, 2, 2, 1)])], names=["tokens"])
    monkeypatch.setattr(retrieval, "COUNT_TOKENS", 4)
    assert [b.num_rows for b in retrieval._by_tokens(batch)] == [2, 1, 2, 1]


@pytest.mark.parametrize("part", ["rankings", "targets"])
def test_an_evaluation_reads_what_is_written_once(spark, part):
    from rankloom.plans import evaluation

    assert "documents.parquet" not in plan(getattr(evaluation, part)(spark, SF))


def projected(spark, n, files=3):
    """n entities with issues' terms and files; every line stands three times."""
    from pyspark.sql import functions as F

    from rankloom.functions import text as tx

    rnd = random.Random(8)
    words = ["parser", "parsers", "running", "my_name", "pkg.mod", "HTTPServer", "the", "queries", "xy", "retry", "Classes", "node", "İng", "ſs"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows = [(f"f{rnd.randrange(files)}", rnd.choice([text(1), None, "__doc__"]), f"{text(2)} {k}", k // 3 if k % 7 else None, rnd.choice([None, text(rnd.randrange(9))])) for k in range(n)]
    entities = spark.createDataFrame([*rows, (None, "parser", "s", 1, "node")], "file string, name string, signature string, start_line int, source string")
    issues = [(q, text(2), text(6) + ("\nTraceback x\n" + text(3) if q % 2 else "")) for q in range(5)] + [(5, "", "")]
    terms = tx.section_terms(tx.sections(spark.createDataFrame(issues, "query int, title string, body string"), "query", F.col("title"), F.col("body")))
    looked = [(q, f"f{k}", k or None) for q in range(6) for k in range(files) if (q + k) % 4] + [(0, None, 1), (1, "none", 2)]
    return entities, terms, spark.createDataFrame(looked, "query int, file string, best_rank int")


@pytest.mark.parametrize("small", [False, True])
def test_selected_entities_against_all_features(spark, monkeypatch, small):
    from pyspark.sql import functions as F

    if small:
        for name, n in {"PAIR_CELLS": 8, "PAIR_TERMS": 3, "PAIR_ROWS": 5}.items():
            monkeypatch.setattr(projection, name, n)
    entities, terms, files = projected(spark, 150)
    df = projection.projection_features(entities, terms, files).withColumn("key", F.col("start_line")).withColumn("end_line", F.col("start_line"))
    df = df.withColumn("overlap", F.col("title_symbol") + F.col("narrative_symbol")).withColumn("bm25", F.col("title_source") + F.col("narrative_source"))
    every = projection.selector_variants(df)
    # rows of one key are told apart by nothing in the random order
    of = lambda rows: sorted((r.query, r.variant, r["rank"], str(r.key)) for r in rows)
    for k in (1, 4, 200):
        assert of(projection.best_selected(entities, terms, files, k).collect()) == of(every.where(F.col("rank") <= k).collect())
        best = projection.best_projected(entities, terms, files, k, "start_line")
        want = projection.project_entities(projection.projection_features(entities, terms, files), "start_line").where(F.col("rank") <= k)
        assert sorted(map(str, best.collect())) == sorted(map(str, want.select(*best.columns).collect()))


@pytest.mark.parametrize("step", ["best_selected", "best_projected"])
def test_projections_send_the_best_of_tasks(spark, monkeypatch, step):
    """Rows that leave tasks do not grow with the entities of a file."""
    sent, named = [], getattr(projection, "_named", None)
    monkeypatch.setattr(projection, "_named", lambda found, *more: sent.append(found.count()) or named(found, *more))
    entities, terms, files = projected(spark, 2000, 1)
    getattr(projection, step)(entities, terms, files, 2, *(["start_line"] if step == "best_projected" else []))
    assert sent and sent[0] <= 4 * 6 * 2 * 5


@pytest.mark.parametrize("few", [0, 3, 64])
def test_most_similar_paths_against_all_pairs(spark, monkeypatch, few):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from rankloom.operators import joins

    rnd = random.Random(5)
    number = lambda: str(rnd.randrange(60)) + rnd.choice(["", "", ".html", "/"])
    word = lambda n: "".join(rnd.choice("abc") for _ in range(rnd.randrange(n)))
    paths = {f"en/{number()}" for _ in range(60)} | {f"{word(3)}/{word(30)}" for _ in range(40)} | {"/".join(word(4) for _ in range(rnd.randrange(1, 7))) for _ in range(40)} | {"", "/", "x", "a/a/", "en//"}
    rows = [(g, p) for g in (1, 2) for p in paths if g == 1 or rnd.random() < 0.2] + [(None, "x"), (1, None)]
    files = spark.createDataFrame(rows, "g int, path string")
    wanted = spark.createDataFrame([*rows, (1, "en/1234"), (2, "en/q/"), (1, "none/of/these/at/all/"), (3, "x")], "g int, wanted string")
    monkeypatch.setattr(joins, "FEW_FILES", few)
    every = wanted.distinct().where("wanted IS NOT NULL").join(files.where("path IS NOT NULL"), "g").withColumn("likeness", F.round(joins.path_similarity(F.col("wanted"), F.col("path")), 6))
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("g", "wanted").orderBy(F.col("likeness").desc(), "path")))
    for k in (1, 2, 4):
        assert sorted(map(tuple, joins.fuzzy_paths(wanted, files, "g", k).collect())) == sorted(map(tuple, every.where(F.col("rank") <= k).collect()))


def test_most_similar_paths_broadcast_nothing(spark, monkeypatch):
    """Tables grow with the input, and what is exploded from them is far larger than their files: none of it may go through the driver."""
    from rankloom.operators import joins

    monkeypatch.setattr(joins, "FEW_FILES", 3)
    plans, write = [], joins.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "materialise", lambda df, name: plans.append(plan(df)) or write(df, name))
    paths = [(1, f"en/{k}{end}") for k in range(20) for end in ("", ".html", "/")] + [(1, "a/b/c/d/e/f"), (1, "x")]
    files = spark.createDataFrame(paths, "g int, path string")
    best = joins.fuzzy_paths(files.withColumnRenamed("path", "wanted"), files, "g", 2)
    assert best.count() == 2 * len(paths)
    plans.append(plan(best))
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p or "CartesianProduct" in p]
