"""Registered queries take every row of their tables and the whole of every text."""

from rankloom import plans

SF = "/root/testdata/sf0.001"


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, name, sf=SF):
    return plans.queries()[name](spark, sf)


def ids(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_projection_of_every_item_over_whole_documents(spark, tmp_path):
    line = "head " + "filler " * 30 + "beyond"
    docs = [(k, f"w{k} common\n" + "x\n" * 8 + f"late{k} common", f"s{k}", "en") for k in range(30)] + [(30, line, "long", "en")]
    items = [(k, f"Title late{k} here. common") for k in range(30)] + [(30, "Title beyond here. head")]
    sf = tables(spark, tmp_path, documents=(docs, "doc_id long, text string, source string, lang string"), benchmark=(items, "item_id long, text string"))
    got = {(r.query, r.start_line): (r.title_symbol, r.title_source) for r in run(spark, "entity_projection", sf).collect()}
    assert {q for q, _ in got} == set(range(31))
    assert all(got[k, k] == (0, 1) for k in range(30)) and got[30, 30] == (1, 0)
    assert ids(run(spark, "selector_variants", sf), "query") == set(range(31))
    assert len(ids(run(spark, "entity_projection"), "query")) == 40


def test_intervals_of_every_customer(spark):
    from rankloom.plans.structure import spans

    customers = ids(spark.read.parquet(f"{SF}/orders.parquet"), "o_custkey")
    assert ids(run(spark, "innermost_interval"), "o_custkey") == customers
    orders = ids(spans(spark, SF), "o_orderkey")
    assert ids(run(spark, "enclosing_interval"), "o_orderkey") == orders


def test_intervals_of_customers_with_high_keys(spark, tmp_path):
    from datetime import date

    days = [(1, 250, 1, 4), (2, 250, 2, 3), (3, 250, 9, 12), (4, 900, 1, 2), (5, 199, 1, 9), (6, 199, 14, 20)]
    sf = tables(spark, tmp_path, orders=([(k, c, date(1992, 3, s)) for k, c, s, _ in days], "o_orderkey long, o_custkey long, o_orderdate date"), lineitem=([(k, date(1992, 3, e)) for k, _, _, e in days], "l_orderkey long, l_shipdate date"))
    assert {(r.o_orderkey, r.gap) for r in run(spark, "interval_gap", sf).collect()} == {(1, 0), (2, 0), (3, 5), (5, 5), (6, 5)}


def test_least_gap_matches_all_pairs(spark):
    import random

    from rankloom.operators.intervals import least_gap

    rnd = random.Random(4)
    rows = [(g, k, s, s + rnd.randrange(8)) for k in range(150) for g, s in [(rnd.choice("abcd"), rnd.randrange(300))]]
    want = {(g, k): min(max(0, s - f, t - e) for h, j, t, f in rows if h == g and j != k) for g, k, s, e in rows}
    got = least_gap(spark.createDataFrame(rows + rows[:9] + [("alone", 999, 1, 2)], "g string, k long, start int, end int"), "g", "k").collect()
    assert {(r.g, r.k): r.gap for r in got} == want and len(got) == len(want)


def test_fuzzy_best_over_all_parts(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    right = part.where("p_partkey % 2 = 1").select("p_brand").distinct()
    want = part.where("p_partkey % 2 = 0").join(right, "p_brand").select("p_brand", "p_name").distinct()
    assert sorted(run(spark, "fuzzy_best").select("p_brand", "a").collect()) == sorted(want.collect())


def test_diffs_of_all_orders(spark):
    assert ids(run(spark, "diff_lines"), "l_orderkey") == ids(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_orderkey")


def test_signs_of_all_sources(spark):
    sources = ids(spark.read.parquet(f"{SF}/documents.parquet"), "source")
    assert len(sources) > 12 and run(spark, "signflip_exact").first().clusters == len(sources)


def test_dense_queries_grow_with_the_table(spark):
    asked = {k for k in ids(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id") if k % 100 == 0}
    for name in ("dense_top20", "dense_filefirst"):
        assert ids(run(spark, name), "query") == asked


def test_passages_are_contained_as_a_whole(spark):
    from rankloom.operators.audit import contained_passages

    long = "passage " * 12 + "end"
    docs = [(1, "x" + long), (2, long[:-1] + "X"), (3, "the short one"), (None, "😀 short"), (4, None), (5, ""), (3, long + "."), (6, "ab" * 40)]
    items = [(1, long), (2, "short"), (3, ""), (4, None), (5, "😀"), (6, "b" + "ab" * 20), (7, "the short one and more")]
    want = {(d, i) for d, t in docs for i, p in items if t and p and p in t}
    assert {(1, 1), (3, 1), (3, 2), (None, 2), (None, 5), (6, 6)} == want
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (20_000, 1):
        got = contained_passages(*frames, most=most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_whole_texts(spark, tmp_path):
    spaced = "a" + " " * 400 + "b" * 100
    docs = [(1, "x" * 3000), (2, "x" * 2999 + "y"), (3, "pad " * 200 + "lateTerm"), (4, spaced), (5, None)]
    sf = tables(spark, tmp_path, documents=([(k, t, "s", "en") for k, t in docs], "doc_id long, text string, source string, lang string"))
    likeness = {r.doc_id: r.likeness for r in run(spark, "levenshtein_similarity", sf).collect()}
    assert likeness[1] == round(1 - 1 / 3000, 6) and likeness[4] is None
    terms = {r.doc_id: (r.terms, r.exact) for r in run(spark, "identifier_terms", sf).collect()}
    assert terms[3][0].endswith("late term") and "lateterm" in terms[3][1]
    assert {r.doc_id: r.compacted for r in run(spark, "text_budgets", sf).collect()}[4] == 80


def test_edit_distance_matches_the_table():
    import random

    from rankloom.functions.text import edit_distance

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row[0] = row[0], i
            for k, d in enumerate(b, 1):
                before, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, before + (c != d))
        return row[-1]

    rnd = random.Random(8)
    for trial in range(400):
        a, b = ("".join(rnd.choices("abc😀"[: rnd.randrange(1, 5)], k=rnd.randrange(0, 90))) for _ in range(2))
        assert edit_distance(a, b) == table(a, b)
