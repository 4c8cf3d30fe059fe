import random
import re
import zlib
from collections import Counter

from rankloom.llm import queries, spelling
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, all_pairs=True):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}
    return brute_groups(words)


def brute_groups(words):
    form, rows = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        rows[w] = [form[w], n, len(others), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows[w].append(root)
    return {(w, f, root, n, k, fn) for w, (f, n, k, fn, root) in rows.items()}


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    got = rows(queries.queries()["op11_spelling_variants"](spark, SF))
    assert len(got) > 100 and got == sorted(want, key=str)
    assert any(r[1] is not None for r in got)


def test_random_words_of_a_small_alphabet(spark):
    rnd = random.Random(5)
    words = {}
    for _ in range(700):
        words["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7)))] = rnd.choice([5, 6, 25, 26, 130, 700, 4000])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    linked = spelling.forms(df).cache()
    got = linked.join(spelling.roots(linked), "word")
    assert rows(got) == sorted(brute_groups(words), key=str)


def test_long_chains_end_at_their_last_word(spark):
    chain = [("a" * k, 5 ** (20 - k)) for k in range(1, 18)]
    linked = spelling.forms(spark.createDataFrame(chain, "word string, n long"))
    assert {r.root for r in spelling.roots(linked).collect()} == {"a"}


def test_damage_deletes_one_code_point():
    hit = next(k for k in range(10**6) if zlib.crc32(f"{k}:straße".encode()) % 199 == 0)
    assert len(spelling.damaged(hit, "straße")) == 5 and spelling.damaged(hit + 1, "straße") in ("straße",)
    assert spelling.lowered("ÀBCé") == "Àbcé" and spelling.lowered("ABC") == "abc"


def test_awkward_tables(spark):
    docs = [(None, "Wördlich " * 5), (1, None), (2, ""), (3, "12 ?"), (4, "wördlicx " * 40 + "x" * 100000), (4, "wördlicx " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS key")
    got = rows(spelling.variants(df))
    assert got == sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=str) and len(got) == 2
    awkward = cases.documents(spark, True)
    assert rows(spelling.variants(awkward)) == sorted(brute([(r.doc_id, r.text) for r in awkward.collect()]), key=str)
    assert rows(spelling.variants(cases.empty(spark))) == []
