import hashlib
import random

import numpy as np
import pytest

from rankloom.llm import deep_shallow, queries, repeated_spans
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def brute(docs, length=50):
    least = {}
    for doc_id, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - length + 1 if doc_id is not None else 0):
            s = b[i : i + length]
            least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if doc_id is not None else 0):
            if least[b[i : i + length]] < doc_id:
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


#: Many blocks, ranges and buckets, and frequent k-grams, on little data.
SMALL = repeated_spans.Sizes(block_bytes=4000, piece=300, range_bytes=3000, bucket_grams=50, hot=12)


def passages(seed):
    rnd = random.Random(seed)
    text = lambda n, alphabet="abcdefghij ": "".join(rnd.choice(alphabet) for _ in range(n))
    common, long_ = text(120), text(400)
    docs = []
    for k in range(60):
        parts = [text(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(0, 4)):
            parts.append(rnd.choice([common, common[rnd.randrange(60) :], common[: rnd.randrange(40, 120)], long_[rnd.randrange(200) :], "é" * rnd.randrange(20, 60), "a" * rnd.randrange(30, 120), text(60, "ab")]))
            parts.append(text(rnd.randrange(0, 80)))
        docs.append((k, "".join(parts)))
    for k in range(60, 90):  # exact and near copies
        t = docs[rnd.randrange(60)][1]
        docs.append((k, t if k % 2 else t[: len(t) // 2] + "#" + t[len(t) // 2 :]))
    docs += [(None, docs[3][1]), (3, docs[4][1]), (3, docs[3][1]), (100, None), (101, ""), (102, common[:49]), (103, common[:50]), (-7, common), (104, "\x00" * 70), (105, "\x00" * 52)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_over_many_blocks(spark, seed):
    docs = passages(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(repeated_spans.removals(df, sizes=SMALL)) == brute(docs)


def test_one_block_and_other_lengths(spark):
    docs = passages(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert rows(repeated_spans.removals(df)) == brute(docs)
    assert rows(repeated_spans.removals(df, 31)) == brute(docs, 31)
    assert rows(repeated_spans.removals(df, 90)) == brute(docs, 90)


def test_query_against_plain_python(spark):
    docs = pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    got = rows(queries.queries()["op13_repeated_spans"](spark, SF))
    assert got == brute(docs) and sum(r[2] for r in got) > 0


def test_spans_and_texts(spark):
    a, b = "x" * 10 + "The quick brown fox jumps over the lazy dog, and then some.", "yy"
    df = spark.createDataFrame([(1, a), (2, b + a + b + a[:55]), (3, a), (4, a)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, [tuple(s) for s in r.spans]) for r in repeated_spans.repeated_spans(df).collect()}
    assert got[1] == (a.encode(), []) and got[2] == (b"yyyy", [(2, 2 + len(a)), (4 + len(a), 59 + len(a))])
    assert got[3] == (b"", [(0, len(a))]) and got[4] == got[3]  # runs of neighbours do not merge


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_tables(spark, clash):
    df = cases.documents(spark, clash)
    assert rows(repeated_spans.removals(df)) == brute(pairs(df))
    assert rows(repeated_spans.removals(cases.empty(spark))) == []


def test_text_ids(spark):
    docs = [(f"d{k}" if k is not None else None, t) for k, t in passages(4)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(2)
    assert rows(repeated_spans.removals(df, sizes=SMALL)) == brute(docs)


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_order(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(0, 400))
    sorted_rows = rnd.integers(0, 2, (n, 40)).astype(np.uint8)
    sorted_rows[:, : int(rnd.integers(0, 39))] = 7  # long common prefixes
    if n > 10:
        sorted_rows[n // 2 :] = sorted_rows[rnd.integers(0, n // 2, n - n // 2)]  # repeats
    order = deep_shallow.sort(sorted_rows)
    assert sorted(order.tolist()) == list(range(n))
    got = [sorted_rows[k].tobytes() for k in order]
    assert got == sorted(got)
    shared = deep_shallow.common_prefixes(sorted_rows, order)
    for k in range(1, n):
        want = next((i for i, (x, y) in enumerate(zip(got[k - 1], got[k])) if x != y), 40)
        assert shared[k] == want


def test_trie_walks_in_order():
    strings = [b"banana00", b"bandana0", b"bananas0", b"banana00", b"\xff\x00\x01\x02abcd", b"ban\x00\x00\x00\x00\x00"]
    trie = deep_shallow.BlindTrie(strings)
    assert [strings[k] for k in trie.ordered()] == sorted(strings)
