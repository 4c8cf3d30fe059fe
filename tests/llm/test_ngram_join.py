import random

import numpy as np
import pytest

from rankloom.llm import ngram_join as nj
from rankloom.llm.components import components

from . import cases


def brute(rows):
    sets = {}
    for k, (i, text) in enumerate(rows):
        t = (text or "").translate({c: c + 32 for c in range(65, 91)})
        ws = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        sets[k] = {tuple(ws[a : a + 4]) for a in range(len(ws) - 3)} if len(ws) >= 4 else ({tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    name = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None:
            name[r] = min(name.get(r, i), i)
    return sorted((i if i is not None else 10**9, len(sets[k]), name.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], cases.SCHEMA)
    return sorted((r.doc_id if r.doc_id is not None else 10**9, r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect())


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


def near_copies(seed):
    rnd = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(40)]
    base = [f"b{k}" for k in range(150)]
    for _ in range(180):  # one dense family, with copies on either side of the threshold
        rows.append(" ".join(edited(rnd, base, rnd.randrange(0, 7))))
    for _ in range(90):  # mostly a common passage
        rows.append(" ".join(passage + [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 12))]))
    for _ in range(60):
        own = [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.randrange(1, 4)):
            rows.append(" ".join(edited(rnd, own, rnd.randrange(0, 3))).upper())
    rows += ["", None, "a", "A", "a b", "a  b\t", "a b c d", "a b c d e", " \n"]
    rnd.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_CLASSES", 32)
    rows = near_copies(seed)
    assert run(spark, rows) == brute(rows)


def test_prefixes_of_linked_sets_share_an_entry():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = int(rng.integers(2, 200))
        weight_of = {}
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, 1 + len(a) // 6))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        share = rng.random()
        for t in np.union1d(a, b):
            weight_of[int(t)] = int(rng.integers(65, 900)) if rng.random() < share else int(rng.integers(1, 64))
        entries = [set(nj.prefix_entries(s, np.array([weight_of[int(t)] for t in s]), 64.0).tolist()) for s in (a, b)]
        if nj.linked(common, len(a), len(b)) and not np.array_equal(a, b):
            assert entries[0] & entries[1]


def test_bitmap_bounds_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 500, 300).astype(np.uint64)) for _ in range(2))
        apart = int(np.bitwise_count((nj.parity_bitmap(a) ^ nj.parity_bitmap(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_link_matrix_is_exact():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < p], rng.integers(0, 2**60, 3).astype(np.uint64)])) for p in rng.uniform(0.7, 1, 40)] + [np.empty(0, np.uint64)]
    got = nj.link_matrix(sets[:25], sets[25:])
    want = [[nj.linked(len(np.intersect1d(a, b)), len(a), len(b)) for b in sets[25:]] for a in sets[:25]]
    assert (got == np.array(want)).all()


def test_connected_components_of_long_chains(spark):
    rnd = random.Random(2)
    order = list(range(300))
    rnd.shuffle(order)
    links = [(a, b) for a, b in zip(order[:200], order[1:200])] + [(order[k], order[200]) for k in range(201, 250)] + [(order[260], order[261]), (order[261], order[260]), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = [order[:200], order[200:250], order[260:262]]
    assert got == {n: min(g) for g in groups for n in g}


def test_awkward_tables(spark):
    assert nj.jaccard_components(cases.empty(spark)).count() == 0
    docs = cases.documents(spark, clash=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows) == brute(rows)
    one = nj.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [-50, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_documents_without_id_and_ids_with_two_texts(spark):
    rnd = random.Random(9)
    own = [[f"t{k}_{j}" for j in range(120)] for k in range(6)]
    near = lambda k: " ".join(edited(rnd, own[k], 1))
    plain = lambda k: " ".join(own[k])
    rows = [(7, plain(0)), (None, near(0)), (None, near(1)), (None, near(1)), (None, plain(2)), (None, plain(2)), (5, plain(3)), (5, plain(4)), (9, near(3)), (3, near(4)), (None, ""), (None, None), (4, ""), (4, " "), (6, plain(5)), (6, plain(5))]
    named = rows[:2] + rows[6:10] + rows[12:]
    assert run(spark, named) == brute(named)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], cases.SCHEMA)
    for digest in (None, "digest"):
        docs = df.withColumn(digest, df["n_chars"]) if digest else df
        one = nj.one_of_each(docs)
        assert one.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
        ones = [r for r in got if r not in [(None, rows[2][1]), (None, rows[3][1])]]
        assert len(got) == len(ones) + 1  # one of the two near copies without id
        want = [(7, plain(0)), (None, plain(2)), (5, plain(3)), (3, rows[9][1]), (None, ""), (None, None), (4, ""), (4, " "), (6, plain(5))]
        assert ones == sorted(want, key=str)


def test_dense_family_without_ids(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_CLASSES", 32)
    rows = [(None, t) for _, t in near_copies(3)]
    expected = brute([(k, t) for k, (_, t) in enumerate(rows)])
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], cases.SCHEMA)
    wordless = {t for _, t in rows if not (t or "").strip()}
    assert nj.one_of_each(df).count() == len({c for _, n, c in expected if n}) + len(wordless)
