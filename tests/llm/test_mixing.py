import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from rankloom.llm import mixing

from . import cases

SF = "/root/testdata/sf0.01"


def targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
    return {r.source: r.target for r in rows}


def test_targets_share_and_stop(spark):
    got = targets(spark, [("b", 100), (None, 10), ("a", 1000), ("c", 50)])
    # code-point order a, b, c, null weighs 1, 2, 3, 1 and shares 1160: b, c and null stop at three times their size
    assert got == {"a": 1160 - 300 - 150 - 30, "b": 300, "c": 150, None: 30}
    assert targets(spark, []) == {} and targets(spark, [("a", 0)]) == {"a": 0}
    even = targets(spark, [("a", 600), ("b", 600), ("c", 600)])
    assert even == pytest.approx({"a": 300, "b": 600, "c": 900})


def check(rows):
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    largest = defaultdict(int)
    for source, r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
        size[source] += r.size
        largest[source] = max(largest[source], r.size)
        target[source] = r.target
    for s in taken:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1, s


def test_whole_table_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(source) and all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) for r in rows)
    check([(source[r.doc_id], r) for r in rows])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    chance = {r.doc_id: r.taken / r.size for r in rows if r.size}
    assert len(set(chance.values())) > 2


def brute_mix(rows):
    """taken by (doc_id, text), rank by rank, from the docstring's rules; ``rows`` are (doc_id, source, text)."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    total, order = defaultdict(int), sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        total[r[1]] += size[r]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, open_ = {}, sum(total.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 3 * total[s]}
        target |= {s: 3 * total[s] for s in full} if full else {s: weight[s] * share for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = {}
    for s in order:
        mine = [r for r in rows if r[1] == s]
        certain = min(int(target[s] // total[s]), 3) if total[s] else 0
        wanted = target[s] - certain * total[s]
        chance, level = {}, {r: 2 ** (size[r].bit_length() - 1) if size[r] else 0 for r in mine}
        rest, open_rows = wanted, [r for r in mine if level[r]]
        while open_rows:
            top = max(level[r] for r in open_rows)
            mass = sum(level[r] * size[r] for r in open_rows)
            if wanted <= 0 or rest * top < mass:
                chance |= {r: max(rest, 0) * level[r] / mass for r in open_rows}
                break
            chance |= {r: 1.0 for r in open_rows if level[r] == top}
            rest -= sum(size[r] for r in open_rows if level[r] == top)
            open_rows = [r for r in open_rows if level[r] < top]
        place = {}
        for r in mine:
            if chance.get(r, 0) > 0:
                digest = hashlib.md5("|".join([str(r[0] if r[0] is not None else ""), r[1] or "", hashlib.md5((r[2] or "").encode()).hexdigest()]).encode()).hexdigest()
                u, c = (int(digest[:13], 16) + 0.5) / 2**52, chance[r]
                place[r] = math.floor(u * (1 - c) / (u * (1 - c) + (1 - u) * c) * 2**52)
        got, extra = 0, set()
        for p in sorted(set(place.values())):
            group = [r for r in place if place[r] == p]
            if got + sum(size[r] for r in group) > wanted:
                break
            got += sum(size[r] for r in group)
            extra |= set(group)
        gap = wanted - got
        near = [(abs(size[r] - gap), place[r]) for r in place if r not in extra and abs(size[r] - gap) < gap]
        if near:
            extra |= {r for r in place if place[r] == min(near)[1]}
        taken |= {r: (certain + (r in extra)) * size[r] for r in mine}
    return taken


@pytest.mark.parametrize("edge", [100_000, 2])
def test_against_brute_force(spark, monkeypatch, edge):
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    rnd = random.Random(4)
    rows = [(k if rnd.random() < 0.95 else None, rnd.choice(["a", "b", "b", "b", "é", None, "c"]), rnd.choice([None, "", "x"]) if rnd.random() < 0.1 else cases.words(k, int(rnd.paretovariate(0.8) * 3) % 900 + 1)) for k in range(400)]
    rows += [(1000, "tiny", cases.words(1, 700)), (1001, "tiny", "w"), (1002, "zero", None)]
    want = brute_mix(list(dict.fromkeys(rows)))
    df = spark.createDataFrame([(i, t, None, s, 0) for i, s, t in dict.fromkeys(rows)], cases.SCHEMA)
    got = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df).collect())
    assert got == sorted((str(r[0]), len((r[2] or "").split()), n) for r, n in want.items())


def test_chances_grow_with_size_and_peel(spark):
    df = spark.createDataFrame([(k, "w " * n, None, "s", 0) for k, n in enumerate([1000, 10, 10, 10, 3, 3])] + [(99, "w " * 2000, None, "t", 0)], cases.SCHEMA)
    rows = {(r.source, r["class"]): r for r in mixing.chances(mixing.sized(df)).collect()}
    assert rows["s", 2].chance < rows["s", 8].chance < rows["s", 512].chance <= 1
    s = [r for r in rows.values() if r.source == "s"]
    words = {512: 1000, 8: 30, 2: 6}
    assert sum(r.chance * words[r["class"]] for r in s) == pytest.approx(s[0].wanted)


def test_mixed_documents_repeat_as_planned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.taken}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == want


def test_awkward_tables(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.mixed_documents(cases.empty(spark)).count() == 0
    docs = cases.documents(spark, clash=True)
    assert mixing.mix(docs).count() == 13
    assert mixing.mixed_documents(docs).columns == docs.columns
    zero = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], cases.SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(zero).collect()] == [(0, 0.0, 0)] * 2


def test_plan_has_no_python(spark, capsys):
    mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)
