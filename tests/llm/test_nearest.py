import math
import random

import numpy as np

from rankloom.llm import nearest as ann

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, modulus):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % modulus == 0:
            scored = [(-float((q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for j, v in rows if j != i and len(v) == len(q)]
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_on_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 5, 50)
    got = found(ann.nearest(df))
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.95


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.float32(v)], 0) for k, v in enumerate(rng.standard_normal((600, 16)))]
    want = brute([r[:2] for r in rows], 5, 50)
    got = found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_ties_and_awkward_vectors(spark):
    rnd = random.Random(1)
    same = [1.0, 2.0, -1.0]
    rows = [(k, same, 0) for k in range(40)] + [(50, same, 0), (100, None, 0), (150, [], 0), (200, [0.0, 0.0, 0.0], 0), (250, [1.0, None, 2.0], 0), (300, [1.0, float("nan"), 0.0], 0), (350, [float("inf"), 0.0, 0.0], 0), (None, same, 0), (400, [1.0, 2.0], 0), (-50, [3.0, 1.0], 0), (450, [1e-30, 2e-30, -1e-30], 0)]
    rnd.shuffle(rows)
    got = found(ann.nearest(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS rank", "3 AS block")))
    assert got[50][:4] == [0, 1, 2, 3] and got[0][:4] == [1, 2, 3, 4]
    assert got[400] == [-50] and got[-50] == [400] and set(got) == {0, 50, 400, -50, 450}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_queries_and_versions(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.float32(v)], 0) for k, v in enumerate(rng.standard_normal((120, 8)))]
    want = brute([r[:2] for r in rows], 5, 50)
    assert found(ann.nearest(spark.createDataFrame(rows + [rows[50], rows[50]], SCHEMA)))[50] == want[50]
    other = (50, [float(x) for x in np.float32(rng.standard_normal(8))], 0)  # another vector of the same query
    apart = {r[0]: (max(-s for s in (_score(rows[50][1], r[1]), _score(other[1], r[1])))) for r in rows if r[0] != 50}
    assert found(ann.nearest(spark.createDataFrame([*rows, other], SCHEMA)))[50] == sorted(apart, key=lambda i: (-apart[i], i))[:5]


def _score(a, b):
    a, b = np.array(a), np.array(b)
    return -float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
