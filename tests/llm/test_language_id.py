import math
import zlib

import numpy as np
import pytest

from rankloom.llm import language_id as lid

from . import cases

SF = "/root/testdata/sf0.01"


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if k == 1 or word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    pieces = sorted(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb"])
    log_prob = np.log(np.random.default_rng(1).uniform(0.01, 0.2, (len(pieces) + 1, 3)))
    model = lid.PieceModel(["x", "y", "z"], pieces, log_prob)
    index = {p: k for k, p in enumerate(pieces)}
    for word in ("▁abab", "▁baca", "▁", "▁aaaabbbab"):
        want = [math.log(sum(math.exp(sum(log_prob[index.get(p, len(pieces)), k] for p in s)) for s in segmentations(word, index))) for k in range(3)]
        assert model.word_scores(model.lattice(), [word, word])[1] == pytest.approx(want)


def test_expectation_maximisation_raises_the_likelihood():
    counts = [("▁abab", 0, 5), ("▁ab", 0, 9), ("▁cd", 1, 4), ("▁cdc", 1, 7), ("▁q", 0, 1)]
    pieces = sorted(["a", "b", "c", "d", "ab", "cd", "▁", "▁a", "abab"])
    last = -math.inf
    for rounds in (1, 2, 4, 8):
        model = lid.expectation_maximisation(["x", "y"], counts, pieces, rounds)
        assert np.exp(model.log_prob).sum(0) == pytest.approx([1, 1])
        total = sum(n * model.word_scores(model.lattice(), [w])[0, k] for w, k, n in counts)
        assert total > last - 0.05
        last = total


def whole_forward(word, pieces, log_prob):
    """Sum over all segmentations of a whole word, place by place."""
    index, alpha = {p: k for k, p in enumerate(pieces)}, [np.zeros(log_prob.shape[1])]
    for end in range(1, len(word) + 1):
        ways = [alpha[s] + log_prob[index.get(word[s:end], len(pieces))] for s in range(end) if end - s == 1 or word[s:end] in index]
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


@pytest.mark.parametrize("word", ["x" * 1000, "abc/de" * 60, "ab" * 30 + "/" * 100 + "ba" * 200, "/" * 300, "é" * 47 + "ab", "ab" * 23 + "a", "ab" * 24])
def test_long_words_sum_all_segmentations(word):
    pieces = sorted(["a", "b", "ab", "ba", "bab", "x", "xx", "xxxx", "▁", "▁a", "c/d", "e"])
    log_prob = np.log(np.random.default_rng(2).uniform(0.01, 0.2, (len(pieces) + 1, 3)))
    model = lid.PieceModel(["x", "y", "z"], pieces, log_prob)
    lattice = model.lattice()
    keys = lid.word_keys(word + " y", lattice)
    parts = [lid.spelled(k) for k in keys]
    assert "".join(parts) == "▁" + word + "▁y"
    assert model.word_scores(lattice, parts[:-1]).sum(0) == pytest.approx(whole_forward("▁" + word, pieces, log_prob))
    assert lid.word_keys("ab c", lattice) == ["ab", "c"]


def test_long_words_teach_as_short_ones_do(monkeypatch):
    pieces = sorted(["a", "b", "ab", "ba", "bab", "▁", "▁a"])
    counts = [("▁" + "ab" * 12, 0, 3), ("▁" + "ba" * 10 + "b", 1, 2), ("▁ab", 0, 1)]
    short = lid.expectation_maximisation(["x", "y"], counts, pieces, 3)
    monkeypatch.setattr(lid, "LONG", 4)
    assert lid.expectation_maximisation(["x", "y"], counts, pieces, 3).log_prob == pytest.approx(short.log_prob)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lid.languages(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    assert np.mean([r.lang_pred == lang[d] for d, r in got.items() if r.held_out]) > 0.95


def test_awkward_tables(spark):
    assert lid.languages(cases.empty(spark)).count() == 0
    docs = cases.documents(spark, clash=True)
    got = {}
    for r in lid.languages(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.lang_pred)
    assert got[1] == got[2] == got[3] == {"und"} and all(len(v) == 1 for v in got.values())
    kept = lid.keep_identified(docs)
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    digits = spark.createDataFrame([(1, "123 45", "en", "a", 1), (2, "abc", None, "a", 1)], cases.SCHEMA)
    assert {r.lang_pred for r in lid.languages(digits).collect()} <= {"und", "en"}
