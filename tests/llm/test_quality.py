import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from rankloom.llm import quality_classifier, quality_rules
from rankloom.llm.textcore import Words, mix64

from . import cases

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    ws = WORD.findall(text or "")
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    covered = set()
    for k, w in enumerate(zip(ws, ws[1:], ws[2:])):
        if windows[w] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(ws), sum(map(len, ws)), symbols, dup, len(covered)


def test_base_measures_match_brute_force(spark):
    docs = cases.documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    got = sorted((r for r in quality_rules.quality_rules(docs, labels).collect()), key=lambda r: (str(r.doc_id), r.n_words))
    assert len(got) == len(texts)
    want = sorted(((i, *brute(t)) for i, t in texts), key=lambda r: (str(r[0]), r[1]))
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)


def test_ratio_matches_brute_force(spark):
    rows = [(k, cases.words(k % 7, 60, 40), None, None, None) for k in range(20)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0, 0) for k in range(10)] + [(3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    bits = 10

    def buckets(text):
        ws = [int(h) for h in Words([text]).hashes]
        pairs = [int(mix64(np.array([a], np.uint64) * np.uint64(3) + np.uint64(b))[0]) for a, b in zip(ws, ws[1:])]
        return Counter(h >> (64 - bits) for h in ws + pairs)

    fold = {text: xxhash.xxh3_64_intdigest(Words([text]).hashes.tobytes()) % 4 for _, text, *_ in rows}
    raw, target = Counter(), [Counter() for _ in range(4)]
    for k, text, *_ in rows:
        raw += buckets(text)
        if k < 10 and k % 3:
            target[fold[text]] += buckets(text)
    model = quality_rules.fit(docs, labels, bits)
    counted = lambda v: {k: int(x) for k, x in enumerate(v) if x}
    assert counted(model.raw) == dict(raw) and [counted(t) for t in model.target] == [dict(t) for t in target]
    for _, text, *_ in rows[:8]:
        own, others = buckets(text), sum((t for f, t in enumerate(target) if f != fold[text]), Counter())
        n, share = sum(own.values()), sum(others.values()) / (sum(raw.values()) - sum(own.values()))
        want = sum(c * np.log((others[b] + 20 * share) / (share * (raw[b] - c + 20))) for b, c in own.items()) / n
        assert model.score(quality_rules.ngram_buckets(Words([text]).hashes, bits), fold[text], model.others(), sum(raw.values())) == pytest.approx(want)


def test_rules_on_awkward_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(cases.empty(spark), none).count() == 0
    docs = cases.documents(spark, clash=True)
    kept = quality_rules.keep_good(docs, none)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, None}


def test_clean_documents_stay_and_junk_goes(spark):
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[d].kept for d, q in label.items() if q == 1 and not got[d].base_failed]
    bad = [got[d].kept for d, q in label.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25


def test_classifier_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    held = [(got[d].predicted, q) for d, q in label.items() if got[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93


def test_held_out_labels_do_not_teach(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality", "toxic")
    a, b = ({r.doc_id: r.score for r in quality_classifier.quality_scores(docs.limit(200), x).collect()} for x in (labels, flipped))
    assert a == b


def test_features_are_inside_words_and_whole():
    one, _ = quality_classifier.feature_buckets(["abc def"])
    many, whose = quality_classifier.feature_buckets(["abc", "", "def ghij", "abc def"])
    assert sorted(many[whose == 3]) == sorted(one) and not (whose == 1).any()
    again, _ = quality_classifier.feature_buckets(["abc\t \ndef"])
    assert sorted(again) == sorted(one)


def test_classifier_on_awkward_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.quality_scores(cases.documents(spark, clash=True), none).collect()
    assert len(rows) == 13 and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 0), (4, 0, 0), (8, None, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.quality_scores(cases.documents(spark), labels).count() == 13
    assert quality_classifier.quality_scores(cases.empty(spark), labels).count() == 0


def plain_training(examples, buckets, dimensions, epochs, rate, seed):
    """The trainer with loops instead of arrays; returns the margin of class 1 for any (buckets, counts)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets + 1, dimensions)).astype(np.float32).astype(float)
    layer, bias = np.zeros((2, dimensions)), np.zeros(2)
    share_of = Counter(e[2] for e in examples)
    step, steps = 0, epochs * len(examples)

    def forward(at, times):
        total = sum(times) + 1
        mean = [sum(vectors[b][d] * c for b, c in [*zip(at, times), (buckets, 1)]) / total for d in range(dimensions)]
        return mean, [sum(layer[c][d] * mean[d] for d in range(dimensions)) + bias[c] for c in (0, 1)]

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, times, label = examples[k]
            pull = rate * (1 - step / steps)
            step += 1
            mean, logits = forward(at, times)
            p = [math.exp(x) / sum(math.exp(y) for y in logits) for x in logits]
            wrong = [(p[c] - (c == label)) * len(examples) / (2 * share_of[label]) for c in (0, 1)]
            back = [sum(wrong[c] * layer[c][d] for c in (0, 1)) for d in range(dimensions)]
            for c in (0, 1):
                for d in range(dimensions):
                    layer[c][d] -= pull * wrong[c] * mean[d]
                bias[c] -= pull * 0.1 * wrong[c]
            largest = max([*times, 1])
            for b, c in [*zip(at, times), (buckets, 1)]:
                for d in range(dimensions):
                    vectors[b][d] -= pull * c / largest * back[d]
    return lambda at, times: (lambda z: z[1] - z[0])(forward(at, times)[1])


def test_trainer_and_scorer_against_plain_loops():
    rnd = np.random.default_rng(3)
    texts = [cases.words(k, 30, 12) if k % 2 else cases.words(k, 20, 25) for k in range(24)] + ["", "a a a a"]
    buckets = 64
    examples = [(*np.unique(quality_classifier.feature_buckets([t], buckets)[0], return_counts=True), int(rnd.integers(2))) for t in texts]
    model = quality_classifier.train(examples, buckets, 3, 4, 0.5, 7)
    margin = plain_training(examples, buckets, 3, 4, 0.5, 7)
    want = [1 / (1 + math.exp(-margin(at.tolist(), n.tolist()))) for at, n, _ in examples]
    assert model.scores(texts) == pytest.approx(want, abs=1e-4)


def plain_features(text, buckets):
    """Buckets of a text's features, one at a time."""
    line, shift = " " + " ".join(WORD.findall(text)) + " ", 64 - (buckets.bit_length() - 1)
    found = [int(h) >> shift for h in Words([text]).hashes]
    ws = WORD.findall(text)
    found += [int(quality_classifier._REPEAT) >> shift] * sum(a == b for a, b in zip(ws, ws[1:]))
    for size in (3, 4, 5):
        for k in range(len(line) - size + 1):
            h = 0
            for c in line[k : k + size]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
            found.append(int(mix64(np.array([(h + size) % 2**64], np.uint64))[0]) >> shift)
    return sorted(found) if ws else []


@pytest.mark.parametrize("text", ["abc def", "a a b", "x", "", " \t", "été wörter wörter 😀", "longer-word another,word; the end"])
def test_features_against_plain_loops(text):
    assert sorted(quality_classifier.feature_buckets([text], 1 << 12)[0].tolist()) == plain_features(text, 1 << 12)
