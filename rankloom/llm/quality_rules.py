"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Words and pairs of neighbouring words are hashed into ``2**BITS`` buckets. Two multinomials over the buckets are
counted over *all* documents: the raw corpus, and the trusted target (documents labelled good). A document's score is
the mean, over its n-grams, of ``log p_target - log p_raw``. Both sides leave the document out: its own n-grams leave the raw
counts, and the target counts are kept in ``FOLDS`` parts by a hash of the text, of which the text's own part does not count. So a text
is judged by other documents alone, trusted or not, without a look at its label, and exact copies do not vouch for each other.
Base rules on length and repetition come first; every other document is kept when its score reaches a fixed threshold.

Cases: null or empty text has no words, fails the base rules and is not kept. Without trusted documents in the other parts, or
when a document is alone, the score is 0, so the base rules alone decide. A score equal to the threshold is kept. Repeated rows are separate
documents; a label of a repeated id holds for all its rows, and one good label is enough. Rows without an id are judged, and
are not trusted. Very long texts are scored whole. Empty tables give empty results. Columns that are called like the result's are
ignored by ``quality_rules`` and kept by ``keep_good``. Word equality is by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.frames import append_columns, fresh, only
from rankloom.llm.storage import small_batches, sum_vectors
from rankloom.llm.textcore import Words, chunked, mix64

BITS = 18
#: Pseudo-counts of each bucket, shared between the two multinomials in proportion to their sizes.
ALPHA = 20.0
#: Least mean log-likelihood ratio, in nats per n-gram.
MIN_SCORE = -0.20
#: Parts of the target counts; a text is scored by the parts that its hash does not name.
FOLDS = 4
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_PAIR = np.uint64(3)


def ngram_buckets(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of all words and all pairs of neighbouring words."""
    both = np.concatenate([words, mix64(words[:-1] * _PAIR + words[1:])]) if len(words) else words
    return (both >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Number of words that stand in a window of ``width`` words found more than once in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    window = words[:n].copy()
    for k in range(1, width):
        window = mix64(window * _PAIR + words[k : n + k])
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines (split at \\n) that hold a word and equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def fold_of(words: np.ndarray, folds: int = FOLDS) -> int:
    """The part of a text, by its sequence of words."""
    return xxhash.xxh3_64_intdigest(words.tobytes()) % folds


@dataclass(frozen=True)
class RatioModel:
    """Bucket counts of the raw corpus and of the parts of the trusted target (one row each)."""

    raw: np.ndarray
    target: np.ndarray
    alpha: float = ALPHA

    def others(self) -> tuple[np.ndarray, np.ndarray]:
        """Target counts without each part, and their sums."""
        rest = self.target.sum(0) - self.target
        return rest, rest.sum(1)

    def score(self, buckets: np.ndarray, fold: int, others: tuple[np.ndarray, np.ndarray], total: int) -> float:
        """Mean log ratio of a text of part ``fold``; ``others`` is ``self.others()`` and ``total`` the sum of the raw counts."""
        found, times = np.unique(buckets, return_counts=True)
        n = int(times.sum())
        rest, trusted = total - n, int(others[1][fold])
        if not n or rest <= 0 or not trusted:
            return 0.0
        share = trusted / rest
        ratio = (others[0][fold][found] + self.alpha * share) / (share * (self.raw[found] - times + self.alpha))
        return float((times * np.log(ratio)).sum() / n)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, alpha: float = ALPHA) -> RatioModel:
    """Count both multinomials over all rows of ``docs``; a document is trusted if a label says quality 1."""
    small_batches(docs.sparkSession)
    good = only(labels, "doc_id", "quality").where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good")).distinct()
    good = good.withColumn("zero", F.pmod("good", F.lit(1)))
    # rows without an id match nothing; a hash of the text keeps them from meeting in one task
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("text"), F.lit(1 << 20))).otherwise(F.pmod("doc_id", F.lit(1)))
    texts = only(docs, "doc_id", "text").where(F.length("text") > 0).withColumn("spread", spread.cast(good.schema["zero"].dataType))
    texts = texts.join(good.hint("shuffle_hash"), (F.col("doc_id") == F.col("good")) & (F.col("spread") == F.col("zero")), "left").select("text", F.col("good").isNotNull().alias("trusted"))
    size = 1 << bits

    def add(total: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for b in batches:
            trusted = iter(b.column(1).to_pylist())
            for group in chunked(b.column(0).to_pylist()):
                held: dict[int, list[np.ndarray]] = {}
                parts = []
                for words in Words(group):
                    parts.append(ngram_buckets(words, bits))
                    if next(trusted):
                        held.setdefault(fold_of(words), []).append(parts[-1])
                total[:size] += np.bincount(np.concatenate(parts), minlength=size)
                for fold, mine in held.items():
                    total[(1 + fold) * size : (2 + fold) * size] += np.bincount(np.concatenate(mine), minlength=size)

    total = sum_vectors(texts, (1 + FOLDS) * size, add)
    return RatioModel(total[:size], total[size:].reshape(FOLDS, size), alpha)


MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())]


def annotate(docs: DataFrame, model: RatioModel, min_score: float = MIN_SCORE) -> tuple[DataFrame, list[str]]:
    """``docs`` with the measures and the verdict, and the names these columns got (clashes get an underscore)."""
    names = fresh(docs, *[n for n, _ in MEASURES])
    shared = docs.sparkSession.sparkContext.broadcast((model.raw, model.target, model.alpha))
    bits = int(len(model.raw)).bit_length() - 1

    def compute(lists: Iterator[list]) -> Iterator[list[pa.Array]]:
        ratio = RatioModel(*shared.value)
        others, total = ratio.others(), int(ratio.raw.sum())
        for texts in lists:
            rows = []
            for group in chunked(texts):
                words = Words(group)
                chars = np.concatenate([[0], np.cumsum(words.ends - words.starts)])[words.first]
                codes = words.codes
                marks = np.concatenate([[0], np.cumsum(_SYMBOL[np.minimum(codes, 127)] & (codes < 128))])
                at = 0
                for k, (text, w) in enumerate(zip(group, words, strict=True)):
                    n, repeat = len(w), repeated_words(w)
                    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * n
                    score = ratio.score(ngram_buckets(w, bits), fold_of(w, len(ratio.target)), others, total)
                    rows.append((n, int(chars[k + 1] - chars[k]), int(marks[at + len(text)] - marks[at]), duplicate_lines(text), repeat, failed, score, not failed and score >= min_score))
                    at += len(text) + 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    fields = [T.StructField(n, t) for n, (_, t) in zip(names, MEASURES, strict=True)]
    return append_columns(docs, "text", fields, compute), names


def quality_rules(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept and score."""
    marked, names = annotate(only(docs, "doc_id", "text"), fit(docs, labels), min_score)
    return marked.select("doc_id", *names[:-2], "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    marked, names = annotate(docs, fit(docs, labels), min_score)
    return marked.where(F.col(names[-1])).select(*docs.columns)
