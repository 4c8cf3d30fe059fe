"""Language identification: segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary (and a floor for characters that are no
piece). The probability of a word is the sum over *all* its segmentations into pieces, which the forward
algorithm gives; a text's log-probability is the sum over its words. Piece probabilities come from
expectation-maximisation on word counts of a bounded sample of documents whose language is known.

A word is segmented with a word-start mark before it. Word log-probabilities are computed once per distinct word of a batch, words
of one length together. A run of more than ``LONG`` characters is first cut where no piece of the vocabulary spans the cut: there
the sum over all segmentations is the product of the sums of both sides, so nothing is lost. A stretch without such a cut goes
through a forward pass of its own, whatever its length.

Cases: null and empty texts and texts without a letter get ``und`` and score 0, as does every text when no language was learned.
The score is the posterior of the winning language under equal priors. Ties go to the language that sorts first.
Repeated rows are scored alike; rows without an id are predicted, and teach nothing. lang, source and doc_id never enter a
prediction: lang teaches on training rows only. Empty tables give empty results. Columns that are called like the result's are ignored by
``languages`` and kept by ``predict`` and ``keep_identified``.
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
from rankloom.llm.textcore import WORD, chunked

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: The model is fitted on about this many documents of each language; the bound does not grow with the corpus.
TRAIN_PER_LANGUAGE = 300
#: Their texts have no more than about this many characters in all, of each language.
TRAIN_CHARS = 4_000_000
VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 4
#: Longer runs are cut where no piece spans the cut.
LONG = 48
MARK = "▁"
#: Pseudo-count of every piece and language.
SMOOTHING = 0.05
#: Words whose log-probabilities a task keeps.
CACHE_WORDS = 300_000
#: New words of texts with about this many characters are scored together.
GROUP_CHARS = 3 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def load_pieces(path: str | None = None) -> list[str]:
    """Ordinary pieces of a sentencepiece model file (default: the public 32k vocabulary)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattice:
    """Finds all pieces in words of one length at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces)
        keys = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        # hash tables of piece numbers, probed one after another; each holds what collided in those before
        self.keys = np.append(keys, np.uint64(0))
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left, bits = np.arange(len(pieces)), 19
        while len(left):
            shift = np.uint64(64 - bits)
            table = np.full(1 << bits, len(pieces), np.int32)
            table[(keys[left] * _MIX) >> shift] = left
            self.tables.append((shift, table))
            left = left[table[(keys[left] * _MIX) >> shift] != left]
            bits = max(bits - 3, 10)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int32)
        spread = hashes * _MIX
        for shift, table in self.tables:
            at = table[spread >> shift]
            found = np.where(self.keys[at] == hashes, at, found)
        found[found == self.size] = -1
        return found

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of equal length: (start, end, piece index or -1 per word) of every span that some word has as a piece.

        Single characters always come: -1 there means the floor. Spans come by growing end.
        """
        n, length = len(words), len(words[0])
        chars = _codes("".join(words)).reshape(n, length) + np.uint64(1)
        hashes: dict[int, np.ndarray] = {}
        for end in range(1, length + 1):
            last = chars[:, end - 1]
            for start in [s for s in hashes if end - s > self.longest]:
                del hashes[start]
            for start in hashes:
                hashes[start] = hashes[start] * _BASE + last
            hashes[end - 1] = last.copy()
            for start, h in hashes.items():
                piece = self.find(h)
                if end - start == 1 or (piece >= 0).any():
                    yield start, end, piece


    def spans(self, word: str) -> list[np.ndarray]:
        """For every length from 1, the piece that starts at each place of one word, or -1."""
        chars = _codes(word) + np.uint64(1)
        out, hashes = [], chars
        for size in range(1, min(self.longest, len(word)) + 1):
            if size > 1:
                hashes = hashes[:-1] * _BASE + chars[size - 1 :]
            out.append(self.find(hashes))
        return out

    def cuts(self, word: str) -> np.ndarray:
        """Places inside a word that no piece spans."""
        covered = np.zeros(len(word) + 1, np.int64)
        for size, found in enumerate(self.spans(word), 1):
            at = np.flatnonzero(found >= 0)
            if size > 1 and len(at):
                np.add.at(covered, at + 1, 1)
                np.add.at(covered, at + size, -1)
        return np.flatnonzero(np.cumsum(covered)[1:-1] == 0) + 1

    def ends(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces of one word by growing end: start, piece (-1 is the floor of a character), first of each end."""
        starts, ends, pieces = [], [], []
        for size, found in enumerate(self.spans(word), 1):
            at = np.arange(len(found)) if size == 1 else np.flatnonzero(found >= 0)
            starts.append(at)
            ends.append(at + size)
            pieces.append(found[at])
        start, end, piece = map(np.concatenate, (starts, ends, pieces))
        order = np.argsort(end, kind="stable")
        return start[order], piece[order], np.searchsorted(end[order], np.arange(1, len(word) + 2))


def _log_sum(parts: np.ndarray) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    top = parts.max(0)
    return top + np.log(np.exp(parts - top).sum(0))


@dataclass(frozen=True)
class PieceModel:
    """log_prob[piece, language]; its last row is the floor of a character that is no piece."""

    languages: list[str]
    pieces: list[str]
    log_prob: np.ndarray

    def lattice(self) -> Lattice:
        return Lattice(self.pieces)

    def forward(self, lattice: Lattice, words: list[str]) -> np.ndarray:
        """Log-probability of each word (all of one length) in each language, over all segmentations."""
        n, length = len(words), len(words[0])
        alpha = np.full((length + 1, n, len(self.languages)), -np.inf)
        alpha[0] = 0
        for start, end, piece in lattice.edges(words):
            step = self.log_prob[piece]  # -1 takes the last row
            if end - start > 1:
                step = np.where((piece >= 0)[:, None], step, -np.inf)
            np.logaddexp(alpha[end], alpha[start] + step, out=alpha[end])
        return alpha[length]

    def forward_long(self, lattice: Lattice, word: str) -> np.ndarray:
        """The same of one word of any length."""
        return _forward_long(lattice.ends(word), self.log_prob)[-1]

    def word_scores(self, lattice: Lattice, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        for at in by_length(words):
            if len(words[at[0]]) > LONG:
                for k in at:
                    out[k] = self.forward_long(lattice, words[k])
                continue
            for k in range(0, len(at), 2048):
                out[at[k : k + 2048]] = self.forward(lattice, [words[i] for i in at[k : k + 2048]])
        return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            yield part


def _forward_long(ends: tuple[np.ndarray, np.ndarray, np.ndarray], log_prob: np.ndarray) -> np.ndarray:
    """Log-probabilities of all beginnings of a word, from ``Lattice.ends``."""
    start, piece, first = ends
    steps = log_prob[piece]
    alpha = np.zeros((len(first), log_prob.shape[1]))
    for end, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), 1):
        alpha[end] = _log_sum(alpha[start[a:b]] + steps[a:b])
    return alpha


def _backward_long(ends: tuple[np.ndarray, np.ndarray, np.ndarray], log_prob: np.ndarray) -> np.ndarray:
    """Log-probabilities of all remainders of a word."""
    start, piece, first = ends
    beta = np.full((len(first), log_prob.shape[1]), -np.inf)
    beta[-1] = 0
    for end in range(len(first) - 1, 0, -1):
        a, b = first[end - 1], first[end]
        at = start[a:b]  # distinct: pieces with one end differ in length
        beta[at] = np.logaddexp(beta[at], log_prob[piece[a:b]] + beta[end])
    return beta


def word_keys(text: str, lattice: Lattice) -> list[str]:
    """Words of a text; of a long one its parts between cuts, which from the second on start with a newline."""
    words = WORD.findall(text)
    if max(map(len, words), default=0) < LONG:
        return words
    out = []
    for word in words:
        if len(word) < LONG:
            out.append(word)
            continue
        whole = MARK + word
        at, free = 0, lattice.cuts(whole)
        while at < len(whole):  # as far as LONG allows, or to the next cut
            k = np.searchsorted(free, at + LONG, "right")
            end = len(whole) if len(whole) - at <= LONG else int(free[k - 1]) if k and free[k - 1] > at else int(free[k]) if k < len(free) else len(whole)
            out.append("\n" + whole[at:end] if at else whole[1:end])
            at = end
    return out


def spelled(key: str) -> str:
    """What is segmented for a key: a word with its mark, or a later part as it is."""
    return key[1:] if key.startswith("\n") else MARK + key


def expectation_maximisation(languages: list[str], counts: list[tuple[str, int, int]], pieces: list[str], rounds: int = ROUNDS) -> PieceModel:
    """Piece probabilities from (word, language index, count)."""
    lattice, n = Lattice(pieces), len(languages)
    words = sorted({w for w, _, _ in counts})
    index = {w: k for k, w in enumerate(words)}
    weight = np.zeros((len(words), n))
    for w, language, c in counts:
        weight[index[w], language] += c
    lengths = np.array([len(p) for p in pieces] + [1.0])
    log_prob = np.repeat((-1.5 * lengths - np.log(len(pieces) + 1))[:, None], n, 1)
    groups = [(at, [words[i] for i in at]) for whole in by_length(words) for at in np.split(whole, range(4096, len(whole), 4096))]
    long = [(k, lattice.ends(words[k])) for at, group in groups if len(group[0]) > LONG for k in at]
    groups = [(at, group) for at, group in groups if len(group[0]) <= LONG]
    for _ in range(rounds):
        expected = np.full((len(pieces) + 1, n), SMOOTHING)
        for at, group in groups:
            edges = list(lattice.edges(group))
            length = len(group[0])
            alpha = np.full((length + 1, len(group), n), -np.inf)
            beta = alpha.copy()
            alpha[0] = beta[length] = 0
            steps = [np.where((p >= 0)[:, None] | (e - s == 1), log_prob[p], -np.inf) for s, e, p in edges]
            for (s, e, _), step in zip(edges, steps, strict=True):
                np.logaddexp(alpha[e], alpha[s] + step, out=alpha[e])
            for (s, e, _), step in zip(reversed(edges), reversed(steps), strict=True):
                np.logaddexp(beta[s], beta[e] + step, out=beta[s])
            for (s, e, p), step in zip(edges, steps, strict=True):
                part = np.exp(alpha[s] + step + beta[e] - alpha[length]) * weight[at]
                for k in range(n):
                    expected[:, k] += np.bincount(np.where(p >= 0, p, len(pieces)), part[:, k], len(pieces) + 1)
        for k, ends in long:
            alpha, beta, (start, piece, first) = _forward_long(ends, log_prob), _backward_long(ends, log_prob), ends
            end = np.repeat(np.arange(1, len(first)), np.diff(first))
            part = np.exp(alpha[start] + log_prob[piece] + beta[end] - alpha[-1]) * weight[k]
            for language in range(n):
                expected[:, language] += np.bincount(np.where(piece >= 0, piece, len(pieces)), part[:, language], len(pieces) + 1)
        log_prob = np.log(expected) - np.log(expected.sum(0))
    return PieceModel(languages, pieces, log_prob)


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, vocabulary: str | None = None) -> PieceModel:
    """Fit on about ``per_language`` documents of each known language that are not held out."""
    small_batches(docs.sparkSession)
    known = only(docs, "doc_id", "text", "lang").where((remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("text").isNotNull())
    sample = stratified(known, "lang", per_language, TRAIN_CHARS, F.length("text")).select("text", "lang")
    pieces = load_pieces(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary: its size does not depend on the data

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in map(spelled, word_keys(text, lattice)):
                    found[w, lang] = found.get((w, lang), 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([lang for _, lang in found]), pa.array(found.values(), pa.int64())], names=["word", "lang", "n"])

    rows = sample.mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    words, langs, times = (rows.column(k).to_pylist() for k in range(3))
    languages = sorted(set(langs))
    return expectation_maximisation(languages, [(w, languages.index(x), n) for w, x, n in zip(words, langs, times, strict=True)], pieces)


def predict(docs: DataFrame, model: PieceModel) -> tuple[DataFrame, list[str]]:
    """``docs`` with the predicted language and its posterior, and the names of these columns."""
    names = fresh(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.log_prob))

    def compute(lists: Iterator[list]) -> Iterator[list[pa.Array]]:
        pieces = PieceModel(*shared.value)
        lattice, n = pieces.lattice(), len(pieces.languages)
        slot: dict[str, int] = {}
        scores = np.empty((0, n))
        for texts in lists:
            languages, chances = [], []
            for group in chunked(texts, GROUP_CHARS):
                parts = [word_keys(t, lattice) if n and any(map(str.isalpha, t)) else None for t in group]
                new = set().union(*filter(None, parts)) - slot.keys()
                if len(slot) + len(new) > CACHE_WORDS:
                    slot.clear()
                    new = set().union(*filter(None, parts))
                if new:
                    base, new = len(slot), list(new)
                    if len(scores) < base + len(new):
                        scores = np.concatenate([scores[:base], np.empty((max(len(new), base), n))])
                    scores[base : base + len(new)] = pieces.word_scores(lattice, list(map(spelled, new)))
                    slot.update(zip(new, range(base, base + len(new)), strict=True))
                for words in parts:
                    if not words:
                        languages.append(UNKNOWN)
                        chances.append(0.0)
                        continue
                    total = scores[np.fromiter(map(slot.__getitem__, words), np.int64, len(words))].sum(0)
                    best = int(total.argmax())
                    languages.append(pieces.languages[best])
                    chances.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield [pa.array(languages, pa.string()), pa.array(chances, pa.float64())]

    return append_columns(docs, "text", [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], compute), names


def languages(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    marked, _ = predict(only(docs, "doc_id", "text"), fit(docs, vocabulary=vocabulary))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return marked.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents with an identified language of at least that posterior, with the columns they came with."""
    marked, names = predict(docs, fit(docs))
    return marked.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= min_score)).select(*docs.columns)
