"""Lexical and dense retrieval over tables of documents and queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.context import materialise, small_batches, spread
from rankloom.functions.text import PLAIN, identifier_tokens
from rankloom.operators.ranking import rank_by, reciprocal_rank_fusion, top_k

CORPUS_K1, SELECTOR_K1, B = 1.5, 1.2, 0.75


def bm25(docs: DataFrame, queries: DataFrame, tokens=identifier_tokens, k1: float = CORPUS_K1, b: float = B, query_frequency: bool = False, pool: str | None = None) -> DataFrame:
    """(query, doc_id, score) of documents that share a term with a query.

    ``docs`` has doc_id and text, ``queries`` query and text. Statistics cover all documents, or each value of the ``pool``
    column by itself. Only query terms leave the scan: document lengths are counted in the row, and the inverted
    index is cut to the queries' vocabulary before anything is shuffled by term.
    """
    keys = [pool] if pool else []
    wanted = queries.where("query IS NOT NULL").select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    words = spread(docs.select("doc_id", *keys, "text")).select("doc_id", *keys, tokens(F.col("text")).alias("terms"))
    lengths = words.select("doc_id", *keys, F.size("terms").cast("double").alias("length"))
    totals = lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    found = words.select("doc_id", *keys, F.size("terms").cast("double").alias("length"), F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    found = found.groupBy("doc_id", *keys, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    # counted by way of tf, so that both uses of these rows have the same plan and share one shuffle
    df = found.groupBy("term", *keys).agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    stats = df.join(totals, keys) if keys else df.crossJoin(F.broadcast(totals))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = stats.select("term", *keys, idf.alias("idf"), F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")).alias("mean"))
    # a document's weight for a term is computed once, before queries that share the term multiply the rows
    part = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    weights = found.join(stats, ["term", *keys]).select("term", "doc_id", *keys, part.alias("part"))
    scored = weights.join(wanted, "term")
    return scored.groupBy("query", "doc_id", *keys).agg(F.sum(F.col("part") * F.col("qtf") if query_frequency else F.col("part")).alias("score"))


#: Query terms (one row per query and term) that fit a broadcast, and their statistics by pool; beyond that terms are joined.
MOST_WANTED, MOST_STATISTICS = 1_000_000, 2_000_000
#: Components of query vectors that a broadcast holds.
DENSE_CELLS = 8_000_000
#: Scores (documents times queries) that a task holds at once.
SCORE_CELLS = 1 << 20
#: Tokens of texts that a task counts at once, and characters where it splits texts itself; different tokens that it remembers.
COUNT_TOKENS, COUNT_CHARACTERS, KNOWN_TOKENS = 1 << 19, 1 << 21, 1 << 16


class Wanted:
    """The queries' terms: their numbers, and for each the queries that hold it and how often."""

    def __init__(self, rows: list[tuple]):
        self.queries = sorted({r[0] for r in rows})
        number = {q: k for k, q in enumerate(self.queries)}
        self.terms = {t: k for k, t in enumerate(sorted({r[1] for r in rows}))}
        held: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for query, term, times in rows:
            held[self.terms[term]].append((number[query], times))
        self.at = [np.array([q for q, _ in h], np.int64) for h in held]
        self.times = [np.array([n for _, n in h], float) for h in held]

    def once(self) -> Wanted:
        """The same with every term once in a query."""
        same = copy(self)
        same.times = [np.ones(len(n)) for n in self.times]
        return same

    def counts(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times in the row) of a batch's term lists, for wanted terms alone, and all lists' lengths."""
        lengths = np.diff(column.offsets.to_numpy())
        coded = column.flatten().dictionary_encode()
        number = np.array([self.terms.get(t, -1) for t in coded.dictionary.to_pylist()] or [-1], np.int64)
        term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        known = term >= 0
        cells, times = np.unique(row[known] * max(len(self.terms), 1) + term[known], return_counts=True)
        return cells // max(len(self.terms), 1), cells % max(len(self.terms), 1), times, lengths

    def split_counts(self, texts: pa.StringArray, find: Callable, forms: Callable, remembered: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``counts`` of texts that are split here: ``find`` gives a text's tokens, ``forms`` a token's terms, which are ``remembered`` with their numbers."""
        term, times, sizes, lengths = [], [], [], []
        for text in texts.to_pylist():
            length, held = 0, {}
            for token, n in Counter(find(text or "")).items():
                known = remembered.get(token)
                if known is None:
                    if len(remembered) >= KNOWN_TOKENS:
                        remembered.clear()
                    own = forms(token)
                    known = remembered[token] = len(own), [self.terms[t] for t in own if t in self.terms]
                length += n * known[0]
                for t in known[1]:
                    held[t] = held.get(t, 0) + n
            lengths.append(length)
            sizes.append(len(held))
            for t in sorted(held):
                term.append(t)
                times.append(held[t])
        return np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64)), np.array(term, np.int64), np.array(times, np.int64), np.array(lengths, np.int64)


#: Bytes of lower-cased ASCII words as ``identifier_tokens`` takes them, 0 for all others; the bytes of a number's low end.
_LOWER = np.array([c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 0 for c in bytes(range(256)).lower()], np.uint8)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BASE, _MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), 18


class Identifiers:
    """Terms to be found among the words of texts (``identifier_tokens``) by their bytes, all words of a slice at once.

    A word is told by its first and last 8 bytes and its length, one of more than 16 bytes is compared whole.
    """

    def __init__(self, terms: dict[str, int]):
        words = [t.encode() for t in terms]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(words)]
        self.size = len(words)
        keys, first, last, length = self._told(np.frombuffer(b"".join(words), np.uint8), starts, ends)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.last, self.length = keys[order], first[order], last[order], length[order]
        self.number = np.array(list(terms.values()), np.int64)[order]
        self.long = {k: words[i] for k, i in enumerate(order.tolist()) if len(words[i]) > 16}
        self.alike = int(np.unique(keys, return_counts=True)[1].max(initial=0))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def _told(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first bytes, last bytes, length) of the words at these places."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        length = stops - starts
        first = eight[starts] & _LOW[np.minimum(length, 8)]
        last = np.where(length > 8, eight[np.maximum(stops - 8, 0)], np.uint64(0))
        mixed = (first * _BASE + last) * _MIX
        return ((mixed ^ (mixed >> np.uint64(32))) + length.astype(np.uint64)) * _BASE, first, last, length

    def _held(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of its term) of the words that are terms."""
        keys, first, last, length = self._told(data, starts, stops)
        near = np.flatnonzero(self.maybe[(keys >> np.uint64(64 - _BITS)).astype(np.int64)])
        keys, first, last, length = keys[near], first[near], last[near], length[near]
        least, found = np.searchsorted(self.keys, keys), []
        for k in range(self.alike):
            at = np.minimum(least + k, self.size - 1)
            same = np.flatnonzero((self.keys[at] == keys) & (self.first[at] == first) & (self.last[at] == last) & (self.length[at] == length) & (least + k < self.size))
            word, at = near[same], at[same]
            for i in np.flatnonzero(self.length[at] > 16).tolist():
                if data[starts[word[i]] : stops[word[i]]].tobytes() != self.long[int(at[i])]:
                    at[i] = -1
            found.append((word[at >= 0], self.number[at[at >= 0]]))
        return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times in the row) of texts, and the number of all words in each."""
        n, size = len(texts), max(self.size, 1)
        # the two letters outside ASCII whose lower case has a letter of ASCII
        texts = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "\u212a", "k"), "\u0130", "i\u0307")
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        code = _LOWER[np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        lengths, cells, times, start = np.zeros(n, np.int64), [], [], 0
        while start < len(code):
            stop = start + COUNT_CHARACTERS
            while stop < len(code) and code[stop]:  # a stretch ends between words
                stop += 1
            stop = min(stop, len(code))
            part = code[start:stop]
            begins, closes = _word_places(part, ends[np.searchsorted(ends, start) : np.searchsorted(ends, stop)] - start)
            row = np.searchsorted(ends, begins + start, "right") - 1
            lengths += np.bincount(row, minlength=n)
            word, term = self._held(part, begins, closes)
            one, many = np.unique(row[word] * size + term, return_counts=True)
            cells.append(one)
            times.append(many)
            start = stop
        if not cells:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), lengths
        if len(cells) > 1:
            whole, at = np.unique(np.concatenate(cells), return_inverse=True)
            cells, times = [whole], [np.bincount(at, np.concatenate(times), len(whole)).astype(np.int64)]
        return cells[0] // size, cells[0] % size, times[0], lengths


def _word_places(code: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of ``_LOWER`` codes begin and end; none goes over a border, and digits ahead of a word are not part of it."""
    inside = code != 0
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    shuts[:-1] &= ~inside[1:]
    opens[borders] = inside[borders]
    borders = borders[borders > 0] - 1
    shuts[borders] = inside[borders]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    digits = np.flatnonzero(code[starts] <= ord("9"))
    if len(digits):
        letters = np.append(np.flatnonzero(code > ord("9")), len(code))
        starts[digits] = letters[np.searchsorted(letters, starts[digits])]
        kept = starts < stops
        starts, stops = starts[kept], stops[kept]
    return starts, stops


def _wanted(queries: DataFrame, tokens: Callable) -> tuple[DataFrame, Wanted | None]:
    """(query, term, qtf), and the same for a broadcast if it fits one."""
    rows = queries.where("query IS NOT NULL").select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    found = rows.limit(MOST_WANTED + 1).collect()
    return rows, Wanted([tuple(r) for r in found]) if len(found) <= MOST_WANTED else None


@dataclass
class Counted:
    """The queries' terms, and how often documents hold them: texts are split into tokens once, for every ranking of them.

    ``rows``: query, term, qtf. ``words``: doc_id, pool, length (in tokens), terms (numbers of ``wanted``, without repeats) and times. Neither
    ``wanted`` nor ``words`` is there if the queries' terms do not fit a broadcast.
    """

    rows: DataFrame
    wanted: Wanted | None
    words: DataFrame | None
    pool: str | None


def counted_terms(docs: DataFrame, queries: DataFrame, tokens: Callable = identifier_tokens, pool: str | None = None) -> Counted:
    """Documents (doc_id, text, pool) as counts of the terms of queries (query, text), kept in the shared folder."""
    for c in ["doc_id", *([pool] if pool else [])]:
        docs = docs.where(F.col(c).isNotNull())
    rows, wanted = _wanted(queries, tokens)
    if wanted is None:
        return Counted(rows, None, None, pool)
    small_batches(docs.sparkSession)
    keys = ["doc_id", *([pool] if pool else [])]
    plain = PLAIN.get(tokens)
    texts = spread(docs.select(*keys, "text")).select(*keys, "text" if plain else tokens(F.col("text")).alias("tokens"))
    whole_words = tokens is identifier_tokens
    shared = docs.sparkSession.sparkContext.broadcast(Identifiers(wanted.terms) if whole_words else wanted)
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*[texts.schema[c] for c in keys], T.StructField("length", T.LongType()), T.StructField("terms", numbers), T.StructField("times", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict = {}
        for whole in batches:
            for b in _by_characters(whole) if plain else _by_tokens(whole):
                if plain and not whole_words:
                    row, term, times, lengths = shared.value.split_counts(b.column("text"), *plain, remembered)
                else:
                    row, term, times, lengths = shared.value.counts(b.column("text" if plain else "tokens"))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (term, times)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(lengths, pa.int64()), *lists], names=schema.names)

    return Counted(rows, wanted, materialise(texts.mapInArrow(run, schema), "counted-terms"), pool)


def _by_characters(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that have about ``COUNT_CHARACTERS`` bytes of text, or one row of more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COUNT_CHARACTERS, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _by_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that have about ``COUNT_TOKENS`` tokens, or one row of more."""
    ends = np.cumsum(np.diff(batch.column("tokens").offsets.to_numpy()))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + COUNT_TOKENS, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of a batch of ``Counted.words``."""
    lists = batch.column("terms")
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return row, lists.flatten().to_numpy().astype(np.int64), batch.column("times").flatten().to_numpy().astype(float)


def _best_of_chunks(words: DataFrame, wanted: Wanted, k: int, pool: str | None, weigh: Callable) -> DataFrame:
    """(query, doc_id, pool, score): of every task's documents (``Counted.words``) the k best for each query (and pool).

    ``weigh(term, times, length, pool)`` gives the weight of terms in documents. Scores are compared at 6 places, then by id.
    """
    shared = words.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([T.StructField("query_number", T.LongType()), words.schema["doc_id"], *([words.schema[pool]] if pool else []), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def scored(batch: pa.RecordBatch) -> np.ndarray:
        """Scores of the batch's documents (rows) for all queries (columns)."""
        asked = shared.value
        pools = batch.column(pool).to_numpy(zero_copy_only=False) if pool else None
        row, term, times = _cells(batch)
        lengths = batch.column("length").to_numpy().astype(float)
        part = weigh(term, times, lengths[row], pools[row] if pool else None)
        order = np.argsort(term, kind="stable")
        row, term, part = row[order], term[order], part[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]]) if len(term) else np.zeros(1, np.int64)
        scores = np.zeros((batch.num_rows, len(asked.queries)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            t = int(term[a])
            scores[row[a:b, None], asked.at[t]] += part[a:b, None] * asked.times[t]
        return scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(len(shared.value.queries), 1)
        held, names_of_pools = None, {}
        for batch in _slices(batches, n):
            scores, ids = scored(batch), batch.column("doc_id")
            rounded = np.where(scores > 0, np.round(scores, 6), -np.inf)
            groups = [np.arange(batch.num_rows)] if pool is None else _groups(batch.column(pool).to_numpy(zero_copy_only=False))
            for rows in groups:
                number = names_of_pools.setdefault(batch.column(pool)[int(rows[0])].as_py() if pool else None, len(names_of_pools))
                row, query = _candidates(rounded[rows], None, k)
                held = _keep_best(held, number * n + query, scores[rows[row], query], ids.take(pa.array(rows[row])), k)
        if held is not None:
            listed = list(names_of_pools)
            pools = [pa.array([listed[g] for g in (held[0] // n).tolist()], batch.column(pool).type)] if pool else []
            yield pa.RecordBatch.from_arrays([pa.array(held[0] % n, pa.int64()), held[2], *pools, pa.array(held[1])], names=names)

    found = words.mapInArrow(run, schema)
    names_of = words.sparkSession.createDataFrame(list(enumerate(wanted.queries)), "query_number long, query long")
    return found.join(F.broadcast(names_of), "query_number").drop("query_number")  # one row per query of the broadcast


def _slices(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that their scores for all queries fit ``SCORE_CELLS``."""
    step = max(SCORE_CELLS // max(queries, 1), 1)
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            part = whole.slice(start, step)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=part.schema.names)


def _groups(values: np.ndarray) -> list[np.ndarray]:
    places: dict = {}
    for k, v in enumerate(values.tolist()):
        places.setdefault(v, []).append(k)
    return [np.array(p) for p in places.values()]


def bm25_top(
    docs: DataFrame, queries: DataFrame, k: int, tokens=identifier_tokens, k1: float = CORPUS_K1, b: float = B, query_frequency: bool = False, pool: str | None = None, counted: Counted | None = None
) -> DataFrame:
    """(query, doc_id, score, rank): the k best by score rounded to 6 places, then by id; with a ``pool`` the k best of each value.

    Where the queries' terms fit a broadcast, documents are scored by their counts of them (``counted_terms``; ``counted`` if that is there
    already), and only each task's best for every query are shuffled. Beyond that, terms are joined (``bm25``). Query ids are integers, and
    queries without one are left out; documents without an id or a pool are left out, of the statistics too.
    """
    for c in ["doc_id", *([pool] if pool else [])]:
        docs = docs.where(F.col(c).isNotNull())
    keys = ["query", *([pool] if pool else [])]
    counted = counted or counted_terms(docs, queries, tokens, pool)
    statistics = _statistics(counted.words, counted.wanted, pool) if counted.wanted else None
    if statistics is None:
        scored = bm25(docs, queries, tokens, k1, b, query_frequency, pool)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(statistics)

        def weigh(term: np.ndarray, times: np.ndarray, length: np.ndarray, pools: np.ndarray | None) -> np.ndarray:
            known = shared.value
            number = np.array([known["pools"][p] for p in pools.tolist()], np.int64) if pools is not None else np.zeros(len(term), np.int64)
            n, mean = known["n"][number], known["mean"][number]
            df = known["df"][number, term]
            return np.log(1 + (n - df + 0.5) / (df + 0.5)) * (times * (k1 + 1)) / (times + k1 * (1 - b + b * length / mean))

        scored = _best_of_chunks(counted.words, counted.wanted if query_frequency else counted.wanted.once(), k, pool, weigh)
    return top_k(scored.withColumn("score", F.round("score", 6)), keys if pool else "query", k, F.col("score").desc(), "doc_id")


def _statistics(words: DataFrame, wanted: Wanted, pool: str | None) -> dict | None:
    """Documents, mean length and document counts of the wanted terms, of every pool; none if they do not fit a broadcast."""
    size = max(len(wanted.terms), 1)
    kind = [words.schema[pool]] if pool else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, _ = _cells(b)
            lengths = b.column("length").to_numpy()
            pools = b.column(pool).to_pylist() if pool else [None] * b.num_rows
            names = {p: k for k, p in enumerate(dict.fromkeys(pools))}
            number = np.array([names[p] for p in pools], np.int64)
            cells, times = np.unique(number[row] * size + term, return_counts=True)
            whole, total = np.bincount(number, minlength=len(names)), np.bincount(number, lengths, len(names)).astype(np.int64)
            which = np.concatenate([cells // size, np.arange(len(names)), np.arange(len(names))])
            code = np.concatenate([cells % size, np.full(len(names), -1), np.full(len(names), -2)])
            listed = list(names)
            parts = [pa.array([listed[w] for w in which.tolist()], b.column(pool).type)] if pool else []
            yield pa.RecordBatch.from_arrays([*parts, pa.array(code, pa.int64()), pa.array(np.concatenate([times, whole, total]), pa.int64())], names=[*([pool] if pool else []), "code", "n"])

    schema = T.StructType([*kind, T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    counted = words.mapInArrow(run, schema).groupBy(*([pool] if pool else []), "code").agg(F.sum("n").alias("n"))
    found = counted.limit(MOST_STATISTICS + 1).collect()
    pools = {p: k for k, p in enumerate(sorted({r[0] for r in found}, key=str) if pool else [None])}
    if len(found) > MOST_STATISTICS or len(pools) * len(wanted.terms) > 8 * MOST_STATISTICS:
        return None
    df, n, total = np.zeros((len(pools), max(len(wanted.terms), 1))), np.zeros(len(pools)), np.zeros(len(pools))
    for r in found:
        at = pools[r[0] if pool else None]
        if r["code"] >= 0:
            df[at, r["code"]] = r["n"]
        else:
            (n if r["code"] == -1 else total)[at] = r["n"]
    mean = np.where(total > 0, total / np.maximum(n, 1), 1.0)
    return {"pools": pools, "df": df, "n": n, "mean": mean}


def overlap_top(docs: DataFrame, queries: DataFrame, k: int, tokens=identifier_tokens, counted: Counted | None = None) -> DataFrame:
    """(query, doc_id, score, rank): the k documents that share the most distinct terms with a query, then by id. ``counted`` as in ``bm25_top``."""
    counted = counted or counted_terms(docs, queries, tokens)
    if counted.wanted is None:
        listed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        scored = listed.join(counted.rows, "term").groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    else:
        scored = _best_of_chunks(counted.words, counted.wanted.once(), k, None, lambda term, times, length, pools: np.ones(len(term)))
    return top_k(scored.withColumn("score", F.col("score").cast("long")), "query", k, F.col("score").desc(), "doc_id")


class Asked:
    """Query vectors of one length as rows of a matrix, with their lengths (norms)."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.matrices: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(r[1]) for r in rows}):
            at = np.array([k for k, r in enumerate(rows) if len(r[1]) == size])
            m = np.array([rows[k][1] for k in at], float).reshape(len(at), size)
            self.matrices[size] = (at, m, np.sqrt((m * m).sum(1)))

    def scores(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, queries, cosines at 6 places) of a batch, block by block of vectors of one length."""
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        for size, (at, m, norms) in self.matrices.items():
            rows = np.flatnonzero(sizes == size)
            if not len(rows):
                continue
            flat = vectors.take(pa.array(rows)).flatten()
            v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)
            length = np.sqrt((v * v).sum(1))[:, None] * norms[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                yield rows, at, np.round(np.where(length == 0, 0.0, v @ m.T / length), 6)


def _query_blocks(queries: DataFrame) -> Iterator[Asked]:
    """The queries in blocks of at most 64 MB, as a number of blocks that follows from their count."""
    asked = queries.where("query IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)").select("query", "vector")
    cells = asked.agg(F.sum(F.size("vector")).alias("cells")).first().cells or 0
    blocks = max(1, -(-cells // DENSE_CELLS))
    for k in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        yield Asked([(r.query, r.vector) for r in part.collect()])


def _keep_best(held: tuple | None, query: np.ndarray, score: np.ndarray, keys: pa.Array, k: int, places: int = 6) -> tuple:
    """The k best rows of every query so far, by rounded score and then key."""
    if held is not None:
        query, score, keys = np.concatenate([held[0], query]), np.concatenate([held[1], score]), pa.concat_arrays([held[2], keys])
    by_key = np.empty(len(keys), np.int64)
    by_key[np.asarray(pc.array_sort_indices(keys))] = np.arange(len(keys))
    order = np.lexsort((by_key, -np.round(score, places), query))
    first = np.searchsorted(query[order], query[order], "left")
    kept = order[np.arange(len(order)) - first < k]
    return query[kept], score[kept], keys.take(pa.array(kept))


def _candidates(scores: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that can be among a column's k best, ties at the edge included."""
    if allowed is not None:
        scores = np.where(allowed, scores, -np.inf)
    edge = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    return np.nonzero((scores >= edge) & (scores > -np.inf))


def _best_of_tasks(items: DataFrame, asked: Asked, k: int, open_files: dict | None = None) -> DataFrame:
    """(number, key, score): a running top k of every query per task, as a product of blocks; rows shuffled are tasks x queries x k.

    ``open_files`` holds, by file, the numbers of the queries that may look into it; without it all items are open.
    """
    shared = items.sparkSession.sparkContext.broadcast((asked, open_files))
    schema = T.StructType([T.StructField("number", T.LongType()), items.schema["key"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, open_files = shared.value
        held = None
        for batch in _slices(batches, len(asked.ids)):
            keys, vectors = batch.column("key"), batch.column("vector")
            files = batch.column("file").to_pylist() if open_files is not None else None
            for rows, at, scores in asked.scores(vectors):
                allowed = None
                if files is not None:
                    allowed = np.zeros((len(rows), len(asked.ids)), bool)
                    for r, i in enumerate(rows.tolist()):
                        allowed[r, open_files.get(files[i], [])] = True
                    allowed = allowed[:, at]
                row, column = _candidates(scores, allowed, k)
                held = _keep_best(held, at[column], scores[row, column], keys.take(pa.array(rows[row])), k)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), held[2], pa.array(held[1])], names=["number", "key", "score"])

    usable = items.where("key IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    return usable.select("key", "vector", *(["file"] if open_files is not None else [])).mapInArrow(run, schema)


def _named(found: DataFrame, asked: Asked, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("query", kind)])
    names = found.sparkSession.createDataFrame(list(enumerate(asked.ids)), schema)  # one row per query of a block
    return found.join(F.broadcast(names), "number").drop("number")


def nearest_values(items: DataFrame, queries: DataFrame, k: int, width: int = 64) -> DataFrame:
    """(query, key, rank): the k items (key, value) nearest each query (query, value) by whole-number value, then by key.

    Of items with equal values only the first k matter. The rest is a join on bins of a width that grows, eightfold
    a round, for the queries that have not found k items within it.
    """
    kept = materialise(top_k(items.where("value IS NOT NULL"), "value", k, "key").select("key", "value"), "nearest-values")
    left = queries.where("value IS NOT NULL").select("query", F.col("value").alias("wanted"))
    low, high = kept.agg(F.min("value"), F.max("value")).first()
    near, far = left.agg(F.min("wanted"), F.max("wanted")).first()
    found = None
    while True:
        last = low is None or near is None or width >= max(high, far) - min(low, near)
        bins = F.explode(F.sequence(F.floor(F.col("wanted") / width) - 1, F.floor(F.col("wanted") / width) + 1))
        pairs = left.withColumn("bin", bins).join(kept.withColumn("bin", F.floor(F.col("value") / width)), "bin")
        pairs = pairs.withColumn("distance", F.abs(F.col("value") - F.col("wanted"))).where(F.col("distance") <= width)
        best = materialise(top_k(pairs, "query", k, "distance", "key").select("query", "wanted", "key", "rank"), "nearest-values")
        done = best.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.lit(last) | (F.col("n") >= k)).select("query")
        part = best.join(done, "query", "left_semi").select("query", "key", "rank")
        found = part if found is None else found.unionByName(part)
        left = left.join(done, "query", "left_anti")
        if last or left.isEmpty():
            return found
        width *= 8


def dense_top(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, score, rank): the k items (key, vector) of largest cosine, at 6 places, then by key.

    Items meet queries as matrix products where they are read; more queries than a broadcast holds take as many passes as blocks. Rows
    without a key or vector, vectors with a null and vectors of another length than a query's are not scored.
    """
    parts = [_named(_best_of_tasks(items, asked, k), asked, queries.schema["query"].dataType) for asked in _query_blocks(queries)]
    return top_k(reduce(DataFrame.unionByName, parts), "query", k, F.col("score").desc(), "key")


def _file_maxima(items: DataFrame, asked: Asked) -> DataFrame:
    """(number, file, score, members): every task's best score and number of items, by query and file."""
    shared = items.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType([T.StructField("number", T.LongType()), items.schema["file"], T.StructField("score", T.DoubleType()), T.StructField("members", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in _slices(batches, len(shared.value.ids)):
            names = batch.column("file").to_pylist()
            for rows, at, scores in shared.value.scores(batch.column("vector")):
                places = _groups(np.array([names[i] for i in rows.tolist()], object))
                for group in places:
                    file = names[rows[group[0]]]
                    score, members = best.setdefault(file, (np.full(len(shared.value.ids), -np.inf), np.zeros(len(shared.value.ids), np.int64)))
                    score[at] = np.maximum(score[at], scores[group].max(0))
                    members[at] += len(group)
        for file, (score, members) in best.items():
            at = np.flatnonzero(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([file] * len(at), batch.schema.field("file").type), pa.array(score[at]), pa.array(members[at])],
                names=["number", "file", "score", "members"],
            )

    usable = items.where("key IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    found = usable.select("file", "vector").mapInArrow(run, schema)
    return found.groupBy("number", "file").agg(F.max("score").alias("score"), F.sum("members").alias("members"))


def taken_files(files: DataFrame, k: int, min_files: int, query: str = "query") -> DataFrame:
    """Of ranked files (query, file, score, members) those taken until at least ``min_files`` and ``k`` members are in, with their rank."""
    ranked = rank_by(files, query, F.col("score").desc(), "file", name="file_rank")
    earlier = F.sum("members").over(Window.partitionBy(query).orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("before", F.coalesce(earlier, F.lit(0))).where((F.col("before") < k) | (F.col("file_rank") <= min_files))


def dense_file_first(items: DataFrame, queries: DataFrame, k: int, min_files: int) -> DataFrame:
    """query, file, key, score, file_rank, rank: files by their best item, taken as ``taken_files`` does, then the k best items in them.

    ``items``: key, vector, file. One pass reduces the blocks to file maxima, a second keeps a running top k in the files that a
    query has taken, which are at most max(k, min_files) each.
    """
    parts = []
    for asked in _query_blocks(queries):
        taken = materialise(taken_files(_file_maxima(items, asked), k, min_files, "number").select("number", "file", "file_rank"), "taken-files")
        open_files: dict = {}
        for r in taken.select("number", "file").toLocalIterator():  # queries of one block times the files each has taken
            open_files.setdefault(r.file, []).append(r.number)
        best = top_k(_best_of_tasks(items, asked, k, open_files), "number", k, F.col("score").desc(), "key")
        best = best.join(items.select("key", "file"), "key").join(taken, ["number", "file"])
        parts.append(_named(best, asked, queries.schema["query"].dataType))
    return reduce(DataFrame.unionByName, parts).select("query", "file", "key", "score", "file_rank", "rank")


def file_first(files: DataFrame, members: DataFrame, k: int, min_files: int) -> DataFrame:
    """``dense_file_first`` over scores that are there already.

    ``files``: query, file, score. ``members``: query, file, key, score. Returns query, file, key, score, file_rank, rank.
    """
    sizes = members.groupBy("query", "file").agg(F.count(F.lit(1)).alias("members"))
    taken = taken_files(files.join(sizes, ["query", "file"], "left").na.fill(0, ["members"]), k, min_files)
    inside = members.join(taken.select("query", "file", "file_rank"), ["query", "file"])
    return top_k(inside, "query", k, F.col("score").desc(), "key")


def hybrid(lexical: DataFrame, dense_ranking: DataFrame, depth: int = 200, k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query, key, rank) cut at ``depth``."""
    cut = lambda df: df.where(F.col("rank") <= depth)
    return reciprocal_rank_fusion([("lexical", cut(lexical)), ("dense", cut(dense_ranking))], None, k, limit)


