"""Groups of spelling variants: words one edit apart, each pointing to a far commoner form.

Two words are one edit apart exactly if they share a *key*, a word itself or one of its single deletions: a replacement leaves
the same rest on both sides, an insertion is the shorter word itself. Every word emits its distinct keys, keys are equi-joined, and
each pair that meets is verified to be at distance one. Two words at that distance share exactly one key, so nothing is counted
twice. A key meets only words that add one character to it, at most (length + 1) times the alphabet, so no key is hot.

Occurrences are counted where texts are read; a task sends each word once per ``HELD`` distinct ones, so frequent words are never
moved in numbers. A form occurs at least five times as often as its word, so chains end after a logarithm of the largest count;
roots are found by doubling: a word's pointer is replaced by its target's until nothing changes, each round one join on words
written to the shared folder.

Cases. Null and empty texts have no words. A null id counts as the empty string before the colon. Repeated rows count each. Ties between
forms go to the smaller word in code-point order. Runs of any length are words; texts are read whole. Empty tables give no
rows. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import only
from rankloom.llm.storage import small_batches, stash

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Every occurrence whose checksum this divides has lost a character.
DAMAGE = 199
SHORTEST, FEWEST = 6, 5
#: A form is at least so many times as frequent as its word.
COMMONER = 5
#: Distinct words that a task holds before it sends their counts.
HELD = 1_000_000


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(UPPER)


def damaged(doc_id: int | None, run: str) -> str:
    """The run as it is counted in this document."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least ``fewest`` times."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            words = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(words, names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one text at a time
                found: Counter[str] = Counter()
                for word, n in Counter(RUN.findall(text.as_py() or "")).items():
                    found[lowered(word)] += n
                for word, n in found.items():
                    if len(word) >= shortest:  # a run only ever gets shorter
                        word = damaged(doc_id, word)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > HELD:
                    yield rows()
        yield rows()

    counted = only(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def keys(word: Column) -> Column:
    """A word and its distinct single deletions."""
    places = F.sequence(F.lit(1), F.length(word))
    rest = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), rest))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair at distance one."""
    keyed = words.select("word", "n", F.explode(keys(F.col("word"))).alias("key"))
    left, right = keyed, keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = left.join(right, "key").where("word <> near")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) for the words (word, n)."""
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("enough", -F.col("best.least") >= COMMONER * F.col("n"))
    return rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("enough"), F.col("best.near")).alias("form"),
        F.when(F.col("enough"), -F.col("best.least")).alias("form_n"),
    )


def roots(linked: DataFrame) -> DataFrame:
    """(word, root): the last word that forms lead to, by pointer doubling over (word, form)."""
    at = stash(linked.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = at.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not ahead.join(at.where("root <> word").select("root").distinct(), "root", "left_semi").take(1):  # no pointer's target points on
            return at
        at = stash(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = stash(word_counts(docs), "spelling-words")
    linked = stash(forms(words), "spelling-forms")
    return linked.join(roots(linked), "word").select("word", "form", "root", "n", "n_near", "form_n")
