"""How five filters share the work of removing documents: every order's steps and each filter's Shapley value.

A document's failures are a mask of five bits, so a part of the corpus is 32 counts and everything else is algebra. With
``x_i`` the chance that filter i is applied, the documents removed are a multilinear polynomial

    f(x) = sum over masks m of n_m * (1 - prod over i in m of (1 - x_i)) = sum over sets S of a_S * prod over i in S of x_i

with ``a_S = (-1)^(|S|+1) * (documents that fail all of S)``. Its corners are what a set of filters removes, so an order's
survivors are corners along its path; the integral of its i-th partial derivative along the diagonal is filter i's Shapley
value, a rational number that is kept exact (``fractions``) and scaled by 120, the number of orders.

Only masks, digests, ids, parts and two label bits leave the scan, never texts. Failure E (the text of a smaller id) is
decided by counts over SHA-256 digests, in three aggregations that combine before they shuffle: a group of copies of any
size is a few rows per task, and no row is joined to its group.

Cases. A null text is empty: it fails A alone, of A to D (0 of 0 words distinct is not under half). A null id is not smaller than
any other and none is smaller than it: such rows never fail E and make no other row fail; they have no label. Rows that repeat
an id with one text do not fail E on account of each other. Repeated label rows count as one, 1 where any of them says 1. A null
``lang`` is the part ''. Empty tables give no rows. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.frames import only

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
FEWEST_WORDS = 200
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"

_OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def own_failures(text: Column) -> Column:
    """Failures A to D of a text as bits 1, 2, 4, 8."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, size = F.size(words), F.length(text)
    upper = size - F.length(F.translate(text, UPPER, ""))
    tests = [n < FEWEST_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * upper > 3 * size, F.regexp_like(text, F.lit(SYMBOLS))]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text", "lang").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"), F.sha2(text, 256).alias("digest")
    )
    # rows without an id meet no label; their key spreads them
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.xxhash64("digest", F.monotonically_increasing_id()).cast("string")))
    marks = only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.withColumn("key", key).join(marks, "key", "left").drop("key").na.fill(0, ["good", "toxic"])
    same = ["digest", "own", "part", "good", "toxic"]
    # copies by id, then the least id of each kind of copy and how many rows carry it, then the least of all kinds
    by_id = rows.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    no_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = by_id.groupBy(*same).agg(F.sum("n").alias("n"), no_id.alias("no_id"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    spared = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    kinds = kinds.withColumn("first", first).withColumn("spared", spared)
    split = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("spared").alias("m")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("m"))))
    cells = kinds.select("part", "good", "toxic", split.alias("s")).select("part", "s.mask", F.col("s.m").alias("n"), (F.col("good") * F.col("s.m")).alias("good"), (F.col("toxic") * F.col("s.m")).alias("toxic"))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def removal_polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficients a_S of the documents removed, by the set S as a mask."""
    terms = [0] * (1 << filters)
    for m, n in counts.items():
        s = m
        while s:  # all sets within m
            terms[s] += n if s.bit_count() % 2 else -n
            s = (s - 1) & m
    return terms


def corner(terms: list[int], applied: int) -> int:
    """The polynomial where the filters of ``applied`` are certain and the others are off."""
    return sum(a for s, a in enumerate(terms) if s & ~applied == 0)


def diagonal_integral(terms: list[int], i: int) -> Fraction:
    """Integral over t from 0 to 1 of the i-th partial derivative at (t, ..., t)."""
    return sum((Fraction(a, s.bit_count()) for s, a in enumerate(terms) if s >> i & 1), Fraction(0))


def order_rows(part: str, cells: list[dict], filters: str = FILTERS) -> Iterator[tuple]:
    """One row per order of the filters and step."""
    k = len(filters)
    n, good, toxic = (removal_polynomial({c["mask"]: c[x] for c in cells}, k) for x in ("n", "good", "toxic"))
    total, whole = sum(c["n"] for c in cells), (1 << k) - 1
    at = [[corner(t, s) for s in range(1 << k)] for t in (n, good, toxic)]
    orders = list(permutations(range(k)))
    shapley = [diagonal_integral(n, i) * len(orders) for i in range(k)]
    for order in orders:
        applied = 0
        for step, i in enumerate(order, 1):
            before, applied = applied, applied | 1 << i
            removed, lost, bad = (v[applied] - v[before] for v in at)
            yield (
                part, "".join(filters[j] for j in order), step, total - at[0][applied], removed, at[0][1 << i] - removed, at[0][whole] - at[0][whole & ~(1 << i)],
                lost, bad, int(shapley[i]),
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders and steps of every part; see the module's text for the cases."""
    cells = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                columns = zip(*order_rows(row["part"], row["cells"]), strict=True)
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    return cells.mapInArrow(run, _OUT)
