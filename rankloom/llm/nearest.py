"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt into blocks by a hash of their id. A block holds one sorted array of values per Gaussian projection. Around
a query's value in each array a window widens step by step (virtual rehashing: the windows of a wider
radius contain those of a narrower one); a vector collides in an array when it lies in the window. Vectors with enough
collisions are verified by exact cosine. The search of a block ends when any vector nearer than the worst of the best
``k`` found would by now have collided in most arrays, or when the windows hold everything. The best of all blocks are
merged per query, so every row is indexed and nothing is capped.

One block is searched first, from the narrowest window. Its k-th best cosine bounds what a neighbour of the query in any other
block must reach, so there the windows start at the width that this bound asks for, and mostly one step is enough.

Blocks and query blocks form a grid; a cell is one task's work of bounded size. With a fixed share of the rows as queries the work grows
with the square of the table (README has figures).

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors meet only vectors
of their length. A query never meets rows with its own id. Equal scores go to the smaller id. With fewer than ``k``
candidates all are returned. Repeated rows of one id are separate candidates, but one query: rows of a query id with different
vectors give the best of all of them, each candidate row once. Rows without an id take no part. Empty tables give empty results. Columns
that are called like the result's are ignored. Very long vectors are held whole; a block's memory grows with their length.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.storage import small_batches, stash

PROJECTIONS = 48
#: Share of the arrays in which a vector must collide to be verified.
COLLISIONS = 0.65
#: A block's search ends when a vector as far as the k-th best collides with at least this chance.
CERTAIN = 0.85
FIRST_WIDTH, WIDEN = 0.35, 1.35
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 1024
QUERY_MODULUS = 50
NEAREST = 5


class CollisionIndex:
    """Sorted projections of a block of unit vectors."""

    def __init__(self, unit: np.ndarray, projections: int = PROJECTIONS, seed: int = 11):
        self.directions = np.random.default_rng(seed).standard_normal((unit.shape[1], projections))
        values = unit @ self.directions
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(values.T, self.order, 1)
        self.size, self.projections = len(unit), projections

    def start(self, unit_queries: np.ndarray) -> None:
        """Begin a search: every query's windows are empty, at its place in each array."""
        self.places = unit_queries @ self.directions
        self.low = np.column_stack([np.searchsorted(v, p) for v, p in zip(self.values, self.places.T, strict=True)])
        self.high = self.low.copy()
        self.counts = np.zeros((len(unit_queries), self.size), np.int16)
        self.done = np.zeros((len(unit_queries), self.size), bool)

    def widen(self, active: np.ndarray, wide: np.ndarray):
        """Windows of the active queries grow to their half widths; yields (query, vectors that now collide often enough)."""
        enough, width = math.ceil(COLLISIONS * self.projections), wide[active]
        low = np.column_stack([np.searchsorted(v, p - width, "left") for v, p in zip(self.values, self.places[active].T, strict=True)])
        high = np.column_stack([np.searchsorted(v, p + width, "right") for v, p in zip(self.values, self.places[active].T, strict=True)])
        for k, q in enumerate(active):
            if 2 * int((high[k] - low[k]).sum()) > self.size * self.projections:  # fewer lie outside: count those
                outside = [o[:a] for o, a in zip(self.order, low[k], strict=True)] + [o[b:] for o, b in zip(self.order, high[k], strict=True)]
                self.counts[q] = self.projections - np.bincount(np.concatenate(outside), minlength=self.size)
            else:
                ring = [o[a:b] for o, a, b in zip(self.order, low[k], self.low[q], strict=True)] + [o[a:b] for o, a, b in zip(self.order, self.high[q], high[k], strict=True)]
                self.counts[q] += np.bincount(np.concatenate(ring), minlength=self.size).astype(np.int16)
            found = np.flatnonzero((self.counts[q] >= enough) & ~self.done[q])
            self.done[q, found] = True
            yield q, found
        self.low[active], self.high[active] = low, high


def cosine(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, query_length: float) -> np.ndarray:
    """Cosines of rows with a query in double precision, components added in order; equal rows give equal values."""
    return running_sum(rows * query) / (lengths * query_length)


def running_sum(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, components added one after another, as a loop adds them."""
    return np.add.accumulate(rows, 1)[:, -1]


def width_for(distance: float) -> float:
    """The half width at which a vector at that distance collides with the chance that ends a search."""
    return NormalDist().inv_cdf((1 + CERTAIN) / 2) * distance


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of a block for each query: (query id, vector id, cosine).

    Rows of one query id are its versions, and a vector counts once for all of them. ``bounds`` are cosines that a neighbour must
    reach to matter, or -inf.
    """
    lengths, query_lengths = np.sqrt(running_sum(vectors * vectors)), np.sqrt(running_sum(queries * queries))
    unit, unit_queries = vectors / lengths[:, None], queries / query_lengths[:, None]
    index = CollisionIndex(unit)
    index.start(unit_queries)
    best = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
    wide = np.array([width_for(math.sqrt(max(2 - 2 * b, 1e-12))) if b > -1 else FIRST_WIDTH for b in bounds.tolist()])
    active = np.arange(len(queries))
    while len(active):
        going = []
        for q, found in index.widen(active, wide):
            scores, rows = best[q]
            found = found[ids[found] != query_ids[q]]
            if len(found) > 4 * k:  # by a fast product first, which is off by far less than the margin
                rough = unit[found] @ unit_queries[q]
                found = found[rough >= max(np.partition(rough, -k)[-k], bounds[q]) - 1e-9]
            if len(found):
                scores = np.concatenate([scores, cosine(vectors[found], lengths[found], queries[q], query_lengths[q])])
                rows = np.concatenate([rows, found])
                first = np.lexsort((ids[rows], -scores))[:k]
                best[q] = scores, rows = scores[first], rows[first]
            worst = max(scores[-1] if len(scores) == k else -math.inf, bounds[q])
            distance = math.sqrt(max(2 - 2 * worst, 1e-12)) if worst > -1 else math.inf
            if wide[q] < width_for(distance) * (1 - 1e-9) and not index.done[q].all():
                going.append(q)
        active = np.array(going, np.int64)
        wide[active] *= WIDEN
    merged: dict[int, dict[int, float]] = {}
    for q, (scores, rows) in enumerate(best):
        mine = merged.setdefault(int(query_ids[q]), {})
        for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
            mine[row] = max(score, mine.get(row, -math.inf))
    out = []
    for query, mine in merged.items():
        out += [(query, i, score) for i, score in sorted(((int(ids[r]), x) for r, x in mine.items()), key=lambda h: (-h[1], h[0]))[:k]]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles scaled by the largest component) and dim of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(vectors["vec_id"], vectors["embedding"]).where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # cosine does not change with scale, but squares of extreme components would overflow or vanish: only those are scaled
    rows = rows.withColumn("top", F.array_max(F.transform("vector", lambda x: F.abs(x)))).where("top > 0")
    extreme = (F.col("top") > 1e100) | (F.col("top") < 1e-100)
    return rows.select("vec_id", F.when(extreme, F.transform("vector", lambda x: x / F.col("top"))).otherwise(F.col("vector")).alias("vector"), F.size("vector").alias("dim"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.empty((0, dim))


def nearest(vectors: DataFrame, k: int = NEAREST, modulus: int = QUERY_MODULUS) -> DataFrame:
    """For every vector whose id ``modulus`` divides: query_id, rank (from 1), vec_id, score of its k nearest."""
    small_batches(vectors.sparkSession)
    rows = stash(usable(vectors), "vectors")
    is_query = (F.col("vec_id") % modulus) == 0
    n, q = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-q // BLOCK_QUERIES))
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), F.lit(parts)).cast("int")
    block = deal("data", blocks)
    asked = rows.where(is_query).dropDuplicates(["vec_id", "vector"])

    def cell(group: pa.Table) -> pa.Table:
        flag = group.column("is_query").to_numpy(zero_copy_only=False)
        matrix, ids, bounds = _matrix(group.column("vector"), group["dim"][0].as_py()), group.column("vec_id").to_numpy(), group.column("bound").to_numpy()
        found = search_block(matrix[~flag], ids[~flag], matrix[flag], ids[flag], bounds[flag], k) if flag.any() and not flag.all() else []
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    def search(data: DataFrame, with_blocks: DataFrame) -> DataFrame:
        data = data.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("queries"), F.lit(False).alias("is_query"), "vec_id", "vector", F.lit(-math.inf).alias("bound"))
        cells = data.unionByName(with_blocks).groupBy("dim", "block", "queries")
        return stash(cells.applyInArrow(cell, "query_id long, vec_id long, score double"), "hits")

    ask = lambda df, at, bound: df.select("dim", at.alias("block"), deal("query", query_blocks).alias("queries"), F.lit(True).alias("is_query"), "vec_id", "vector", bound.alias("bound"))
    found = search(rows.where(block == 0), ask(asked, F.lit(0), F.lit(-math.inf)))
    if blocks > 1:
        bounds = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
        bound = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-math.inf))
        found = found.unionByName(search(rows.where(block > 0), ask(asked.join(bounds, "vec_id", "left"), F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))), bound)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
