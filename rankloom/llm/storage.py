"""Scratch tables in the shared checkpoint folder, and exact sums of fixed-size vectors over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.context import materialise, scratch  # noqa: F401

#: Rows of an Arrow batch: texts can be long, so batches stay shorter than Spark's 10,000.
BATCH_ROWS = 1000

#: Write a table to the shared folder and read it again: a cut of the lineage that survives lost executors.
stash = materialise


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches of texts short, unless someone has set their size.

    The setting counts when a plan runs, so it has to outlast the call that makes the plan.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


_VECTOR = "level int, task long, chunk int, counts binary"
_CHUNK = 1 << 16
_FAN_IN = 128


def _vector_rows(task: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    chunks = [total[k : k + _CHUNK] for k in range(0, len(total), _CHUNK)]
    packed = [zlib.compress(c.astype("<i8").tobytes(), 1) for c in chunks]
    yield pa.RecordBatch.from_arrays(
        [pa.array([0] * len(chunks), pa.int32()), pa.array([task] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array(packed, pa.binary())],
        names=["level", "task", "chunk", "counts"],
    )


def _merge(rows: pa.Table) -> pa.Table:
    total = None
    for packed in rows.column("counts"):
        part = np.frombuffer(zlib.decompress(packed.as_py()), "<i8")
        total = part.copy() if total is None else total + part
    keep = rows.slice(0, 1)
    return pa.table({"level": keep["level"], "task": pa.array([keep["task"][0].as_py() // _FAN_IN], pa.int64()), "chunk": keep["chunk"], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def sum_vectors(df: DataFrame, size: int, add: Callable[[np.ndarray, Iterable[pa.RecordBatch]], None]) -> np.ndarray:
    """Sum over all partitions of a vector of ``size`` counts that ``add`` fills from a partition's batches.

    Every task sends its vector in chunks; chunks meet in a tree of fan-in 128, so no task and not the driver
    holds more than a bounded number of them. The driver receives one vector, whose size is a parameter.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        add(total, batches)
        yield from _vector_rows(TaskContext.get().partitionId(), total)

    parts = df.mapInArrow(per_task, _VECTOR)
    rows = stash(parts, "vectors")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > _FAN_IN:
        rows = stash(rows.groupBy((F.col("task") / _FAN_IN).cast("long").alias("up"), "chunk").applyInArrow(_merge, _VECTOR), "vectors")
        tasks = -(-tasks // _FAN_IN)
    total = np.zeros(size, np.int64)
    for r in rows.select("chunk", "counts").toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(r.counts)), "<i8")
        total[r.chunk * _CHUNK : r.chunk * _CHUNK + len(part)] += part
    return total
