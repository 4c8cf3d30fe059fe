"""Token counts by a separator scan of flat token files.

A flat file is nothing but 16- or 32-bit ids, documents divided by an end-of-document id, with no index. It is cut into
blocks of equal size that are read and searched for the separator independently, by array comparison. A document may
span blocks: a prefix scan over the blocks of a file (the last separator so far, the number of separators so far)
joins the ends of one block to the starts of the next. Starts and places count from 0 in each file.

Cases: tokens after a file's last separator are a document without an end. Two separators in a row enclose an empty
document. An empty file has none. Null and empty texts are empty documents; very long ones span as many blocks as they need. Repeated
rows, and rows without an id, are counted each. Ids that do not fit the width are refused. Empty tables give empty results. Columns that are
called like the result's are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.frames import only
from rankloom.llm.pretokens import tokenizers_encoder
from rankloom.llm.shared_files import put, read_range
from rankloom.llm.storage import scratch, small_batches, stash

VOCABULARY = "byte_bpe_50k.json"
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 23


def write_flat(docs: DataFrame, folder: str, path: str, separator: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """Write ids of all documents, each followed by the separator, as flat files of ``width``-byte integers.

    Returns doc_id, file, place and file_bytes: which document of which file a row became (the files do not tell).
    """
    small_batches(docs.sparkSession)
    end = np.array([separator], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, number = TaskContext.get().partitionId(), None, 0
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            name, n = f"part-{part:06d}-{number:06d}.bin", len(ids)
            put(folder, name, held)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array([size] * n, pa.int64())], names=["doc_id", "file", "place", "file_bytes"])
            number, size = number + 1, 0
            ids.clear()
            held.clear()
            return out

        for b in batches:
            encoder = encoder or tokenizers_encoder(path, ordinary=True)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                found = np.frombuffer(encoder(text), "<u4")
                if width < 4 and len(found) and found.max() >= 1 << 8 * width:
                    raise ValueError(f"an id does not fit {width} bytes")
                held.append(found.astype(f"<u{width}").tobytes() + end)
                size += len(held[-1])
                if size >= width * FILE_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return stash(only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, file string, place long, file_bytes long"), "flat-order")


def scan(files: DataFrame, folder: str, separator: int = END_OF_DOCUMENT, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat files (file, file_bytes): file, place, start, n_tokens (separator not counted), from 0 in each file."""
    blocks = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("file_bytes") - 1), F.lit(width * block).cast("long"))))
    blocks = blocks.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, size, first in zip(*(b.column(c).to_pylist() for c in ("file", "file_bytes", "first")), strict=True):
                ids = np.frombuffer(read_range(folder, name, first, min(width * block, size - first)), f"<u{width}") if size else np.empty(0, np.uint16)
                at = np.flatnonzero(ids == separator) + first // width
                rows.append((name, size // width, first // width, at, int(at[-1]) if len(at) else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32), pa.array(np.concatenate([r[3] for r in rows] or [np.empty(0, np.int64)]), pa.int64())), pa.array([r[4] for r in rows], pa.int64())],
                names=["file", "total", "first", "ends", "last_end"],
            )

    found = stash(blocks.select("file", "file_bytes", "first").mapInArrow(run, "file string, total long, first long, ends array<long>, last_end long"), "separators")
    earlier = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a file has few blocks
    found = found.withColumn("open", F.coalesce(F.max("last_end").over(earlier) + 1, F.lit(0))).withColumn("before", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)))
    # a document's start is the previous separator plus one: in the block, or the one that the scan carries in
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    whole = found.select("file", "before", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("ends")).alias("s"), F.col("ends").alias("e"))).alias("k", "d"))
    whole = whole.select("file", (F.col("before") + F.col("k")).alias("place"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"))
    file_end = found.groupBy("file").agg(F.max("total").alias("total"), F.coalesce(F.max("last_end") + 1, F.lit(0)).alias("start"), F.sum(F.size("ends")).alias("place"))
    tail = file_end.where("start < total").select("file", "place", "start", (F.col("total") - F.col("start")).alias("n_tokens"))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents as flat token files and count by scanning them: doc_id, file, place, start, n_tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    folder = scratch(docs.sparkSession, "flat-tokens")
    order = write_flat(docs, folder, path)
    counts = scan(order.groupBy("file").agg(F.max("file_bytes").alias("file_bytes")), folder)
    return order.select("doc_id", "file", "place").join(counts.hint("shuffle_hash"), ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
