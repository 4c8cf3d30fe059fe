"""Token-id files with directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 1 holds the first chunk of every id and a bitmap that says
whether the id goes on; level 2 holds the second chunks of those that do, with a bitmap of its own, and so on. A rank
directory counts the set bits before every block of 512, so the place of an id's next chunk is one directory entry
and the bits of one block: any token is read without decoding its neighbours. A run of tokens, such as a document, is one slice of
each level, which the directories locate; ``StoredTokens`` reads single tokens from a stored file by byte ranges.

File: magic, number of documents, tokens and levels; per level its size, chunks, bitmap and directory; then
the documents' ids and ends. All numbers are little-endian. A file holds at most about ``FILE_TOKENS`` ids.

Cases: null and empty texts give the end id alone. Documents with the same id follow each other, by a hash of
their text and the text; a null id sorts first. The strings of special tokens get their ids, as the library gives them. Repeated rows are documents each. Empty tables give empty results. Very long texts are one document of a file of their own size.
Columns that are called like the result's are ignored.
"""

from __future__ import annotations

import zlib
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
END_ID = 2
FILE_TOKENS = 1 << 22
RANK_BITS = 512
#: Bytes of the table (as estimated) of a range of ids that one task writes; most tasks that read.
PARTITION_BYTES = 256 << 20
MOST_PARTITIONS = 200_000
MAGIC = b"RLDAC001"


def encode_file(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file; ``doc_ids`` as 64-bit integers, ``ends`` the running number of ids at each document's end."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append((np.array([len(rest)], "<u8"), (rest & 255).astype(np.uint8), bits, rank))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = MAGIC + np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()
    return [head, *(a.tobytes() for level in levels for a in level), doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes()]


class TokenFile:
    """A file's arrays, as views of its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.n_docs, self.n_tokens, n_levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at, self.levels = 32, []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + n)
            at += 8 + n + len(bits)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u8", blocks + 1, at)))
            at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)

    def rank(self, level: int, k: int) -> int:
        """Number of ids that go on before place ``k`` of a level: one directory entry and one block of bits."""
        _, bits, rank = self.levels[level]
        block = k // RANK_BITS
        inside = bits[block * RANK_BITS // 8 : k >> 3]
        rest = int(bits[k >> 3] & ((1 << (k & 7)) - 1)).bit_count() if k & 7 else 0
        return int(rank[block]) + int(np.bitwise_count(inside).sum()) + rest

    def token(self, k: int) -> int:
        """The id at place ``k``."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[k]) << (8 * level)
            if not bits[k >> 3] >> (k & 7) & 1:
                return value
            k = self.rank(level, k)
        raise ValueError("id without an end")

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` to before ``end``, from the slices of the levels that hold them."""
        value, places = np.zeros(end - start, np.uint32), np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            value[places] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + end - start].astype(bool)
            places = places[more]
            if not len(places):
                break
            start = self.rank(level, start)
            end = start + len(places)
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        return self.ids(0, self.n_tokens)


class StoredTokens:
    """A stored file of which only the byte ranges that a token needs are read."""

    def __init__(self, uri: str, name: str):
        self.uri, self.name = uri, name
        head = self._read(0, 32)
        if head[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.n_docs, self.n_tokens, n_levels = (int(x) for x in np.frombuffer(head, "<u8", 3, 8))
        at, self.levels = 32, []  # size, and first bytes of chunks, bitmap and directory
        for _ in range(n_levels):
            n = int.from_bytes(self._read(at, 8), "little")
            blocks = -(-n // RANK_BITS)
            self.levels.append((n, at + 8, at + 8 + n, at + 8 + n + blocks * RANK_BITS // 8))
            at = self.levels[-1][3] + 8 * (blocks + 1)

    def _read(self, start: int, length: int) -> bytes:
        return read_range(self.uri, self.name, start, length)

    def token(self, k: int) -> int:
        """The id at place ``k``: of every level a chunk, a block of bits and a directory entry."""
        value = 0
        for shift, (_, chunks, bitmap, directory) in enumerate(self.levels):
            value |= self._read(chunks + k, 1)[0] << (8 * shift)
            block, inside = divmod(k, RANK_BITS)
            bits = int.from_bytes(self._read(bitmap + block * RANK_BITS // 8, RANK_BITS // 8), "little")
            if not bits >> inside & 1:
                return value
            k = int.from_bytes(self._read(directory + 8 * block, 8), "little") + (bits & ((1 << inside) - 1)).bit_count()
        raise ValueError("id without an end")


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending id order; returns part, number, name, n_docs, n_tokens, has_ids of the files.

    Documents without an id are in files of their own, whose has_ids is false.
    """
    small_batches(docs.sparkSession)
    # as many ranges as the session's setting, or more for tables that would overfill them; tables of unknown size get the setting
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = MOST_PARTITIONS * PARTITION_BYTES
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES) if size <= most else 0)
    # rows of one id, or of none, are dealt out by a hash of their text; ties by text, so that every attempt of a task writes the same file
    tie = F.xxhash64("text")
    ordered = only(docs, "doc_id", "text").repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), None
        held_ids, held, number, rows = [], [], 0, []

        def flush() -> None:
            nonlocal number, size
            ids = np.frombuffer(b"".join(held), "<u4")
            name = f"part-{part:06d}-{number:06d}.dac"
            put(folder, name, encode_file(np.array([0 if d is None else d for d in held_ids], np.int64), np.cumsum([len(b) // 4 for b in held]), ids))
            rows.append((part, number, name, len(held), len(ids), held_ids[0] is not None))
            number += 1
            size = 0
            held_ids.clear()
            held.clear()

        size = 0
        for b in batches:
            encoder = encoder or tokenizers_encoder(path)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packed = encoder(text) + end
                if held and (size + len(packed) > 4 * FILE_TOKENS or (held_ids[-1] is None) != (doc_id is None)):
                    flush()
                held_ids.append(doc_id)
                held.append(packed)
                size += len(packed)
        if held:
            flush()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names=["part", "number", "name", "n_docs", "n_tokens", "has_ids"])

    return stash(ordered.mapInArrow(run, "part long, number long, name string, n_docs long, n_tokens long, has_ids boolean"), "files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. Files follow each other by part and number."""
    # a running sum over the parts, which are as many as tasks wrote, and one over the files of each
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    listed = files.withColumn("inside", inside).join(parts, "part").select("name", (F.col("before") + F.col("inside")).alias("first"), "has_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, has_ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = TokenFile(read_range(folder, name))
                begins = np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(f.ids(a, e).astype("<u4").tobytes()) for a, e in zip(begins.tolist(), f.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64(), mask=np.full(f.n_docs, not has_ids)), pa.array(begins + first, pa.int64()), pa.array(f.ends - begins, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = listed.repartition(max(1, min(files.count(), MOST_PARTITIONS)), "name")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' ids in the file format and read the files back: one row per document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    folder = scratch(docs.sparkSession, "token-ids")
    return read_files(write_files(docs, folder, path), folder)
