"""Byte-level BPE through sentencepiece.

A vocabulary of byte strings with ranks is serialised directly as a sentencepiece BPE model: every byte stands for one
character, a piece's score is its negative rank, and normalisation does nothing. Merging the pair with the best score is
then merging the pair of lowest rank, as rank-based byte-level BPE does. Each match of the split pattern is
encoded by itself; a match that is a piece as a whole is that piece. Ids are decoded by the inverse mapping.

Cases: null and empty texts have no ids and decode to nothing. Whole texts are encoded, however long. Repeated rows and rows without an id
are encoded alike. Of two pairs of one rank the left one merges first, as everywhere. Which characters are letters, numbers and white space
is asked of the library whose ids these are. Empty tables give empty results. Columns that are called like the result's are ignored by
``encode_documents`` and kept by ``encode_column``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.frames import append_columns, fresh, only
from rankloom.llm.pretokens import PackedEncoder, tiktoken_members

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Byte b is written as this code point plus b: letters that no normaliser or white-space rule touches.
FIRST_CHARACTER = 0x100
#: Pre-tokens of one generation; smaller than elsewhere, since other operators share the worker in a pipeline.
CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_ranks(path: str | None = None) -> list[bytes]:
    """Pieces of a rank file in rank order; ranks must run from 0 without gaps."""
    with open(path or default_path(), "rb") as f:
        rows = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks have gaps")
    return [p for _, p in rows]


def _varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(piece: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + b) for b in piece)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece comes last."""
    unknown, bpe = len(pieces), 2
    body = b"".join(_field(1, _field(1, mapped(p).encode()) + _field(2, -float(k))) for k, p in enumerate(pieces))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[bytes]):
        import sentencepiece

        self.pieces = pieces
        self.whole = {p: k for k, p in enumerate(pieces)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
        self.table = {b: FIRST_CHARACTER + b for b in range(256)}
        self.encoder = PackedEncoder(self.encode_part, tiktoken_members, CACHE)

    def encode_part(self, part: str) -> list[int]:
        raw = part.encode("utf-8", "replace")
        if raw in self.whole:
            return [self.whole[raw]]
        return self.model.encode(raw.decode("latin-1").translate(self.table))

    def encode(self, text: str | None) -> bytes:
        return self.encoder(text)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def worker_bpe(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, kept by a Python worker between its tasks. The file is on every machine."""
    return ByteBpe(load_ranks(path))


def encode_column(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and on demand ids, and the names these columns got."""
    names = fresh(docs, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
    path = path or default_path()

    def compute(lists: Iterator[list]) -> Iterator[list[pa.Array]]:
        bpe = worker_bpe(path)
        for texts in lists:
            rows, held = [], []
            for text in texts:
                packed = bpe.encode(text)
                held += [packed] * with_ids
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(columns[0])]).astype(np.int32), np.frombuffer(b"".join(held), "<i4")))
            yield arrays

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]
    fields = [T.StructField(n, t) for n, t in zip(names, kinds, strict=False)]
    return append_columns(docs, "text", fields, compute), names


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_column(only(docs, "doc_id", "text"), path)[0].drop("text")
