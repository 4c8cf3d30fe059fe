"""Exact substring deduplication: bytes inside a string of fixed length that a document with a smaller id holds too.

*Blocks.* Documents are packed where they are read into blocks of a few megabytes, which are written to the shared folder once; texts
are never shuffled. *Anchors.* In every window of the length, the k-gram of least hash is chosen (leftmost by position of its equals:
all of them). Equal windows choose the same k-gram at the same place, so only anchors whose k-gram is in two documents can matter:
blocks send the sorted hashes of their k-grams, cut by range, and get back one bit for each.
*Suffixes.* Around an anchor that is left, the suffix from the anchor on and the reversed prefix before it, both only as far as
windows over the anchor reach, hold all its windows. A block sends each distinct pair once, with its least document. Buckets of pairs
are sorted twice (``deep_shallow``: multikey quicksort, then blind tries where prefixes are long), by suffix and by reversed prefix;
with the lengths that neighbours share, the windows at every place of the anchor fall into classes of equal strings, and the least
document of a class tells who comes later. Hashes choose and deal; equality is decided by the sorted bytes alone.

*Skew.* A string in a third of all documents is one pair of each block. Where a k-gram is frequent (``Sizes.hot`` occurrences) its pairs
may be many and different, beside a common passage; its windows are then sent one by one, each distinct window of a block once, dealt
by a hash of the window, so that no key has more rows than there are blocks. A bucket's, a range's and a block's size is bounded.

Executors may be lost: everything a later job needs is in the shared folder. A partition must give its rows in the same order when it is
read again, as it does from files.

Cases. A null text is empty. A row without an id loses nothing and is no source for others. Rows of one id do not count against each
other, with equal or different texts. Texts shorter than the length lose nothing. Very long texts are a block of their own, whose anchors are found
piece by piece. Empty tables give no rows. Ties of hashes keep all their anchors. Extra columns are not looked at.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.context import scratch
from rankloom.llm import deep_shallow
from rankloom.llm.frames import only
from rankloom.llm.shared_files import put, read_range
from rankloom.llm.storage import small_batches, stash
from rankloom.llm.textcore import mix64

LENGTH = 50


@dataclass(frozen=True)
class Sizes:
    """How work is cut; results do not depend on it."""

    block_bytes: int = 4 << 20
    #: Window starts whose anchors are found at a time.
    piece: int = 1 << 18
    #: Bytes of text behind one range of k-gram hashes.
    range_bytes: int = 8 << 20
    #: K-grams of two documents behind one bucket of suffixes.
    bucket_grams: int = 50_000
    #: A k-gram with so many occurrences sends its windows one by one.
    hot: int = 20_000


#: Tasks that blocks, or buckets, are dealt to at most.
MOST_TASKS = 20_000
_BASE = 0x9E3779B97F4A7C15


class Shape:
    """Sizes that follow from the length: k-gram, places of an anchor in a window, padded widths of the two sides of an anchor."""

    def __init__(self, length: int, sizes: Sizes):
        self.length, self.sizes = length, sizes
        self.gram = max(4, length * 2 // 5, length - 62)
        self.places = length - self.gram + 1  # at most 63: one bit each
        self.before = self.places - 1
        # one byte more, for the side's own length, in whole words
        self.left, self.right = (-(-(n + 1) // deep_shallow.WORD) * deep_shallow.WORD for n in (self.before, length))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes, by doubling."""
    power, size = data.astype(np.uint64) + np.uint64(1), 1
    found, done, left = None, 0, k
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                if found is None:
                    found = power
                else:
                    n = len(data) - done - size + 1
                    found = found[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + n]
                done += size
            left >>= 1
            if not left:
                return mix64(found)
            n = len(data) - 2 * size + 1
            power = power[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size : size + n]
            size *= 2


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, open_: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-grams that are least in a window; ``open_`` marks the window starts that count."""
    found_at, found = [], []
    piece = shape.sizes.piece
    for a in range(0, len(open_), piece):
        b = min(a + piece, len(open_))
        if not open_[a:b].any():
            continue
        hashes = gram_hashes(data[a : b + shape.length - 1], shape.gram)
        least = np.where(open_[a:b], _sliding(hashes, shape.places, np.minimum), np.uint64(0))
        wide = np.zeros(len(least) + 2 * shape.before, np.uint64)
        wide[shape.before : shape.before + len(least)] = least
        chosen = np.flatnonzero(_sliding(wide, shape.places, np.maximum) == hashes)
        found_at.append(chosen + a)
        found.append(hashes[chosen])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, hashes = np.concatenate(found_at), np.concatenate(found)
    at, first = np.unique(at, return_index=True)  # pieces overlap
    return at, hashes[first]


class Block:
    """Documents of one block: ids as Arrow, their bytes in one array, bounds, and ranks of the ids (-1: none)."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        self.ids = ids
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(texts) else np.empty(0, np.uint8)
        self.bounds = (offsets - offsets[0]).astype(np.int64)
        coded = ids.dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[np.asarray(pc.array_sort_indices(coded.dictionary))] = np.arange(len(rank))
        self.rank = np.where(np.asarray(ids.is_null()), -1, rank[np.asarray(coded.indices.fill_null(0))] if len(rank) else -1)

    def open_starts(self, length: int) -> np.ndarray:
        """Which window starts lie, to their end, in one document with an id."""
        found = np.zeros(max(len(self.data) - length + 1, 0), bool)
        for a, b, rank in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), self.rank.tolist(), strict=True):
            if rank >= 0 and b - a >= length:
                found[a : b - length + 1] = True
        return found

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1


def _pack(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def _unpack(folder: str, name: str) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(read_range(folder, name))).read_all()


def _load(folder: str, name: str) -> Block:
    rows = _unpack(folder, name).combine_chunks()
    one = [rows.column(c).chunk(0) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("id", "text")]
    return Block(*one)


def _grams(block: Block, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors' places and k-gram numbers; each k-gram's hash, occurrences and whether two ids of the block have it."""
    at, hashes = anchors(block.data, block.open_starts(shape.length), shape)
    grams, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = block.rank[block.document(at)]
    low, high = np.full(len(grams), len(block.rank)), np.full(len(grams), -1)
    np.minimum.at(low, number, rank)
    np.maximum.at(high, number, rank)
    return at, number, grams, times, low < high


_RANGES = "part long, block string, grams binary, times binary, shared binary"


def write_blocks(docs: DataFrame, folder: str, parts: int, shape: Shape) -> DataFrame:
    """Write the blocks and give, per block and range of hashes, its k-grams, their occurrences (at most 65,535) and the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            table = pa.Table.from_batches(held).combine_chunks()
            packed = _pack(table)
            name = f"block-{task}-{number}-{zlib.crc32(packed):08x}"
            put(folder, name, [packed])
            block = Block(table.column("id").chunk(0), table.column("text").chunk(0))
            held.clear()
            size, number = 0, number + 1
            _, _, grams, times, shared = _grams(block, shape)
            part = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.array([0, 0])
            rows = [(int(part[a]) if b > a else zlib.crc32(name.encode()) % parts, grams[a:b], times[a:b], shared[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([name] * len(rows)), pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([np.minimum(r[2], 65535).astype(np.uint16).tobytes() for r in rows], pa.binary()), pa.array([np.packbits(r[3]).tobytes() for r in rows], pa.binary()),
                ],
                names=["part", "block", "grams", "times", "shared"],
            )

        for b in batches:
            texts = pc.fill_null(b.column(1), "").cast(pa.binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
            start = 0
            for k, n in enumerate(sizes.tolist()):
                size += n
                if size >= shape.sizes.block_bytes:
                    held.append(pa.RecordBatch.from_arrays([b.column(0).slice(start, k + 1 - start), texts.slice(start, k + 1 - start)], names=["id", "text"]))
                    start = k + 1
                    yield flush()
            if start < b.num_rows:
                held.append(pa.RecordBatch.from_arrays([b.column(0).slice(start), texts.slice(start)], names=["id", "text"]))
        if held:
            yield flush()

    return docs.mapInArrow(run, _RANGES)


def _judge(rows: pa.Table, often: int) -> pa.Table:
    """One range of hashes: which k-grams of each block are in two documents, and which are frequent."""
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("grams")]
    sizes = [len(x) for x in lists]
    grams = np.concatenate(lists)
    times = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rows.column("times")]).astype(np.int64)
    own = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(rows.column("shared"), sizes, strict=True)])
    _, number, blocks = np.unique(grams, return_inverse=True, return_counts=True)
    hot = np.bincount(number, times, len(blocks)) >= often
    alike, frequent = own | (blocks > 1)[number], hot[number] if len(grams) else own
    cuts = np.cumsum([0, *sizes])
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table({
        "block": rows.column("block").combine_chunks(), "part": rows.column("part").combine_chunks(), "n": pa.array([b - a for a, b in spans], pa.int64()),
        "marked": pa.array([int(alike[a:b].sum()) for a, b in spans], pa.int64()), "alike": pa.array([np.packbits(alike[a:b]).tobytes() for a, b in spans], pa.binary()),
        "hot": pa.array([np.packbits(frequent[a:b]).tobytes() for a, b in spans], pa.binary()),
    })


_JUDGED = "block string, part long, n long, marked long, alike binary, hot binary"


def sides(block: Block, at: np.ndarray, shape: Shape) -> np.ndarray:
    """The reversed bytes before each anchor and those from it on, as far as windows over it reach, each with its length at the end."""
    document = block.document(at)
    before = np.minimum(at - block.bounds[document], shape.before)
    after = np.minimum(block.bounds[document + 1] - at, shape.length)
    rows = np.zeros((len(at), shape.left + shape.right), np.uint8)
    step, last = 1 << 15, max(len(block.data) - 1, 0)
    for a in range(0, len(at), step):
        p, part = at[a : a + step, None], rows[a : a + step]
        back, on = np.arange(shape.before), np.arange(shape.length)
        part[:, : shape.before] = np.where(back < before[a : a + step, None], block.data[np.maximum(p - 1 - back, 0)], 0)
        part[:, shape.left : shape.left + shape.length] = np.where(on < after[a : a + step, None], block.data[np.minimum(p + on, last)], 0)
    rows[:, shape.left - 1], rows[:, -1] = before, after
    return rows


def distinct(rows: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each kind, kind of every row). Hashes order the rows; neighbours are compared byte by byte."""
    words = deep_shallow.as_words(rows)
    h = np.zeros(len(rows), np.uint64) if extra is None else extra.astype(np.uint64)
    with np.errstate(over="ignore"):
        for c in range(words.shape[1]):
            h = mix64(h * np.uint64(_BASE) + words[:, c])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(rows), bool)
    step = 1 << 16
    for k in range(1, len(rows), step):  # in pieces, so that memory stays with the rows'
        a, b = order[k - 1 : k - 1 + step][: len(order) - k], order[k : k + step]
        new[k : k + step] = (words[a] != words[b]).any(1) if extra is None else (words[a] != words[b]).any(1) | (extra[a] != extra[b])
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def _windows(rows: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows cut to one window each, the row a window comes from, its place), for every window over the anchors."""
    made, origin, places = [], [], []
    for o in range(shape.places):
        has = np.flatnonzero((rows[:, shape.left - 1] >= o) & (rows[:, -1] >= shape.length - o))
        part = rows[has].copy()
        part[:, o : shape.left - 1] = 0
        part[:, shape.left + shape.length - o : -1] = 0
        part[:, shape.left - 1], part[:, -1] = o, shape.length - o
        made.append(part)
        origin.append(has)
        places.append(np.full(len(has), o))
    return np.concatenate(made), np.concatenate(origin), np.concatenate(places)


def _least(kind: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, kind, values)
    return low


def block_sides(block: Block, judged: pa.Table, shape: Shape, buckets: int) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """What a block sends, one row for each bucket, and what it keeps to understand the answers."""
    at, number, grams, _, _ = _grams(block, shape)
    judged = judged.sort_by("part")
    bits = {
        c: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(judged.column(c), judged.column("n").to_pylist(), strict=True)])
        for c in ("alike", "hot")
    }
    use = bits["alike"][number] if len(grams) else np.zeros(0, bool)
    at, number = at[use], number[use]
    rank = block.rank[block.document(at)]
    rows = sides(block, at, shape)
    first, kind = distinct(rows)
    low = _least(kind, len(first), rank)
    rows, key, hot = rows[first], grams[number[first]], bits["hot"][number[first]]
    cold = np.flatnonzero(~hot)
    sent, sent_low, sent_key = rows[cold], low[cold], key[cold]
    kept = {"at": at, "kind": kind, "rank": rank, "low": low, "cold": cold, "window": np.empty(0, np.int64), "origin": np.empty(0, np.int64), "place": np.empty(0, np.int64)}
    if hot.any():
        spread = np.flatnonzero(hot)
        windows, origin, place = _windows(rows[spread], shape)
        of_gram = key[spread][origin]
        first, which = distinct(windows, of_gram)
        kept |= {"window": which, "origin": spread[origin], "place": place}
        window_low = _least(which, len(first), low[spread][origin])
        words = deep_shallow.as_words(windows[first])
        h = of_gram[first]
        with np.errstate(over="ignore"):
            for c in range(words.shape[1]):
                h = mix64(h * np.uint64(_BASE) + words[:, c])
        sent, sent_low, sent_key = np.concatenate([sent, windows[first]]), np.concatenate([sent_low, window_low]), np.concatenate([sent_key, h])
    kept["sent_low"] = sent_low
    # the id behind a rank
    holder = np.zeros(max(int(block.rank.max(initial=-1)) + 1, 1), np.int64)
    known = np.flatnonzero(block.rank >= 0)
    holder[block.rank[known]] = known
    bucket = (mix64(sent_key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    parts = [order[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    low_ids = block.ids.take(pa.array(holder[sent_low][order]))
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values.cast(kind))
    packed = pa.array([_squeeze(sent[p]) for p in parts], pa.binary())
    return pa.table({
        "bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), "sides": packed, "low": lists(low_ids, low_ids.type), "number": lists(pa.array(order), pa.int64()),
    }), kept


def _squeeze(rows: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(rows).tobytes(), 1)


def later_windows(rows: np.ndarray, low: np.ndarray, shape: Shape) -> np.ndarray:
    """Per row, as bits, the places whose window some row with a smaller ``low`` has at the same place of an equal k-gram."""
    first, kind = distinct(rows)
    least = _least(kind, len(first), low)
    pairs = rows[first]
    left, right = np.ascontiguousarray(pairs[:, : shape.left]), np.ascontiguousarray(pairs[:, shape.left :])
    n_left, n_right = left[:, -1].astype(np.int64), right[:, -1].astype(np.int64)
    orders, shared = [], []
    for side, size in ((left, n_left), (right, n_right)):
        order = deep_shallow.sort(side)
        common = deep_shallow.common_prefixes(side, order)
        common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
        orders.append(order)
        shared.append(common)
    found = np.zeros(len(first), np.int64)
    all_ = np.zeros(len(first), np.int64)
    classes = [np.empty(len(first), np.int64), np.empty(len(first), np.int64)]
    for o in range(shape.places):
        has = np.flatnonzero((n_left >= o) & (n_right >= shape.length - o))
        if not len(has):
            continue
        for c, order, common, need in zip(classes, orders, shared, (o, shape.length - o), strict=True):
            c[order] = np.cumsum(common < need)
        both = classes[0][has] * (len(first) + 1) + classes[1][has]
        by = np.argsort(both, kind="stable")
        edge = np.concatenate([[True], np.diff(both[by]) != 0])
        group = np.empty(len(has), np.int64)
        group[by] = np.cumsum(edge) - 1
        smallest = np.minimum.reduceat(least[has][by], np.flatnonzero(edge))[group]
        bit = np.int64(1 << o)
        found[has] |= np.where(smallest < least[has], bit, 0)
        all_[has] |= bit
    return np.where(low > least[kind], all_[kind], found[kind])


def _bucket(shape: Shape) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        width = shape.left + shape.right
        sides_ = np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in rows.column("sides")), np.uint8).reshape(-1, width)
        numbers = [np.asarray(x.values) for x in rows.column("number")]
        ids = pa.concat_arrays([x.values for x in rows.column("low")]).dictionary_encode()
        rank = np.empty(len(ids.dictionary), np.int64)
        rank[np.asarray(pc.array_sort_indices(ids.dictionary))] = np.arange(len(rank))
        places = later_windows(sides_, rank[np.asarray(ids.indices)], shape)
        cuts = np.cumsum([0, *map(len, numbers)]).tolist()
        parts = [places[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        kind = pa.list_(pa.int64())
        return pa.table({
            "block": rows.column("block").combine_chunks(), "number": pa.array([n[p != 0] for n, p in zip(numbers, parts, strict=True)], kind), "places": pa.array([p[p != 0] for p in parts], kind),
        })

    return run


def covered(block: Block, kept: dict[str, np.ndarray], number: np.ndarray, places: np.ndarray, shape: Shape) -> np.ndarray:
    """Which bytes of the block are in a window that an earlier document has."""
    answer = np.zeros(len(kept["sent_low"]), np.int64)
    answer[number] = places
    masks = np.zeros(len(kept["low"]), np.int64)
    masks[kept["cold"]] = answer[: len(kept["cold"])]
    if len(kept["window"]):
        window = kept["window"] + len(kept["cold"])
        bit = np.int64(1) << kept["place"]
        later = (answer[window] != 0) | (kept["sent_low"][window] < kept["low"][kept["origin"]])
        np.bitwise_or.at(masks, kept["origin"][later], bit[later])
    at = kept["at"]
    document = block.document(at)
    own = masks[kept["kind"]]
    later = kept["rank"] > kept["low"][kept["kind"]]  # the same sides in an earlier document of the block: every window
    starts = np.zeros(len(block.data) + 1, bool)
    for o in range(shape.places):
        fits = (at - block.bounds[document] >= o) & (block.bounds[document + 1] - at >= shape.length - o)
        starts[at[fits & (later | (own >> o & 1 == 1))] - o] = True
    first = np.flatnonzero(starts)
    depth = np.zeros(len(block.data) + 1, np.int16)
    depth[first] += 1
    depth[first + shape.length] -= 1
    return np.cumsum(depth[:-1], dtype=np.int16) > 0


def _runs(gone: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes, which end with their document even where the next one begins marked."""
    change = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(gone))]
    touching = inner[gone[inner] & gone[inner - 1]]
    return np.union1d(np.flatnonzero(change == 1), touching), np.union1d(np.flatnonzero(change == -1), touching)


def repeated_spans(docs: DataFrame, length: int = LENGTH, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each maximal removed run of bytes), kept (the bytes that stay), one row per row."""
    spark, shape = docs.sparkSession, Shape(length, sizes)
    small_batches(spark)
    docs = only(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, -(-total // sizes.range_bytes)))
    folder = scratch(spark, "blocks")
    judged = stash(write_blocks(docs, folder, parts, shape).groupBy("part").applyInArrow(lambda rows: _judge(rows, sizes.hot), _JUDGED), "judged-grams")
    marked, blocks = judged.agg(F.sum("marked"), F.count_distinct("block")).first()
    buckets = int(max(1, -(-(marked or 0) // sizes.bucket_grams)))
    # small rows, much work: blocks and buckets are dealt to tasks by number, so that adaptive execution does not put them together
    tasks, bucket_tasks = max(1, min(blocks, MOST_TASKS)), min(buckets, MOST_TASKS)
    id_field = docs.schema["doc_id"]
    low = T.StructField("low", T.ArrayType(id_field.dataType))

    def send(rows: pa.Table) -> pa.Table:
        name = rows.column("block")[0].as_py()
        sent, kept = block_sides(_load(folder, name), rows, shape, buckets)
        put(folder, f"{name}-kept", [_pack(pa.table({c: [v] for c, v in kept.items()}))])
        return sent.append_column("block", pa.array([name] * sent.num_rows, pa.string()))

    numbers = T.StructField("number", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("sides", T.BinaryType()), low, numbers, T.StructField("block", T.StringType())])
    sent = judged.repartition(tasks, "block").groupBy("block").applyInArrow(send, schema)
    answers = stash(sent.repartition(bucket_tasks, "bucket").groupBy("bucket").applyInArrow(_bucket(shape), "block string, number array<long>, places array<long>"), "later-windows")

    def finish(rows: pa.Table) -> pa.Table:
        name = rows.column("block")[0].as_py()
        block = _load(folder, name)
        stored = _unpack(folder, f"{name}-kept")
        kept = {c: np.asarray(stored.column(c).chunk(0).values) for c in stored.column_names}
        number, places = (np.concatenate([np.empty(0, np.int64), *[np.asarray(x.values) for x in rows.column(c) if x.is_valid]]) for c in ("number", "places"))
        gone = covered(block, kept, number, places, shape)
        starts, ends = _runs(gone, block.bounds)
        owner = block.document(starts)
        numbers = np.arange(len(block.rank))
        lo, hi = np.searchsorted(owner, numbers, "left"), np.searchsorted(owner, numbers, "right")
        spans, left = [], []
        for k, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
            spans.append([{"start": int(s) - a, "end": int(e) - a} for s, e in zip(starts[lo[k] : hi[k]], ends[lo[k] : hi[k]], strict=True)])
            left.append(block.data[a:b][~gone[a:b]].tobytes() if hi[k] > lo[k] else block.data[a:b].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": block.ids, "n_bytes": pa.array(np.diff(block.bounds)), "spans": pa.array(spans, kind), "kept": pa.array(left, pa.binary())})

    out = T.StructType([id_field, *T.StructType.fromDDL("n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields])
    every = judged.select("block").distinct().selectExpr("block", "CAST(NULL AS array<long>) AS number", "CAST(NULL AS array<long>) AS places")
    return answers.unionByName(every).repartition(tasks, "block").groupBy("block").applyInArrow(finish, out)


def removals(docs: DataFrame, length: int = LENGTH, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``."""
    rows = repeated_spans(docs, length, sizes)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
