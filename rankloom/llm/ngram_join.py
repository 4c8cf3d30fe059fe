"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct 4-word shingles, held as 64-bit hashes. Documents link when
``100 * intersection >= 85 * union``, that is when the overlap reaches ``ceil(0.85 * n)`` for either size ``n`` at least.

1. *Classes.* A count sketch over all documents orders tokens from rare to frequent; a token whose bucket is
   heavy is of the frequent class, any other of the rare class.
2. *Prefixes.* Of a document with ``n`` tokens at most ``n - o`` (``o = ceil(0.85 n)``) are missing from a partner. A prefix
   in token order is extended until rare tokens, plus for each sub-class of frequent tokens one less than its
   number there, exceed ``n - o``. Then two linked documents share a rare token of both prefixes or two tokens of one
   frequent sub-class, so rare tokens are indexed alone and frequent ones by pairs. The number of sub-classes follows the
   document's size band, which keeps pairs linear in the size; a document indexes its band and the next, as partners do.
3. *Verification.* Documents with equal token sets are one class from the start. Entries with few classes give all
   their size-compatible pairs. Entries with many give pairs with one pivot, and the families they form are compared in
   blocks, block pair by block pair, whatever their size; only a spanning forest of links leaves such a comparison.
   Every comparison is exact on whole token sets.

Token sets travel only for classes with a candidate whose size and parity bitmap (an exact bound on the overlap) allow a link. No group is collected: entries are joined, families
are cut into blocks of bounded count and bytes.

Cases: null text and text without words have no tokens and link with nothing; with fewer than four words the whole
sequence is the one token. Repeated rows are equal sets. A null doc_id is never a component's name unless
alone. A document is told by its id, which can be null, and a 64-bit digest of its text: one id with two texts is two
documents, and documents without id differ by their texts. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.frames import fresh, only
from rankloom.llm.storage import small_batches, stash, sum_vectors
from rankloom.llm.textcore import Words, chunked, mix64, shingle_hashes

WIDTH = 4
PERCENT = 85
SKETCH_BITS = 20
#: A token is frequent if its sketch bucket counts more than this and more than twice the mean bucket.
FREQUENT = 64
#: Tokens of one frequent sub-class in a prefix, about.
PER_SUBCLASS = 4
#: Entries with more classes than this are compared in blocks.
DENSE = 64
BLOCK_CLASSES = 256
BLOCK_BYTES = 16 << 20
#: Parts of a family that joins on it are dealt by.
SALTS = 64
#: 64-bit words of a class's parity bitmap.
BITMAP_WORDS = 32


def token_sets(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for group in chunked(texts):
        for words in Words(group, lower_ascii=True):
            yield np.unique(shingle_hashes(words, width))


def set_key(tokens: np.ndarray) -> int:
    """Signed 64-bit digest of a token set; with the set's size it stands for the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)) if len(tokens) else 0


def text_digest(text: Column) -> Column:
    """64-bit digest of a text; with the id, which need be neither there nor unique, it stands for the document."""
    return F.xxhash64(text)


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of ``n`` tokens with any partner."""
    return -(-percent * n // 100)


def linked(common: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n + m - common)


def band(n: int, percent: int = PERCENT) -> int:
    """Size band: partners are in the same one or in neighbours."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def subclasses(b: int, percent: int = PERCENT) -> int:
    """Frequent sub-classes of documents indexed under size band ``b``."""
    return max(1, math.ceil((100 - percent) / 100 * (100 / percent) ** b / PER_SUBCLASS))


def prefix_entries(tokens: np.ndarray, weight: np.ndarray, heavy: float, percent: int = PERCENT) -> np.ndarray:
    """Index entries of a token set: rare tokens of its prefix, and pairs of frequent ones."""
    n = len(tokens)
    miss = n - needed(n, percent) + 1
    rare = weight <= heavy
    n_rare = int(rare.sum())
    order = np.lexsort((tokens, weight))
    if n_rare >= miss:
        return tokens[order[:miss]]
    if n == 1:
        return tokens[:0]  # only an equal set could link, and equal sets are one class
    singles, frequent = tokens[order[:n_rare]], tokens[order[n_rare:]]
    found = [singles]
    for b in (band(n, percent), band(n, percent) + 1):
        kind = (mix64(frequent ^ np.uint64(b + 1)) % np.uint64(subclasses(b, percent))).astype(np.int64)
        _, first = np.unique(kind, return_index=True)
        gain = np.ones(len(frequent), np.int64)
        gain[first] = 0
        short = miss - n_rare
        end = int(np.searchsorted(np.cumsum(gain), short)) + 1
        part, kind = frequent[:end], kind[:end]
        for k in np.unique(kind):
            t = np.sort(part[kind == k])
            if len(t) > 1:
                i, j = np.triu_indices(len(t), 1)
                found.append(mix64(mix64(t[i] + np.uint64(b + 1)) ^ t[j]))
    return np.concatenate(found)


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """One bit per hash place, set if an odd number of tokens fall there.

    Two bitmaps differ in at most as many bits as their sets differ in tokens, which bounds the overlap from above.
    """
    odd = np.bincount((mix64(tokens + np.uint64(7)) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def link_matrix(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets of two lists link, all at once: tokens on both sides meet in a dense product, some tokens at a time."""
    sizes = np.array([len(t) for t in left])[:, None], np.array([len(t) for t in right])[None, :]
    tokens = [np.concatenate(side) if side else np.empty(0, np.uint64) for side in (left, right)]
    both = np.intersect1d(np.unique(tokens[0]), np.unique(tokens[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)))
    step = 4096
    rows = [np.repeat(np.arange(len(side)), [len(t) for t in side]) for side in (left, right)]
    at = [np.minimum(np.searchsorted(both, t), max(len(both) - 1, 0)) for t in tokens]
    hit = [both[p] == t if len(both) else np.zeros(len(t), bool) for p, t in zip(at, tokens, strict=True)]
    cells = []
    for p, h, r in zip(at, hit, rows, strict=True):
        p, r = p[h], r[h]
        o = np.argsort(p, kind="stable")
        cells.append((p[o], r[o]))
    for k in range(0, len(both), step):
        part = []
        for (p, r), side in zip(cells, (left, right), strict=True):
            lo, hi = np.searchsorted(p, [k, k + step])
            m = np.zeros((len(side), min(step, len(both) - k)), np.float32)
            m[r[lo:hi], p[lo:hi] - k] = 1
            part.append(m)
        common += part[0] @ part[1].T
    return 100 * common >= percent * (sizes[0] + sizes[1] - common) - 1e-6


def spanning_links(n: int, links: Iterable[tuple[int, int]], seed: list[int]) -> Iterator[tuple[int, int]]:
    """The links that join parts not joined before; ``seed`` names the part each node starts in."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for k, s in enumerate(seed):
        if s in first:
            parent[root(k)] = root(first[s])
        else:
            first[s] = k
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            yield a, b


def _arrow(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Number of token occurrences (once per document) in each hash bucket, over all documents."""

    def add(total: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for b in batches:
            for tokens in grouped(token_sets(b.column(0).to_pylist())):
                total += np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total))

    def grouped(sets: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for t in sets:
            held.append(t)
            n += len(t)
            if n > 1 << 20:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)

    return sum_vectors(only(docs, "text"), 1 << bits, add)


def index_entries(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """Per document (doc_id, text, digest) one row with its set's key and size, and index entries as packed 64-bit values."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))
    heavy = max(FREQUENT, 2 * float(counts.mean()))
    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for b in batches:
            rows = []
            for tokens in token_sets(b.column(1).to_pylist()):
                entries = prefix_entries(tokens, weight[(tokens >> shift).astype(np.int64)], heavy, percent) if len(tokens) else tokens
                rows.append((len(tokens), set_key(tokens), np.unique(entries).view(np.int64), parity_bitmap(tokens)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(2), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32), np.concatenate([r[2] for r in rows] or [np.empty(0, np.int64)])),
                 pa.ListArray.from_arrays((BITMAP_WORDS * np.arange(len(rows) + 1)).astype(np.int32), np.concatenate([r[3] for r in rows] or [np.empty(0, np.int64)]))],
                names=["doc_id", "digest", "n", "key", "entries", "bitmap"],
            )

    return docs.mapInArrow(run, "doc_id long, digest long, n long, key long, entries array<long>, bitmap array<long>")


def _sets_of(docs: DataFrame) -> DataFrame:
    """(key, tokens) of documents (key, text), without those whose set has another key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column(0).to_pylist(), token_sets(b.column(1).to_pylist()), strict=True)
            yield _arrow([(key, t.astype("<u8").tobytes()) for key, t in sets if set_key(t) == key], [pa.int64(), pa.binary()], ["key", "tokens"])

    return docs.select("key", "text").mapInArrow(run, "key long, tokens binary")


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave room for enough overlap; no linked pair is lost."""
    left = classes.select(F.col("key").alias("a"), F.col("n").alias("n"), F.col("bitmap").alias("x"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    most = F.floor((F.col("n") + F.col("m") - apart) / 2)
    both = pairs.join(left, "a").join(right, "b")
    return stash(both.where(100 * most >= percent * (F.col("n") + F.col("m") - most)).select("a", "b"), "pairs")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for a, c, x, y in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if linked(common_count(x, y), len(x), len(y), percent):
                    rows.append((a.as_py(), c.as_py()))
            yield _arrow(rows, [pa.int64(), pa.int64()], ["a", "b"])

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _compare_blocks(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        keys, labels, parts = (rows.column(c).to_pylist() for c in ("key", "label", "block"))
        sets = [np.frombuffer(t.as_buffer(), "<u8") for t in rows.column("tokens")]
        first, second = rows["block_a"][0].as_py(), rows["block_b"][0].as_py()
        at = [[k for k, p in enumerate(parts) if p == block] for block in (first, second)]
        hit = link_matrix([sets[k] for k in at[0]], [sets[k] for k in at[1]], percent)
        named = np.array([labels[k] for k in at[0]])[:, None] != np.array([labels[k] for k in at[1]])[None, :]
        found = ((at[0][i], at[1][j]) for i, j in zip(*np.nonzero(hit & named), strict=True) if at[0][i] != at[1][j])
        links = [(keys[a], keys[b]) for a, b in spanning_links(len(keys), found, labels)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _salted(groups: DataFrame) -> DataFrame:
    """One row per group and salt: joined on both, a large group's rows spread over as many partitions."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _blocks(inside: DataFrame, percent: int) -> DataFrame:
    """Families (family, salt, key, label, tokens) cut into blocks of bounded count and bytes: family, band, pure, block, key, label, tokens.

    A block holds sets of one size band, and either of one label alone (``pure``, for labels with more sets than fit a block) or
    of the other labels, each whole in one block.
    """
    band_of = F.floor(F.log(F.length("tokens") / 8) / math.log(100 / percent) + F.lit(1e-9)).cast("int")
    inside = inside.withColumn("band", band_of)
    count, size = F.count(F.lit(1)).alias("c"), F.sum(F.length("tokens")).alias("bytes")
    blocks = F.greatest(F.ceil(F.sum("c") / BLOCK_CLASSES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    per_label = inside.groupBy("family", "band", "label").agg(count, size)
    large = (F.col("c") > BLOCK_CLASSES) | (F.col("bytes") > BLOCK_BYTES)
    pure = per_label.where(large).groupBy("family", "band", "label").agg(blocks.alias("own"))
    mixed = per_label.where(~large).groupBy("family", "band").agg(blocks.alias("shared"))
    placed = inside.join(_salted(pure), ["family", "band", "label", "salt"], "left").join(_salted(mixed), ["family", "band", "salt"], "left")
    part = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("key"), F.col("own"))).otherwise(F.pmod(F.xxhash64("label"), F.col("shared")))
    pure_label = F.when(F.col("own").isNotNull(), F.col("label"))
    block = F.concat_ws("/", "family", "band", F.coalesce(pure_label.cast("string"), F.lit("-")), part)
    return placed.select("family", "band", pure_label.alias("pure"), block.alias("block"), "key", "label", "tokens")


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of a family's blocks (block_a, block_b) that can hold a link between labels: not of one label, bands at most one apart."""
    ids = placed.select("family", "band", "pure", "block").distinct()
    left, right = (ids.withColumnsRenamed({c: f"{c}_{x}" for c in ("band", "pure", "block")}) for x in "ab")
    apart = (F.col("block_a") <= F.col("block_b")) & (F.abs(F.col("band_a") - F.col("band_b")) <= 1)
    return left.join(right, "family").where(apart & ~F.coalesce(F.col("pure_a") == F.col("pure_b"), F.lit(False))).select("block_a", "block_b")


def _least_document() -> Column:
    """The least document of a group by id, nulls last, and text digest, as a struct with the fields doc_id and digest."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest"))


def class_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents with their set's size and key (doc_id, digest, n, key), and links (a, b) between different sets.

    The links span the components of the similarity graph; within dense families not every link is returned.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text").withColumn("digest", text_digest(F.col("text")))
    table = stash(index_entries(docs, sketch(docs), percent), "entries")
    members = table.select("doc_id", "digest", "n", "key")
    classes = stash(table.where("n > 0").dropDuplicates(["key"]).drop("doc_id", "digest"), "classes")
    entries = classes.select(F.explode("entries").alias("entry"), "key", "n")
    shared = entries.groupBy("entry").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("load")).where("load > 1")
    posted = stash(entries.join(shared, "entry"), "posted")
    small, dense = posted.where(F.col("load") <= DENSE), posted.where(F.col("load") > DENSE)
    other = small.select("entry", F.col("key").alias("b"), F.col("n").alias("m"))
    near = (100 * F.least("n", "m")) >= (percent * F.greatest("n", "m"))
    pairs = small.join(other, "entry").where((F.col("key") < F.col("b")) & near).select(F.col("key").alias("a"), "b")
    pivots = dense.where("key = pivot").select("entry", F.col("n").alias("m"))
    starred = dense.join(pivots, "entry").where((F.col("key") != F.col("pivot")) & near).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
    pairs = _may_link(pairs.unionByName(starred).distinct(), classes, percent)
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(dense.select("key")).distinct()
    first = members.where("n > 0").groupBy("key").agg(_least_document().alias("first")).select("key", "first.doc_id", "first.digest")
    first = first.join(wanted, "key").hint("shuffle_hash")
    texts = docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]) & (docs["digest"] == first["digest"]))
    sets = stash(_sets_of(texts).dropDuplicates(["key"]), "sets")
    links = stash(_verify(pairs, sets, percent), "links")
    if dense.isEmpty():
        return members, links
    # families: classes that dense entries connect, whether they link or not; blocks of them are compared pair by pair
    touched = dense.select("key", "pivot").distinct()
    family = components(touched.select(F.col("key").alias("a"), F.col("pivot").alias("b")))
    parts = components(links)
    inside = family.select(F.col("node").alias("key"), F.col("root").alias("family")).join(parts.select(F.col("node").alias("key"), F.col("root").alias("label")), "key", "left")
    inside = inside.withColumn("label", F.coalesce("label", "key")).join(sets, "key")
    open_ = inside.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("family")
    inside = inside.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    placed = stash(_blocks(inside.join(_salted(open_), ["family", "salt"]), percent), "blocks")
    pairs = _block_pairs(placed)
    ends = pairs.select(F.col("block_a").alias("block"), "*").unionByName(pairs.where("block_a <> block_b").select(F.col("block_b").alias("block"), "*"))
    spread = placed.select("block", "key", "label", "tokens").join(ends, "block").repartition("block_a", "block_b")
    more = spread.groupBy("block_a", "block_b").applyInArrow(_compare_blocks(percent), "a long, b long")
    return members, stash(links.unionByName(more), "links")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    members, links = class_links(docs, percent)
    roots = components(links).withColumnRenamed("node", "key")
    classes = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = classes.join(classes.groupBy("root").agg(F.min("first").alias("name")), "root").select("key", F.lit(False).alias("empty"), "name")
    out = members.withColumn("empty", F.col("n") == 0).join(named, ["key", "empty"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The least document of each component by id, nulls last, and text digest, once, with the columns it came with.

    Documents without words link with nothing: each stays, repeated rows (same id and text) once.
    """
    members, links = class_links(docs, percent)
    roots = components(links).withColumnRenamed("node", "key")
    rooted = members.where("n > 0").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    keep = rooted.groupBy("root").agg(_least_document().alias("first")).select("first.doc_id", "first.digest")
    keep = keep.unionByName(members.where("n = 0").select("doc_id", "digest").distinct())
    digest = fresh(docs, "digest")[0]
    rows = docs.withColumn(digest, text_digest(docs["text"]))
    kept = rows.join(keep.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(keep["doc_id"]) & (rows[digest] == keep["digest"]), "left_semi")
    return kept.dropDuplicates(["doc_id", digest]).drop(digest)
