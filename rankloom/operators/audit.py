"""Audits: leaks, cutoffs, provenance, binding, reuse, digests. A clean audit is an empty or all-zero table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.context import materialise, small_batches, spread
from rankloom.functions.predicates import created_by, is_historical, visible_at
from rankloom.functions.text import token_proxy
from rankloom.operators import metrics, reports
from rankloom.operators.ranking import dedupe_in_order, reciprocal_rank_fusion


def leak_flags(df: DataFrame, text: Column, target_id: Column, patch_markers: tuple[str, ...] = ("diff --git ", "@@ -", "+++ b/")) -> DataFrame:
    """Flags per row: the target's own number, and fragments of a diff in the text."""
    number = F.regexp_like(text, F.concat(F.lit(r"(?:#|/pull/|/issues/)"), target_id.cast("string"), F.lit(r"\b")))
    diff = F.lit(False)
    for m in patch_markers:
        diff = diff | F.contains(text, F.lit(m))
    return df.withColumn("mentions_target", number).withColumn("holds_diff", diff).withColumn("leaks", F.col("mentions_target") | F.col("holds_diff"))


def _flags(*named: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(found, F.lit(False)), F.lit(name)) for name, found in named]), lambda f: f.isNotNull())


# Fixed values below: the names of the flags, the patterns they stand for and the parameters they look at.


def content_flags(text: Column, target: Column) -> Column:
    """What a lower-cased export says about its target (a number as text): references, links, traces, comments."""
    n = F.concat(F.lit(r"\Q"), target, F.lit(r"\E"))
    found = lambda before, after: F.rlike(text, F.concat(F.lit(before), n, F.lit(after))) & (target != "")
    return _flags(
        ("target_pr_reference", found(r"(?<![a-z0-9_])pr#", r"(?![a-z0-9_])")),
        ("target_fix_reference_url", found(r"github\.com/[^\s\"'<>]+/(?:pull|pulls|issues)/", r"(?!\d)") | found(r"code\.djangoproject\.com/ticket/", r"(?!\d)")),
        ("target_fix_reference_text", found(r"\b(?:pr|pull\s+request|pull|issue)\s*#?\s*", r"\b")),
        ("target_fix_trace", found(r"\b(?:fix(?:e[ds])?|close[sd]?|resolve[sd]?)\s+#\s*", r"\b") | found(r"revision=[\"'][0-9a-f]{12,}[\"'][^{}]{0,240}#\s*", r"\b")),
        ("exported_issue_comment", text.rlike(r"###\s+comment\s*:")),
    )


def metadata_flags(params: Column) -> Column:
    """Run parameters (a struct) that a valid export does not have."""
    return _flags(
        ("uses_discussion_comments", F.coalesce(params["uses_discussion_comments"].cast("string"), F.lit("false")) != "false"),  # any value but false
        ("uses_embeddings", F.coalesce(params["uses_embeddings"].cast("string"), F.lit("false")) != "false"),
        ("has_tunable_retrieval_parameters", F.size(F.coalesce(params["tunable_retrieval_parameters"], F.array().cast("array<string>"))) > 0),
    )


def structure_flags(issues: Column, methods: Column, classes: Column, others: Column, target: Column) -> Column:
    """The target among the related issues (structs of issue_id, name), or on a path; of the path groups the first that holds it is named."""
    label = F.concat(F.lit("pr#"), target)
    on = lambda paths: F.exists(paths, lambda p: F.contains(F.lower(p), label)) & (target != "")
    entity = F.exists(issues, lambda i: F.coalesce(i["issue_id"] == target, F.lit(False)) | F.coalesce(i["name"] == label, F.lit(False))) & (target != "")
    return _flags(("target_pr_entity", entity), ("target_pr_in_any_path", on(methods) | on(classes) | on(others)), ("target_pr_in_method_path", on(methods)), ("target_pr_in_class_path", ~on(methods) & on(classes)))


def export_flags(exports: DataFrame, target: Column) -> DataFrame:
    """Exports (exported, params, issues, methods, classes, others) with content, metadata, structure, warned and clean."""
    text, number = F.lower("exported"), F.when(target.rlike(r"^\d+$"), target).otherwise("")
    found = exports.withColumn("content", content_flags(text, number)).withColumn("metadata", metadata_flags(F.col("params")))
    found = found.withColumn("structure", structure_flags(F.col("issues"), F.col("methods"), F.col("classes"), F.col("others"), number))
    found = found.withColumn("warned", text.rlike(r"\bfix(?:e[ds])?\s+#\s*\d+\b"))
    return found.withColumn("clean", F.size("content") + F.size("metadata") + F.size("structure") == 0)


def cutoff_audit(expected: DataFrame, actual: DataFrame, key: str, time: str) -> DataFrame:
    """Counts of matching, mismatched, missing and unexpected times."""
    e, a = expected.select(key, F.col(time).alias("e"), F.lit(1).alias("in_e")), actual.select(key, F.col(time).alias("a"), F.lit(1).alias("in_a"))
    state = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(F.col("e").eqNullSafe(F.col("a")), "match").otherwise("mismatch")
    return e.join(a, key, "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def visible(artifacts: DataFrame, cutoffs: DataFrame, key: str, created: str = "created", updated: str = "updated", cutoff: str = "cutoff", strict: bool = True) -> DataFrame:
    """Artifacts with the flags created_visible and content_visible under their key's cutoff."""
    rows = artifacts.join(cutoffs, key)
    return rows.withColumn("created_visible", created_by(F.col(created), F.col(cutoff))).withColumn("content_visible", visible_at(F.col(created), F.col(updated), F.col(cutoff), strict))


def history_free(df: DataFrame, details: str = "details") -> DataFrame:
    """Rows whose path touches no other issue or pull request."""
    return df.where(~F.exists(F.coalesce(details, F.array().cast(df.schema[details].dataType)), lambda d: is_historical(d["dst"], d["dst_label"])))


def same_sequences(a: DataFrame, b: DataFrame, query: str = "query", key: str = "key") -> DataFrame:
    """Per query whether two rankings hold the same keys in the same order, and their digests."""
    line = lambda df, n: df.groupBy(query).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), "\n"), 256).alias(n))
    return line(a, "digest_a").join(line(b, "digest_b"), query, "full_outer").withColumn("same", F.coalesce(F.col("digest_a") == F.col("digest_b"), F.lit(False)))


def temporal_provenance(structural: DataFrame, artifacts: DataFrame, cutoffs: DataFrame, before: list, after: list, tops: tuple[int, int] = (20, 50), k: int = 60) -> DataFrame:
    """Whether a fused ranking depends on history that its cutoff forbids: filter by metadata, fuse again, compare, in one plan.

    ``structural``: query, key, rank, nodes (the artifacts on a row's path). ``artifacts``: artifact, created, modified. ``cutoffs``: query,
    cutoff. ``before`` and ``after``: (name, ranking) fused ahead of and behind the structural one. A row is ineligible if one of its
    artifacts is unknown, or created or modified after the cutoff, or at no known time; the others are ranked anew. Returns per
    query of ``cutoffs``: history_rows, ineligible_rows, history_only (keys with ineligible rows alone), for both depths whether the
    fused keys stay the same, and the digests at the first.
    """
    rows = structural.select("query", "key", "rank", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes")).join(cutoffs, "query")
    known = artifacts.groupBy(F.col("artifact").alias("node")).agg(F.max("created").alias("created"), F.max("modified").alias("modified"))
    on_path = rows.select("query", "key", "rank", "cutoff", F.explode("nodes").alias("node")).join(known, "node", "left")
    allowed = F.coalesce((F.col("created") <= F.col("cutoff")) & (F.col("modified") <= F.col("cutoff")), F.lit(False))
    judged = on_path.groupBy("query", "key", "rank").agg(F.max((~allowed).cast("int")).alias("barred"))
    rows = materialise(rows.join(judged, ["query", "key", "rank"], "left").na.fill(0, ["barred"]), "provenance-rows")
    kept = dedupe_in_order(rows.where("barred = 0").select("query", "key", "rank"))
    fuse = lambda df: reciprocal_rank_fusion([*before, ("structural", df), *after], None, k, max(tops)).select("query", "key", "rank")
    current, strict = (materialise(fuse(df), "provenance-fused") for df in (rows.select("query", "key", "rank"), kept))
    own = rows.groupBy("query").agg(F.count_if(F.size("nodes") > 0).alias("history_rows"), F.sum("barred").alias("ineligible_rows"))
    only = rows.groupBy("query", "key").agg(F.min("barred").alias("barred")).groupBy("query").agg(F.sum("barred").alias("history_only"))
    out = cutoffs.select("query").join(own, "query", "left").join(only, "query", "left").na.fill(0, ["history_rows", "ineligible_rows", "history_only"])
    for n, top in enumerate(tops):
        same = same_sequences(current.where(F.col("rank") <= top), strict.where(F.col("rank") <= top))
        names = [F.col("digest_a").alias("current_digest"), F.col("digest_b").alias("strict_digest")] if n == 0 else []
        out = out.join(same.select("query", F.col("same").alias(f"same_top{top}"), *names), "query", "left")
    return out.na.fill(True, [f"same_top{top}" for top in tops])  # neither ranking has a row


def prompt_coverage(prompts: DataFrame, methods: DataFrame, targets: DataFrame) -> DataFrame:
    """What a prompt really shows of its targets, from its rendered text back to the entities.

    ``prompts``: variant, instance, text. ``methods``: variant, instance, id, ordinal, signature, start_line, end_line, file, kind, name.
    ``targets`` as in ``metrics.evaluate``. Blocks of the text are resolved to methods by the cascade of ``reports.resolve_blocks``;
    only blocks that carry source count. Returns per variant and instance: rendered, with_source, target_count, matched, coverage,
    hit, complete, tokens and digest of the prompt.
    """
    key = F.concat_ws("|", "variant", F.col("instance").cast("string")).alias("prompt")
    texts = prompts.select("variant", "instance", key, "text")
    blocks = reports.resolve_blocks(reports.rendered_blocks(texts, "prompt", "text"), methods.select(key, "signature", "start_line", "end_line", "id", "ordinal"), "prompt")
    blocks = materialise(blocks, "prompt-blocks")
    named = methods.select(key, "id", "file", "kind", "name")
    shown = blocks.where("has_source = 1").join(named, ["prompt", "id"]).join(texts.drop("text"), "prompt")
    shown = shown.select(F.col("variant").alias("approach"), "instance", (F.col("at") + 1).alias("rank"), "file", "kind", "name")
    counts = blocks.groupBy("prompt").agg(F.count(F.lit(1)).alias("rendered"), F.count_if((F.col("has_source") == 1) & F.col("id").isNotNull()).alias("with_source"))
    met = metrics.matches(shown, targets).groupBy(F.col("approach").alias("variant"), "instance").agg(F.count_distinct("target").alias("matched"))
    wanted = targets.groupBy("instance").agg(F.count_distinct("target").alias("target_count"))
    rows = texts.join(wanted, "instance").join(counts, "prompt", "left").join(met, ["variant", "instance"], "left").na.fill(0, ["rendered", "with_source", "matched"])
    return rows.select(
        "variant", "instance", "rendered", "with_source", "target_count", "matched", (F.col("matched") / F.col("target_count")).alias("coverage"), (F.col("matched") > 0).cast("int").alias("hit"),
        (F.col("matched") == F.col("target_count")).cast("int").alias("complete"), token_proxy(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("digest"),
    )


def binding(windows: DataFrame, stated: DataFrame, query: str = "query") -> DataFrame:
    """Rendered windows against their stated SHA-256."""
    return windows.withColumn("actual", F.sha2("window", 256)).join(stated, query, "full_outer").withColumn("bound", F.coalesce(F.col("actual") == F.col("digest"), F.lit(False)))


def reuse_rate(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Share of rows whose two texts have the same hash."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.sha2(F.col(a), 256) == F.sha2(F.col(b), 256)).cast("double")), 6).alias("reuse"))


def digest_manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """Name, size and SHA-256 of every row's content."""
    return df.select(name, F.length(F.col(content).cast("binary")).alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


#: Passages of at least ``LONG`` characters are looked up by a fingerprint of ``GRAM`` characters, shorter ones by their first ``SHORT``.
LONG, GRAM, SHORT = 32, 12, 3
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _gram_hashes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(len(codes) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * _BASE + codes[k : k + n]
    return (h ^ (h >> np.uint64(32))) * _MIX


def winnowed(text: str) -> np.ndarray:
    """Distinct fingerprints of a text: the least hash of every window of ``LONG`` characters, about one for eleven characters.

    A text that holds a passage has its windows, so it has the least hash of each of them.
    """
    least, done, width = _gram_hashes(text), 1, LONG - GRAM + 1
    if len(least) < width:
        return np.empty(0, np.int64)
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return np.unique(least).view(np.int64)


def _prints(docs: DataFrame, heads: list[str] | None) -> DataFrame:
    """(doc_id, digest, print): fingerprints of every text, and the hashes of its pieces among ``heads`` (none: of all its pieces)."""
    wanted = None if heads is None else docs.sparkSession.sparkContext.broadcast(frozenset(heads))
    rows = docs.select("doc_id", "digest", "text").where("text IS NOT NULL")
    schema = T.StructType([rows.schema["doc_id"], rows.schema["digest"], T.StructField("print", T.LongType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column("text")):
                text = text.as_py()
                found = winnowed(text)
                pieces: set[str] = set()
                if wanted is None or wanted.value:
                    for n in range(1, SHORT + 1):
                        own = {text[i : i + n] for i in range(len(text) - n + 1)}
                        pieces |= own if wanted is None else own & wanted.value
                at = pa.array([k] * (len(found) + len(pieces)), pa.int32())
                columns = [pa.array([*found.tolist(), *[None] * len(pieces)], pa.int64()), pa.array([None] * len(found) + sorted(pieces), pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("digest").take(at), *columns], names=["doc_id", "digest", "print", "piece"])

    return rows.mapInArrow(run, schema)


@F.pandas_udf(T.LongType())
def first_print(passage: pd.Series) -> pd.Series:
    """The fingerprint of a passage's first window."""
    return pd.Series([int(winnowed(p[:LONG])[0]) if len(p) >= LONG else None for p in passage], dtype="Int64")


#: Bytes of a passage by which texts are searched for it, the places of a passage looked at for rare ones, bytes searched at once, bits of their hash.
ANCHOR, PLACES, STRETCH, BITS = 8, 32, 1 << 22, 18


class Passages:
    """Passages to be found in texts, each by its bytes at one place (the anchor), which few other passages share."""

    def __init__(self, texts: list[str]):
        self.texts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < ANCHOR]
        places = [range(min(len(t) - ANCHOR + 1, PLACES)) for t in self.texts]
        shared = Counter(g for t, p in zip(self.texts, places, strict=True) for g in {t[i : i + ANCHOR] for i in p})
        self.anchored: dict[int, list[tuple[int, int]]] = {}
        for k, (t, p) in enumerate(zip(self.texts, places, strict=True)):
            if p:
                i = min(p, key=lambda i: (shared[t[i : i + ANCHOR]], -len(set(t[i : i + ANCHOR])), i))
                self.anchored.setdefault(int.from_bytes(t[i : i + ANCHOR], "little"), []).append((k, i))
        self.keys = np.array(sorted(self.anchored), np.uint64)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[self._bits(self.keys)] = True

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        return (keys * _BASE) >> np.uint64(64 - BITS)

    def _anchors(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, key) where the bytes are those of an anchor."""
        for start in range(0, len(data) - ANCHOR + 1, STRETCH):
            part = data[start : start + STRETCH + ANCHOR - 1]
            for shift in range(min(ANCHOR, len(part) - ANCHOR + 1)):  # every eighth place at once
                seen = np.frombuffer(part, "<u8", (len(part) - shift) // ANCHOR, shift)
                near = np.flatnonzero(self.maybe[self._bits(seen)])
                near = near[np.isin(seen[near], self.keys)]
                yield from zip((start + shift + ANCHOR * near).tolist(), seen[near].tolist(), strict=True)

    def found(self, column: pa.Array) -> set[tuple[int, int]]:
        """(row, passage) where a text of the column holds a passage."""
        wide = pa.types.is_large_string(column.type)
        _, ends, data = column.buffers()
        if data is None or not len(column):
            return set()
        ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = memoryview(data).cast("B")[int(ends[0]) : int(ends[-1])]
        ends, out = ends - ends[0], set()
        for place, key in self._anchors(np.frombuffer(whole, np.uint8)) if len(self.keys) else ():
            row = int(np.searchsorted(ends, place, "right")) - 1
            for k, i in self.anchored[key]:
                first, last = place - i, place - i + len(self.texts[k])
                if first >= ends[row] and last <= ends[row + 1] and whole[first:last] == self.texts[k]:
                    out.add((row, k))
        if self.short:
            for row in range(len(column)):
                text = bytes(whole[int(ends[row]) : int(ends[row + 1])])
                out.update((row, k) for k in self.short if self.texts[k] in text)
        return out


def _held(docs: DataFrame, texts: list[str]) -> DataFrame:
    """(doc_id, passage) where a document holds a passage, given by its place in the list."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Passages(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted(shared.value.found(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64())), pa.array([k for _, k in rows], pa.int32())], names=["doc_id", "passage"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("passage", T.IntegerType())]))


def contained_passages(docs: DataFrame, passages: DataFrame, most: int = 20_000, most_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id) where a document holds the whole of a passage, of whatever length but 0.

    Up to ``most`` passages of ``most_chars`` characters in all are sent to the texts, which are read once and searched for one stretch of
    each passage (``Passages``). More are looked up: a text that holds a passage
    has the fingerprint of the passage's first window among its own (``winnowed``), or, where the passage is shorter than a
    window, its first characters as a piece. What meets is tested whole.
    """
    texts = passages.select("item_id", F.col("text").alias("passage")).where("length(passage) > 0")
    docs = spread(docs.select("doc_id", "text"))
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()
    if n <= most and chars <= most_chars:
        listed = texts.collect()
        distinct = sorted({r.passage for r in listed})
        number = {t: k for k, t in enumerate(distinct)}
        named = docs.sparkSession.createDataFrame([(number[r.passage], r.item_id) for r in listed], T.StructType([T.StructField("passage", T.IntegerType()), texts.schema["item_id"]]))
        return _held(docs, distinct).join(F.broadcast(named), "passage").select("doc_id", "item_id").distinct()
    docs = docs.withColumn("digest", F.xxhash64("text"))  # with the id, which can repeat or be null, it tells the documents
    brief = F.length("passage") < LONG
    texts = texts.select("item_id", "passage", F.when(~brief, first_print("passage")).alias("print"), F.when(brief, F.substring("passage", 1, SHORT)).alias("piece"))
    texts = materialise(texts, "passage-prints")
    heads = [r[0] for r in texts.where("piece IS NOT NULL").select("piece").distinct().limit(most + 1).collect()]
    prints = materialise(_prints(docs, heads if len(heads) <= most else None).select(F.col("doc_id").alias("id"), F.col("digest").alias("at"), "print", "piece"), "text-prints")
    found = prints.join(texts, "print").select("id", "at", "item_id", "passage").unionByName(prints.join(texts, "piece").select("id", "at", "item_id", "passage")).distinct()
    same = docs["doc_id"].eqNullSafe(found["id"]) & (docs["digest"] == found["at"])
    return docs.join(found, same).where(F.contains(F.col("text"), F.col("passage"))).select("doc_id", "item_id").distinct()
