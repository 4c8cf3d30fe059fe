"""Graph construction: text, trace and reference links, call sites, seeds, context, hydration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions.predicates import is_code_reference, visible_at
from rankloom.operators.graph import NORMAL, STRONG, WEAK

# Scores of the ways a file can be named by an issue.
EXPLICIT_PATH, DOTTED_MODULE, MENTION, DEFINITION, PATH_TOKEN = 1000, 800, 15, 120, 4
MAX_MENTIONS, MAX_DEFINITIONS = 20, 10


def issue_references(issues: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst) where an issue's text names another known issue of its repository by number."""
    named = issues.select("repo", F.col("issue").alias("src"), F.explode(tx.reference_ids(F.col("text"), F.col("repo").cast("string"))).alias("dst")).where("src <> dst").distinct()
    return named.join(known.select("repo", F.col("issue").alias("dst")).distinct(), ["repo", "dst"]).select("repo", "src", "dst")


def expand_issues(roots: DataFrame, issues: DataFrame, cutoff: Column, rounds: int = 2) -> DataFrame:
    """Issues reached from the roots by references, a few rounds deep; only what is visible at the cutoff."""
    seen = issues.where(visible_at(F.col("created"), F.col("updated"), cutoff))
    links = issue_references(seen, seen)
    out = roots.select("repo", "issue", F.lit(0).alias("depth"))
    front = out
    for depth in range(1, rounds + 1):
        step = front.select("repo", F.col("issue").alias("src")).join(links, ["repo", "src"]).select("repo", F.col("dst").alias("issue")).distinct()
        front = step.join(out.select("repo", "issue"), ["repo", "issue"], "left_anti").withColumn("depth", F.lit(depth))
        out = out.unionByName(front)
    return out


def file_links(issues: DataFrame, files: DataFrame) -> DataFrame:
    """(issue, path) where the text names the path or a tail of it that only full path steps make."""
    named = issues.select("repo", "issue", F.explode(tx.file_mentions(F.col("text"))).alias("named")).withColumn("named", F.regexp_replace("named", r"^(?:\./|/)+", "")).distinct()
    steps = F.split("path", "/")
    tails = files.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))).alias("named"))
    return named.join(tails, ["repo", "named"]).select("repo", "issue", "path").distinct()


def trace_links(issues: DataFrame, entities: DataFrame) -> DataFrame:
    """(issue, path, name) of functions that traceback lines of the text stand in: 'File "path", line n, in name'."""
    frames = issues.select("repo", "issue", F.explode(F.regexp_extract_all("text", F.lit(r'(File "[^"]+", line \d+, in \S+)'), F.lit(1))).alias("frame"))
    frames = frames.select("repo", "issue", F.regexp_extract("frame", '"([^"]+)"', 1).alias("full"), F.regexp_extract("frame", r"in (\S+)$", 1).alias("last"))
    known = entities.withColumn("last", F.element_at(F.split("name", r"\."), -1))
    return frames.join(known, ["repo", "last"]).where(F.col("full").endswith(F.col("path"))).select("repo", "issue", "path", "name").distinct()


def resolve_references(references: DataFrame, entities: DataFrame, most_files: int = 5) -> DataFrame:
    """References of an issue to entities, from sure to loose: full name (STRONG), dotted tail (NORMAL), last part (WEAK).

    A looser way is tried only where a surer one finds nothing; a last part found in more than ``most_files`` files is dropped.
    """
    refs = references.where(is_code_reference(F.col("reference"))).distinct()
    parts = F.split("name", r"\.")
    named = entities.select("repo", "path", "name", F.col("name").alias("reference"))
    full = refs.join(named, ["repo", "reference"]).select("repo", "issue", "reference", "path", "name", F.lit(STRONG).alias("weight"))
    rest = refs.join(full.select("repo", "issue", "reference").distinct(), ["repo", "issue", "reference"], "left_anti")
    tails = entities.select("repo", "path", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("reference"))
    tail = rest.where(F.col("reference").contains(".")).join(tails, ["repo", "reference"]).select("repo", "issue", "reference", "path", "name", F.lit(NORMAL).alias("weight"))
    rest = rest.join(tail.select("repo", "issue", "reference").distinct(), ["repo", "issue", "reference"], "left_anti").withColumn("last", F.element_at(F.split("reference", r"\."), -1))
    last = rest.join(entities.withColumn("last", F.element_at(parts, -1)), ["repo", "last"])
    wide = last.groupBy("repo", "issue", "reference").agg(F.count_distinct("path").alias("files")).where(F.col("files") <= most_files)
    loose = last.join(wide, ["repo", "issue", "reference"]).select("repo", "issue", "reference", "path", "name", F.lit(WEAK).alias("weight"))
    return full.unionByName(tail).unionByName(loose)


def resolve_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Call sites (repo, path, caller, callee) to entities: same file by full or scoped name first, else by dotted tail anywhere."""
    scope = F.regexp_replace("caller", r"\.?[^.]+$", "")
    plain = F.regexp_replace("callee", r"^(?:self|cls)\.", "")
    names = F.array_distinct(F.array(F.col("callee"), plain, F.concat_ws(".", F.when(scope != "", scope), plain)))
    tried = calls.withColumn("name", F.explode(names))
    local = tried.join(entities.select("repo", "path", "name"), ["repo", "path", "name"]).select("repo", "path", "caller", "callee", F.col("path").alias("to_path"), "name").distinct()
    rest = calls.join(local.select("repo", "path", "caller", "callee").distinct(), ["repo", "path", "caller", "callee"], "left_anti").withColumn("last", F.element_at(F.split("callee", r"\."), -1))
    anywhere = entities.select("repo", F.col("path").alias("to_path"), "name", F.element_at(F.split("name", r"\."), -1).alias("last"))
    far = rest.join(anywhere, ["repo", "last"]).where((F.col("name") == F.col("callee")) | F.col("name").endswith(F.concat(F.lit("."), "callee")) | F.col("callee").endswith(F.concat(F.lit("."), "name")))
    return local.unionByName(far.select("repo", "path", "caller", "callee", "to_path", "name").distinct())


def seed_scores(issues: DataFrame, files: DataFrame, definitions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Score of each file for each issue: named paths, dotted modules, mentions, definitions, and path tokens.

    ``definitions`` and ``mentions``: repo, issue, path, n.
    """
    explicit = file_links(issues, files).select("repo", "issue", "path", F.lit(EXPLICIT_PATH).alias("score"))
    dotted = issues.select("repo", "issue", F.explode(tx.exact_terms(F.col("text"))).alias("d")).where("d LIKE '%.%'").select("repo", "issue", F.concat(F.regexp_replace("d", r"\.", "/"), F.lit(".py")).alias("path")).distinct()
    modules = dotted.join(files.select("repo", "path"), ["repo", "path"]).select("repo", "issue", "path", F.lit(DOTTED_MODULE).alias("score"))
    counted = mentions.select("repo", "issue", "path", (F.least("n", F.lit(MAX_MENTIONS)) * MENTION).alias("score")).unionByName(definitions.select("repo", "issue", "path", (F.least("n", F.lit(MAX_DEFINITIONS)) * DEFINITION).alias("score")))
    words = issues.select("repo", "issue", F.explode(F.array_distinct(tx.evidence_terms(F.col("text")))).alias("term"))
    tokens = files.select("repo", "path", F.explode(F.array_distinct(tx.evidence_terms(F.col("path")))).alias("term"))
    shared = words.join(tokens, ["repo", "term"]).groupBy("repo", "issue", "path").agg((F.count(F.lit(1)) * PATH_TOKEN).alias("score"))
    parts = explicit.unionByName(modules).unionByName(counted).unionByName(shared.withColumn("score", F.col("score").cast("int")))
    return parts.groupBy("repo", "issue", "path").agg(F.sum("score").alias("score"))


def context_top(issues: DataFrame, context: DataFrame, cutoff: Column, n: int, least: int = 1) -> DataFrame:
    """Documents, commits or tags (repo, id, text, time) that share most tokens with an issue, newest first among equals."""
    rows = issues.select("repo", "issue", tx.context_tokens(F.col("text")).alias("tokens")).join(context.where(F.col("time") <= cutoff), "repo")
    scored = rows.withColumn("overlap", tx.context_score(F.col("tokens"), F.col("text"))).where(F.col("overlap") >= least)
    order = Window.partitionBy("repo", "issue").orderBy(F.col("overlap").desc(), F.col("time").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("repo", "issue", "id", "overlap", "rank")


def hydrate(ranked: DataFrame, entities: DataFrame, keys: list[str], columns: list[str], ordinal: str) -> DataFrame:
    """Attach columns of the first entity with the same keys."""
    first = entities.groupBy(*keys).agg(F.min_by(F.struct(*columns), ordinal).alias("e"))
    return ranked.join(first, keys, "left").select(*ranked.columns, *[F.col(f"e.{c}").alias(c) for c in columns])


def resolve_spans(ranked: DataFrame, entities: DataFrame, query: str = "query") -> DataFrame:
    """Spans of ranked names in the base snapshot: full name, then name without a doubled package prefix, then last three, two, one parts.

    Rows whose file or entity is gone drop out; the first row of a signature stays.
    """
    from rankloom.operators.joins import name_variations

    undoubled = F.regexp_replace("name", r"^(\w+)\.\1\.", "$1.")
    tried = F.array_distinct(F.concat(F.array(F.col("name"), undoubled), F.reverse(name_variations(F.col("name")))))
    rows = ranked.select("*", F.posexplode(tried).alias("level", "as"))
    hit = rows.join(entities.select("file", F.col("name").alias("as"), "start_line", "end_line"), ["file", "as"])
    order = Window.partitionBy(query, "rank").orderBy("level", "start_line")
    best = hit.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.withColumn("copy", F.row_number().over(Window.partitionBy(query, "file", "as").orderBy("rank"))).where("copy = 1").select(query, "rank", "file", F.col("as").alias("name"), "start_line", "end_line")


def fill_by_labels(base: DataFrame, more: DataFrame, limit: int, query: str = "query") -> DataFrame:
    """Ordered union in which a row is skipped when its full or its short label was taken in the same file.

    Whether a row is taken hangs on all rows before it, so one query's short lists go to a Python task: both are
    cut to ``limit`` files' worth of ranks before. Columns: query, file, label, rank.
    """
    kind = dict(base.dtypes)
    rows = base.withColumn("part", F.lit(0)).select(query, "file", "label", "rank", "part").unionByName(more.withColumn("part", F.lit(1)).select(query, "file", "label", "rank", "part"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], set()
        for r in group.sort_values(["part", "rank"]).itertuples():
            full = r.label.split(" = ")[0].split("(")[0].strip().lower()
            own = {(r.file, full), (r.file, full.rsplit(".", 1)[-1])} if full else set()
            if taken & own:
                continue
            taken |= own
            out.append((getattr(r, query), r.file, r.label, len(out) + 1))
            if len(out) == limit:
                break
        return pd.DataFrame(out, columns=[query, "file", "label", "rank"])

    return rows.groupBy(query).applyInPandas(run, f"{query} {kind[query]}, file string, label string, rank int")


# Where type files live, and folders that are not looked into for roots and for files by their stem.
SOURCE_ROOT, NO_ROOTS, NO_STEMS = "src/main/java", ".git .gradle .idea build dist node_modules out target test tests".split(), ".git build out target test tests".split()


def _outside(path: Column, folders: list[str]) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def type_files(names: DataFrame, files: DataFrame, group: str, extension: str = ".java") -> DataFrame:
    """(group, name, kind, path): the files, or packages, that qualified names stand for.

    ``names``: group, name. ``files``: group, path. In every source root of the group the longest prefix of a name that is a file's path
    counts; names without a type part (one that starts with a capital, _ or $) may be folders as well. A name with a type part that no root
    knows gives all files that are called like its last type. A group without roots is a root itself. All steps are equi-joins:
    prefixes of a name are rows, and so are the folders of a file.
    """
    paths = files.select(group, "path").where("path IS NOT NULL").distinct()
    root = F.regexp_extract("path", rf"^((?:[^/]+/)*?{SOURCE_ROOT})/", 1)
    rooted = paths.withColumn("root", F.when((root != "") & _outside(root, NO_ROOTS), root).otherwise(""))
    bare = rooted.groupBy(group).agg(F.max(F.col("root") != "").alias("has_roots"))
    rooted = rooted.join(bare, group).where((F.col("root") != "") | ~F.col("has_roots")).withColumn("within", F.expr("CASE WHEN root = '' THEN path ELSE substring(path, length(root) + 2) END"))
    asked = names.select(group, "name").where("name IS NOT NULL").distinct().withColumn("parts", F.filter(F.split("name", r"\."), lambda p: p != "")).where(F.size("parts") > 0)
    asked = asked.withColumn("types", F.filter("parts", lambda p: p.rlike("^[A-Z_$]")))
    steps = asked.select(group, "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("k"), F.concat(F.array_join(F.slice("parts", F.lit(1), k), "/"), F.lit(extension)).alias("within")))).alias("s"))
    hits = steps.select(group, "name", "s.k", "s.within").join(rooted, [group, "within"])
    exact = hits.groupBy(group, "name", "root").agg(F.max_by("path", "k").alias("path")).select(group, "name", F.lit("file").alias("kind"), "path")
    up = F.split("within", "/")
    folders = rooted.select(group, "root", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(up) - 1, F.lit(1))), lambda k: F.when(F.size(up) > 1, F.array_join(F.slice(up, F.lit(1), k), "/")))).alias("folder"))
    folders = folders.where("folder IS NOT NULL").distinct()
    packages = asked.where(F.size("types") == 0).select(group, "name", F.array_join("parts", "/").alias("folder")).join(folders, [group, "folder"])
    packages = packages.select(group, "name", F.lit("package").alias("kind"), F.when(F.col("root") == "", F.col("folder")).otherwise(F.concat_ws("/", "root", "folder")).alias("path"))
    stem = F.substring_index(F.element_at("types", -1), "$", 1)
    rest = asked.where(F.size("types") > 0).join(exact.select(group, "name").distinct(), [group, "name"], "left_anti").select(group, "name", stem.alias("stem"))
    last = F.element_at(up, -1)
    stems = rooted.where(F.endswith("path", F.lit(extension)) & _outside(F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/"), NO_STEMS))
    stems = stems.select(group, "path", F.substring(last, F.lit(1), F.length(last) - len(extension)).alias("stem"))
    by_stem = rest.join(stems, [group, "stem"]).select(group, "name", F.lit("file").alias("kind"), "path")
    return exact.unionByName(packages).unionByName(by_stem).distinct()
