"""Unified diffs as tables: hunks and lines, changed lines, targets, coverage, application."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.intervals import innermost, point_in_interval

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff_lines(text: str | None) -> Iterator[tuple[str, int, str, int | None, int | None, str]]:
    """(file, hunk, op, old_line, new_line, text) of a unified diff; op is ' ', '-' or '+'.

    An added line's old_line is where it goes: the base line that follows it.
    """
    file, hunk, old, new, left = "", 0, 0, 0, [0, 0]
    for line in (text or "").split("\n"):
        m = _HUNK.match(line)
        if m:
            hunk += 1
            old, new = int(m[1]), int(m[3])
            left = [int(m[2] or 1), int(m[4] or 1)]
            if m[2] == "0":
                old += 1
        elif left[0] <= 0 and left[1] <= 0:
            if line.startswith("+++ ") or line.startswith("--- "):
                name = line[4:].split("\t")[0].strip()
                if name != "/dev/null":
                    file = re.sub("^[ab]/", "", name)
                hunk = 0 if line.startswith("--- ") else hunk
        elif line.startswith("-"):
            yield file, hunk, "-", old, None, line[1:]
            old, left[0] = old + 1, left[0] - 1
        elif line.startswith("+"):
            yield file, hunk, "+", old, new, line[1:]
            new, left[1] = new + 1, left[1] - 1
        elif not line.startswith("\\"):
            yield file, hunk, " ", old, new, line[1:]
            old, new, left = old + 1, new + 1, [left[0] - 1, left[1] - 1]


LINE = T.StructType([T.StructField(n, T.StringType() if n in ("file", "op", "line") else T.IntegerType()) for n in ("file", "hunk", "op", "old_line", "new_line", "line")])


@F.udtf(returnType=LINE)
class DiffLines:
    def eval(self, text: str):
        yield from diff_lines(text)


def patch_lines(df: DataFrame, key: str, patch: str) -> DataFrame:
    """All lines of all diffs: key, file, hunk, op, old_line, new_line, line."""
    df.sparkSession.udtf.register("diff_lines_of", DiffLines)
    df.createOrReplaceTempView("patches_to_read")
    return df.sparkSession.sql(f"SELECT p.`{key}`, d.* FROM patches_to_read p, LATERAL diff_lines_of(p.`{patch}`) d")


def changed_lines(lines: DataFrame, key: str) -> DataFrame:
    """Distinct base lines that a diff removes, or before which it adds."""
    return lines.where("op <> ' '").select(key, "file", F.col("old_line").alias("line_no")).distinct()


def hunk_profile(lines: DataFrame, key: str) -> DataFrame:
    """Per diff: files, hunks, added and removed lines, and whether hunks only add, only remove or mix."""
    hunks = lines.groupBy(key, "file", "hunk").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
    adds, removes = (F.col("added") > 0) & (F.col("removed") == 0), (F.col("removed") > 0) & (F.col("added") == 0)
    return hunks.groupBy(key).agg(
        F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("hunks"), F.sum("added").alias("added"), F.sum("removed").alias("removed"),
        F.count_if(adds).alias("only_added"), F.count_if(removes).alias("only_removed"), F.count_if((F.col("added") > 0) & (F.col("removed") > 0)).alias("mixed"),
    )


def line_coverage(rendered: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Share of changed lines that rendered intervals (key, file, start, end) hold."""
    hit = point_in_interval(changed.withColumn("group", F.concat_ws("\x1f", key, "file")).withColumnRenamed("line_no", "point").select(key, "group", "point"), rendered.withColumn("group", F.concat_ws("\x1f", key, "file")).select("group", "start", "end"), "group")
    covered = hit.select(key, "group", "point").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("covered"))
    total = changed.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return total.join(covered, key, "left").na.fill(0, ["covered"]).withColumn("recall", F.round(F.col("covered") / F.col("total"), 6)).withColumn("complete", (F.col("covered") == F.col("total")).cast("int"))


def patch_targets(lines: DataFrame, base: DataFrame, patched: DataFrame, key: str) -> DataFrame:
    """Targets of a diff: entities around removed base lines and around added lines that exist in the base too; else the file.

    ``base`` and ``patched``: key, file, name, kind, start, end. Evidence of one target is joined by + in first-seen order.
    """
    group = lambda df: df.withColumn("group", F.concat_ws("\x1f", key, "file"))
    removed = innermost(group(lines.where("op = '-'")).select(key, "file", "group", F.col("old_line").alias("point")).distinct(), group(base).select("group", "name", "kind", "start", "end"), "group", tie=("name",))
    added = innermost(group(lines.where("op = '+'")).select(key, "file", "group", F.col("new_line").alias("point")).distinct(), group(patched).select("group", "name", "kind", "start", "end"), "group", tie=("name",))
    added = added.join(base.select(key, "file", "name", "kind").distinct(), [key, "file", "name", "kind"], "left_semi")
    found = removed.select(key, "file", "name", "kind", F.lit(0).alias("at"), F.lit("removed_line").alias("evidence")).unionByName(added.select(key, "file", "name", "kind", F.lit(1).alias("at"), F.lit("added_line").alias("evidence")))
    files = lines.where("op <> ' '").select(key, "file").distinct().join(found.select(key, "file").distinct(), [key, "file"], "left_anti")
    whole = found.unionByName(files.select(key, "file", F.lit("").alias("name"), F.lit("file").alias("kind"), F.lit(2).alias("at"), F.lit("file_fallback").alias("evidence")))
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence"))), lambda x: x["evidence"]))
    return whole.groupBy(key, "file", "name", "kind").agg(F.array_join(seen, "+").alias("evidence"))


def apply_patch(source: str, patch: str) -> str:
    """Source with the lines of a one-file diff applied; fails when a removed or kept line differs."""
    lines, out, at = source.split("\n"), [], 1
    for _, _, op, old, _, text in diff_lines(patch):
        while at < (old or at):
            out.append(lines[at - 1])
            at += 1
        if op == "+":
            out.append(text)
        else:
            if lines[at - 1] != text:
                raise ValueError(f"line {at} differs")
            if op == " ":
                out.append(text)
            at += 1
    return "\n".join(out + lines[at - 1 :])


def minimal_patch(column):
    """Added and removed lines of a diff without white space, for comparing patches."""
    kept = F.filter(F.split(column, "\n"), lambda x: x.rlike(r"^[+-](?![+-]{2} )"))
    return F.array_join(F.filter(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: F.length(x) > 1), "\n")
