"""Which commit each line of a file comes from, replayed from a table of hunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Ranges that one piece of a file's line map holds before it is split, and rows that leave a task together.
PIECE, OUT_ROWS = 256, 10_000


class LineMap:
    """The lines of one file as ranges (lines, commit) in order, in pieces that know how many lines they have."""

    def __init__(self):
        self.pieces: list[list[list]] = [[]]
        self.sizes = [0]

    def replace(self, start: int, old: int, new: int, commit) -> None:
        """Put ``new`` lines of a commit where ``old`` lines from line ``start`` (from 1) were; both are cut to the file."""
        total = sum(self.sizes)
        at = min(max(start - 1, 0), total)
        old = min(max(old, 0), total - at)
        piece = 0
        while piece + 1 < len(self.pieces) and at > self.sizes[piece]:
            at -= self.sizes[piece]
            piece += 1
        ranges, k = self.pieces[piece], 0
        while k < len(ranges) and at >= ranges[k][0]:
            at -= ranges[k][0]
            k += 1
        if at:  # inside a range: it is cut in two
            ranges[k : k + 1] = [[at, ranges[k][1]], [ranges[k][0] - at, ranges[k][1]]]
            k += 1
        first, spot = piece, k
        while old:
            if k == len(self.pieces[piece]):
                piece, k = piece + 1, 0
                continue
            gone = min(old, self.pieces[piece][k][0])
            self.pieces[piece][k][0] -= gone
            self.sizes[piece] -= gone
            old -= gone
            if not self.pieces[piece][k][0]:
                del self.pieces[piece][k]
        if new > 0:
            self.pieces[first].insert(spot, [new, commit])
            self.sizes[first] += new
        for p in (piece, first):
            if len(self.pieces[p]) > PIECE:
                half = len(self.pieces[p]) // 2
                moved = self.pieces[p][half:]
                del self.pieces[p][half:]
                self.pieces.insert(p + 1, moved)
                self.sizes.insert(p + 1, sum(n for n, _ in moved))
                self.sizes[p] -= self.sizes[p + 1]
                break

    def ranges(self) -> Iterator[tuple[int, int, object]]:
        """(first line, last line, commit), neighbours of one commit joined."""
        line, held = 1, None
        for piece in self.pieces:
            for n, commit in piece:
                if held and held[2] == commit:
                    held = (held[0], held[1] + n, commit)
                else:
                    if held:
                        yield held
                    held = (line, line + n - 1, commit)
                line += n
        if held:
            yield held


def line_provenance(hunks: DataFrame) -> DataFrame:
    """(file, start_line, end_line, commit) of the files as their last hunk leaves them.

    ``hunks``: file, position (their order in the file's history), commit, start_line, old_lines, new_lines; a hunk's start is a line of the
    file as it stands then. Files are dealt over tasks and their hunks come sorted, so a task holds the line map of one file at a time
    and never its history. Starts and lengths beyond the file are cut to it. Hunks of equal position are applied by start, the later
    lines first. Rows without a file or position are left out; files without lines give no rows.
    """
    columns = ["file", "position", "commit", "start_line", "old_lines", "new_lines"]
    rows = hunks.where("file IS NOT NULL AND position IS NOT NULL").select(*columns)
    rows = rows.repartition("file").sortWithinPartitions("file", "position", rows["start_line"].desc(), "old_lines", "new_lines", "commit")
    schema = T.StructType([rows.schema["file"], T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), rows.schema["commit"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, lines, kinds, held = None, LineMap(), None, ([], [], [], [])

        def out(whole: bool = False) -> Iterator[pa.RecordBatch]:
            """The rows held, once they are many: most files have few."""
            if len(held[0]) >= OUT_ROWS or whole and held[0]:
                columns = [pa.array(c, t) for c, t in zip(held, (kinds[0], pa.int64(), pa.int64(), kinds[1]), strict=True)]
                for c in held:
                    c.clear()
                yield pa.RecordBatch.from_arrays(columns, names=["file", "start_line", "end_line", "commit"])

        def close() -> Iterator[pa.RecordBatch]:
            for first, last, commit in lines.ranges():
                for c, v in zip(held, (file, first, last, commit), strict=True):
                    c.append(v)
                yield from out()

        for b in batches:
            kinds = (b.schema.field("file").type, b.schema.field("commit").type)
            for name, _, commit, start, old, new in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if name != file:
                    if file is not None:
                        yield from close()
                    file, lines = name, LineMap()
                lines.replace(start or 1, old or 0, new or 0, commit)
        if file is not None:
            yield from close()
            yield from out(True)

    return rows.mapInArrow(run, schema)
