"""Expectations of a table, all tested in the pass that uses it, and reported as a table.

Every expectation is a few aggregates over the rows; ``observe`` hangs them on the plan, so that any number of them costs
no pass, no shuffle and no sort of its own. The driver receives one row of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Expectation:
    """``holds`` of every row (null does not hold), or of a share of ``least``; or ``value`` of the whole table within bounds."""

    name: str
    holds: Column | None = field(default=None, compare=False)
    least: float = 1.0
    value: Column | None = field(default=None, compare=False)
    low: float | None = None
    high: float | None = None

    def aggregates(self, k: int) -> list[Column]:
        if self.value is not None:
            return [self.value.cast("double").alias(f"value_{k}")]
        return [F.count_if(~F.coalesce(self.holds, F.lit(False))).alias(f"failed_{k}")]


def rows_where(name: str, holds: Column, least: float = 1.0) -> Expectation:
    return Expectation(name, holds, least)


def not_null(column: str) -> Expectation:
    return rows_where(f"{column} is not null", F.col(column).isNotNull())


def between(column: str, low: Column, high: Column, least: float = 1.0) -> Expectation:
    return rows_where(f"{column} is in range", F.col(column).between(low, high), least)


def one_of(column: str, values: list) -> Expectation:
    return rows_where(f"{column} is known", F.col(column).isin(values))


def matches(column: str, pattern: str, least: float = 1.0) -> Expectation:
    return rows_where(f"{column} has its form", F.col(column).rlike(pattern), least)


def total(name: str, value: Column, low: float | None = None, high: float | None = None) -> Expectation:
    """An aggregate of the whole table within bounds; an aggregate that is null does not hold."""
    return Expectation(name, value=value, low=low, high=high)


_REPORT = "table string, expectation string, rows long, failed long, value double, ok boolean"


def observed(df: DataFrame, expectations: list[Expectation]) -> tuple[DataFrame, Observation]:
    """The table with its expectations hung on; whatever reads it first fills the observation."""
    watch = Observation()
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[a for k, e in enumerate(expectations) for a in e.aggregates(k)]), watch


def verdict(name: str, expectations: list[Expectation], numbers: dict) -> list[tuple]:
    """Report rows of one observation."""
    rows, out = numbers["rows"], []
    for k, e in enumerate(expectations):
        failed, value = numbers.get(f"failed_{k}"), numbers.get(f"value_{k}")
        if e.value is not None:
            ok = value is not None and (e.low is None or value >= e.low) and (e.high is None or value <= e.high)
        else:
            ok = rows - failed >= e.least * rows
        out.append((name, e.name, rows, failed, value, ok))
    return out


def report(tables: dict[str, tuple[DataFrame, list[Expectation]]]) -> DataFrame:
    """table, expectation, rows, failed, value, ok: each table is read once, for all its expectations."""
    found = []
    for name, (df, expectations) in tables.items():
        watched, watch = observed(df, expectations)
        watched.write.format("noop").mode("overwrite").save()
        found += verdict(name, expectations, watch.get)
    return df.sparkSession.createDataFrame(found, T.StructType.fromDDL(_REPORT))


def reconcile(ledger: DataFrame, actual: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Entries of a ledger that recomputed values do not bear out: keys, entry, stated, found; a side that lacks the keys is null."""
    pack = lambda df, n: df.select(*keys, F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(v).cast("double") for v in values])).alias(n))
    both = pack(ledger, "l").join(pack(actual, "a"), keys, "full_outer")
    rows = both.select(*keys, F.explode(F.array(*[F.lit(v) for v in values])).alias("entry"), "l", "a")
    rows = rows.select(*keys, "entry", F.col("l")[F.col("entry")].alias("stated"), F.col("a")[F.col("entry")].alias("found"))
    near = F.abs(F.col("stated") - F.col("found")) <= tolerance
    return rows.where(~F.coalesce(near, F.col("stated").isNull() & F.col("found").isNull()))


def assert_all(found: DataFrame) -> None:
    """Raise, naming them, if any expectation of a report failed."""
    failed = [f"{r.table}: {r.expectation} ({r.failed if r.value is None else r.value})" for r in found.where("NOT ok").collect()]  # one row per expectation
    if failed:
        raise AssertionError("; ".join(failed))
