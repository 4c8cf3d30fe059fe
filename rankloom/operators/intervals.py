"""Joins of points and intervals: innermost, enclosing, overlapping, nearest; islands of consecutive numbers.

Joins are equi-joins on a group plus a range. Where groups are large, positions are cut into bins of a given ``width``
so that the range turns into an equi-join as well: an interval is listed in every bin it touches, a point in one. Without a width all pairs
of a group are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def point_in_interval(points: DataFrame, intervals: DataFrame, group: str, point: str = "point", start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Pairs of a point and an interval of its group that holds it, ends included."""
    if width is None:
        return points.join(intervals, group).where(F.col(point).between(F.col(start), F.col(end)))
    binned = intervals.where(F.col(start) <= F.col(end)).withColumn("bin", _bins(F.col(start), F.col(end), width))
    return points.withColumn("bin", F.floor(F.col(point) / width)).join(binned, [group, "bin"]).where(F.col(point).between(F.col(start), F.col(end))).drop("bin")


def innermost(points: DataFrame, intervals: DataFrame, group: str, point: str = "point", start: str = "start", end: str = "end", tie: tuple[Column | str, ...] = (), first: tuple[Column | str, ...] = (), width: int | None = None) -> DataFrame:
    """For each point the smallest interval that holds it; ``first`` sorts before the span, then the later start and ``tie``."""
    found = point_in_interval(points, intervals, group, point, start, end, width)
    order = Window.partitionBy(group, point).orderBy(*first, F.col(end) - F.col(start), F.col(start).desc(), *tie)
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def enclosing(inner: DataFrame, outer: DataFrame, group: str, key: str, start: str = "start", end: str = "end", prefix: str = "outer_", width: int | None = None) -> DataFrame:
    """For each inner interval the smallest outer one of its group that contains it; of equal spans the first by position."""
    o = outer.select(group, *[F.col(c).alias(prefix + c) for c in outer.columns if c != group])
    held = point_in_interval(inner, o, group, start, prefix + start, prefix + end, width).where(F.col(end) <= F.col(prefix + end))
    order = Window.partitionBy(group, key).orderBy(F.col(prefix + end) - F.col(prefix + start), prefix + start, prefix + "name")
    return held.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def overlapping(left: DataFrame, right: DataFrame, group: str, prefix: str = "other_", width: int | None = None) -> DataFrame:
    """Pairs of intervals (start, end) of one group that share a point. In bins a pair counts where the later of both starts."""
    o = right.select(group, *[F.col(c).alias(prefix + c) for c in right.columns if c != group])
    share = (F.col("start") <= F.col(prefix + "end")) & (F.col(prefix + "start") <= F.col("end"))
    if width is None:
        return left.join(o, group).where(share)
    binned = left.where("start <= end").withColumn("bin", _bins(F.col("start"), F.col("end"), width))
    other = o.where(F.col(prefix + "start") <= F.col(prefix + "end")).withColumn("bin", _bins(F.col(prefix + "start"), F.col(prefix + "end"), width))
    return binned.join(other, [group, "bin"]).where(share & (F.col("bin") == F.floor(F.greatest("start", prefix + "start") / width))).drop("bin")


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Distance of two intervals, 0 when they overlap."""
    return F.greatest(F.lit(0).cast("long"), a_start - b_end, b_start - a_end)


def least_gap(intervals: DataFrame, group: str, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """For each interval the distance to the nearest other one of its group, 0 when they overlap; none for one alone.

    ``key`` tells a group's intervals apart; repeated rows count once. Of those that start no later only the latest end
    matters, of those that start no earlier only the next: one running window, no pairs.
    """
    rows = intervals.select(group, key, start, end).distinct()
    order = Window.partitionBy(group).orderBy(start, key)
    before = F.col(start) - F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(start).over(order) - F.col(end)
    found = rows.withColumn("gap", F.least(before, after)).where("gap IS NOT NULL")
    return found.select(group, key, F.greatest(F.lit(0).cast("long"), "gap").alias("gap"))


def nearest(left: DataFrame, right: DataFrame, group: str, left_time: str, right_time: str, tie: str) -> DataFrame:
    """For each left row the right row of its group that is nearest in time, before or after; ties to the earlier, then ``tie``.

    Two running windows over the union of both sides find the last row before and the first after, so no pairs are made.
    """
    left = left.withColumn("side", F.lit(1)).withColumn("t", F.col(left_time))
    struct = F.struct(*[F.col(c) for c in right.columns])
    r = right.select(group, F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), struct.alias("hit"))
    l = left.select(group, "t", "side", F.lit(None).cast(right.schema[tie].dataType).alias("tie"), F.lit(None).cast(r.schema["hit"].dataType).alias("hit"), F.struct(*[c for c in left.columns if c not in ("side", "t")]).alias("row"))
    both = r.withColumn("row", F.lit(None).cast(l.schema["row"].dataType)).unionByName(l)
    # among equal times the smallest tie is the one seen last before the left row, and first after it
    before = F.last("hit", ignorenulls=True).over(Window.partitionBy(group).orderBy("t", "side", F.col("tie").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("hit", ignorenulls=True).over(Window.partitionBy(group).orderBy("t", F.col("side").desc(), "tie").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("b", before).withColumn("a", after).where("side = 1")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) if dict(right.dtypes)[right_time].startswith("timestamp") else c
    to_b, to_a = seconds(F.col("t")) - seconds(F.col("b")[right_time]), seconds(F.col("a")[right_time]) - seconds(F.col("t"))
    pick = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & (to_b <= to_a)), F.col("b")).otherwise(F.col("a"))
    out = found.select("row.*", pick.alias("pick"))
    return out.where("pick IS NOT NULL").select(*[c for c in left.columns if c not in ("side", "t")], *[F.col(f"pick.{c}").alias(c) for c in right.columns if c != group])


def islands(df: DataFrame, group: str | list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: first, last and length of each."""
    keys = [group] if isinstance(group, str) else group
    rows = df.select(*keys, number).distinct().withColumn("base", F.col(number) - F.row_number().over(Window.partitionBy(keys).orderBy(number)))
    return rows.groupBy(*keys, "base").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("length")).drop("base")
