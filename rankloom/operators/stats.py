"""Paired statistics: exact tests in Spark SQL, bootstraps over pre-aggregated clusters."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESAMPLES, SEED = 10_000, 7


def log_factorial_sum(n: Column, k: Column) -> Column:
    """log of (n choose k), as a sum of logs."""
    one = lambda c: F.when(c < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(c, F.lit(2)).cast("long")), F.lit(0.0), lambda s, x: s + F.log(x.cast("double"))))
    return one(n) - one(k) - one(n - k)


def mcnemar(wins: Column, losses: Column, no_discordance: float | None = 1.0) -> Column:
    """Two-sided exact McNemar test: twice the binomial tail of the smaller count, at most 1."""
    n, low = wins + losses, F.least(wins, losses)
    # terms of the tail relative to the first, so that no factorial is repeated: C(n, j) / C(n, j-1) = (n - j + 1) / j
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1)).cast("long"))
    running = F.aggregate(
        steps, F.struct((-n * math.log(2)).alias("t"), F.exp(-n * math.log(2)).alias("s")),
        lambda a, j: F.struct((a["t"] + F.log((n - j + 1) / j)).alias("t"), (a["s"] + F.when(j <= low, F.exp(a["t"] + F.log((n - j + 1) / j))).otherwise(0.0)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(n == 0, F.lit(no_discordance)).otherwise(F.least(F.lit(1.0), 2 * running))


#: Clusters whose signs one row takes in full, as two sorted halves of 2^20 sums; the signs of the others are dealt out as rows.
MIDDLE = 40


def _signed_sums(values: np.ndarray) -> np.ndarray:
    """All 2^n sums of the values with either sign, in order: two sorted lists are merged per value."""
    sums = np.zeros(1)
    for x in values:
        sums = np.sort(np.concatenate([sums - x, sums + x]), kind="stable")
    return sums


@F.pandas_udf(T.DoubleType())
def share_of_signs(values: pd.Series, offset: pd.Series, reach: pd.Series) -> pd.Series:
    """Share of the sign assignments of ``values`` whose sum with ``offset`` is at least ``reach`` from zero."""

    def one(v: np.ndarray, c: float, t: float) -> float:
        low, high = _signed_sums(v[: len(v) // 2]), _signed_sums(v[len(v) // 2 :])
        above = len(low) * len(high) - int(np.searchsorted(low, t - c - high, "left").sum())  # sums of a half against the other's
        below = int(np.searchsorted(low, -t - c - high, "right").sum())
        return (above + below) / (len(low) * len(high)) if t > 0 else 1.0

    return pd.Series([one(np.asarray(v, float), c, t) for v, c, t in zip(values, offset, reach, strict=True)])


def sign_flip(clusters: DataFrame, by: list[str], value: str, cluster: str) -> DataFrame:
    """Exact cluster sign-flip test: share of all sign assignments whose absolute sum reaches the observed one (less 1e-12).

    ``clusters`` has one row per cluster. Up to 40 clusters meet in the middle: the sums of both halves are sorted, and for every sum of
    one the other's that complete it are counted by their place, 2^20 steps for 2^40 assignments. Of more clusters, the signs beyond
    the fortieth are rows that tasks share.
    """
    packed = clusters.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(cluster, value))), lambda x: x[value].cast("double")).alias("v"), F.count(F.lit(1)).alias("k"))
    observed = F.abs(F.aggregate("v", F.lit(0.0), lambda s, x: s + x))
    more = F.greatest(F.col("k") - MIDDLE, F.lit(0)).cast("int")
    rows = packed.select(*by, "k", observed.alias("observed"), F.slice("v", F.lit(1), F.lit(MIDDLE)).alias("inner"), F.slice("v", F.lit(MIDDLE + 1), F.greatest(more, F.lit(0))).alias("outer"), more.alias("more"))
    rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, more) - 1L"))))
    offset = F.aggregate(F.transform("outer", lambda x, i: x * (1 - 2 * F.getbit(F.col("mask"), i).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("p", share_of_signs(F.col("inner"), offset, F.col("observed") - 1e-12))
    return rows.groupBy(*by).agg(F.max("k").alias("clusters"), F.round(F.max("observed"), 9).alias("observed"), F.round(F.avg("p"), 9).alias("p"))


def percentile_linear(values: list[float], q: float) -> float:
    if not values:
        return float("nan")
    values = sorted(values)
    at = (len(values) - 1) * q
    low = math.floor(at)
    return values[low] if low == math.ceil(at) else values[low] * (1 - (at - low)) + values[math.ceil(at)] * (at - low)


def percentile_index(values: list[float], q: float) -> float:
    values = sorted(values)
    return values[min(len(values) - 1, int(len(values) * q))] if values else float("nan")


def cluster_interval(sums: dict[str, tuple[float, int]], resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """95 % interval of the mean under resampling of clusters with replacement; clusters in name order, MT19937 choices."""
    rng, names, draws = random.Random(seed), sorted(sums), []
    for _ in range(resamples):
        picked = [sums[rng.choice(names)] for _ in names]
        draws.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    return percentile_linear(draws, 0.025), percentile_linear(draws, 0.975)


def two_group_interval(sums: dict[str, tuple[float, int, float, int]], resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """The same for the difference of two groups' means; draws that miss a group are skipped."""
    rng, names, draws = random.Random(seed), sorted(sums), []
    for _ in range(resamples):
        picked = [sums[rng.choice(names)] for _ in names]
        a, na, b, nb = (sum(p[k] for p in picked) for k in range(4))
        if na and nb:
            draws.append(a / na - b / nb)
    return percentile_linear(draws, 0.025), percentile_linear(draws, 0.975)


def iid_interval(values: list[float], resamples: int = RESAMPLES, seed: int = SEED, index: bool = True) -> tuple[float, float]:
    """Interval of the mean under resampling of single values, by truncated index or interpolation."""
    rng, n, pick = random.Random(seed), len(values), percentile_index if index else percentile_linear
    draws = [sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples)] if n else []
    return pick(draws, 0.025), pick(draws, 0.975)


def numpy_interval(values: list[float], resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """The same with numpy's generator, all draws at once."""
    rng, v = np.random.default_rng(seed), np.asarray(values, float)
    if not len(v):
        return float("nan"), float("nan")
    means = v[rng.integers(0, len(v), (resamples, len(v)))].mean(1)
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def clustered_bootstrap(pairs: DataFrame, by: list[str], cluster: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Mean difference and clustered interval per group of ``pairs`` (baseline, treatment).

    Only (cluster, sum, count) rows reach a Python task, one small table per group.
    """
    sums = pairs.groupBy(*by, cluster).agg(F.sum(F.col("treatment") - F.col("baseline")).alias("s"), F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in by) + ", delta double, low double, high double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = cluster_interval({str(k): (float(s), int(n)) for k, s, n in zip(rows[cluster], rows["s"], rows["n"], strict=True)}, resamples, seed)
        return pd.DataFrame([[*rows[by].iloc[0], rows["s"].sum() / rows["n"].sum(), low, high]], columns=[*by, "delta", "low", "high"])

    return sums.groupBy(*by).applyInPandas(run, schema)


def paired_table(pairs: DataFrame, by: list[str], cluster: str, resamples: int = RESAMPLES) -> DataFrame:
    """Delta, clustered interval, wins, losses and exact p per group."""
    from rankloom.operators.metrics import contrast

    counts = contrast(pairs, by).drop("delta")
    return clustered_bootstrap(pairs, by, cluster, resamples).join(counts, by).withColumn("p", F.round(mcnemar(F.col("wins"), F.col("losses")), 12))


def sign_flip_summary(pairs: DataFrame, by: list[str], cluster: str, denominator: str | None = None) -> DataFrame:
    """Mean difference over all rows (or over a summed denominator), numbers of clusters above, at and below zero, and the sign-flip p."""
    total = F.sum(denominator) if denominator else F.count(F.lit(1))
    sums = pairs.groupBy(*by, cluster).agg(F.sum(F.col("treatment") - F.col("baseline")).alias("d"), total.alias("w"))
    signs = sums.groupBy(*by).agg(F.round(F.sum("d") / F.sum("w"), 9).alias("delta"), F.count_if(F.col("d") > 1e-12).alias("positive"), F.count_if(F.abs("d") <= 1e-12).alias("zero"), F.count_if(F.col("d") < -1e-12).alias("negative"))
    return signs.join(sign_flip(sums, by, "d", cluster).select(*by, "clusters", "p"), by)


def all_contrasts(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Every unordered pair of variants: wins and losses of the second over the first on a 0/1 outcome."""
    long = reduce(DataFrame.unionByName, [df.select(key, F.col(value).alias("v"), F.lit(n).alias("variant")) for n, df in frames.items()])
    b = long.select(key, F.col("v").alias("w"), F.col("variant").alias("other"))
    both = long.join(b, key).where("variant < other")
    return both.groupBy("variant", "other").agg(F.count_if(F.col("w") > F.col("v")).alias("wins"), F.count_if(F.col("w") < F.col("v")).alias("losses")).withColumn("p", F.round(mcnemar(F.col("wins"), F.col("losses")), 9))
