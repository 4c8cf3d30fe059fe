"""Samples for fitting a classifier: bounded, decided by hashes of ids, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import fresh
from rankloom.llm.storage import stash


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def stratified(df: DataFrame, stratum: str, per_stratum: int, most_chars: int, chars: Column, key: str = "doc_id") -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum``, but no more than about ``most_chars`` of ``chars`` in all: those
    whose hashed key falls below the value's rate.

    The rates come from one count per value, so nothing is sorted and no task sees a whole stratum. Rows with a
    null stratum or key are left out.
    """
    rate, name = fresh(df, "sample_rate", "sample_stratum")
    df = df.where(F.col(stratum).isNotNull() & F.col(key).isNotNull())
    counts = df.groupBy(F.col(stratum).alias(name)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))
    rates = stash(counts.select(name, F.least(F.lit(1.0), per_stratum / F.col("n"), most_chars / F.greatest("chars", F.lit(1))).alias(rate)), "rates")
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_003)) / 1_000_003
    return df.join(rates, df[stratum] == rates[name]).where(chance < F.col(rate)).drop(rate, name)
