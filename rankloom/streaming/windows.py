"""Event-time windows as streams and as batches, deduplication and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, files: str = "*", files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder whose names match ``files``, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(folder)


def watermarked(events: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """Watermarks need a zoned time; a time without zone is read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, window: Column, keys: list[str], values: dict[str, Column], late: str | None = None, time: str = "ts") -> DataFrame:
    """Aggregates per time window and key; with ``late``, rows later than that behind the watermark are dropped."""
    rows = watermarked(events, late, time) if late else events
    out = rows.groupBy(window.alias("w"), *keys).agg(*[v.alias(n) for n, v in values.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *values)


def tumbling(events: DataFrame, width: str, keys: list[str], values: dict[str, Column], late: str | None = None) -> DataFrame:
    return windowed(events, F.window("ts", width), keys, values, late)


def sliding(events: DataFrame, width: str, step: str, keys: list[str], values: dict[str, Column], late: str | None = None) -> DataFrame:
    return windowed(events, F.window("ts", width, step), keys, values, late)


def sessions(events: DataFrame, gap: str, keys: list[str], values: dict[str, Column], late: str | None = None) -> DataFrame:
    return windowed(events, F.session_window("ts", gap), keys, values, late)


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First of the rows with equal keys within the watermark."""
    return watermarked(events, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write Parquet exactly once, and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def upkeep(df: DataFrame, checkpoint: str, merge) -> None:
    """Hand every micro-batch to ``merge(batch, id)``, which must give the same result when a batch comes twice."""
    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
