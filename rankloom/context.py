"""Session facts that operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as tests do.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/rankloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(where)
    # with its scheme, so that Spark and other readers mean the same store
    return re.sub("^file:/+", "file:///", system.makeQualified(where).toString())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it where it is used more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: texts can be long, so batches stay shorter than Spark's 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches of texts short, unless someone has set their size. The setting counts when a plan runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores where the input comes in fewer pieces, as a file of one row group does; texts are worth the move then.

    An input of as many partitions as there are cores stays where it is, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
