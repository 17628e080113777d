"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; where it is unset, a folder of our own in local mode, as in tests.

    On a cluster an unset folder is an error: a temporary folder of the driver is not one that executors share.
    """
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        try:
            named = spark.conf.get("spark.checkpoint.dir")
        except PySparkException:
            if not re.fullmatch(r"local(\[[^,]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share") from None
            named = "file://" + tempfile.mkdtemp(prefix="mnemospark-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def settle(frame: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame) -> DataFrame:
    """A frame of fewer partitions than there are cores (one file, one row group) dealt over all of them; others as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


#: Rows of a few numbers each that one task takes, so that its sorts and hash tables stay near 100 MB however large the tables are.
ROWS_A_TASK = 250_000


def shares(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: at least one a core, no more than ROWS_A_TASK rows in each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds path, and path as it takes it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes what was written to path when the application ends."""
    system, there = file_system(spark, path)
    system.deleteOnExit(there)


def drop(spark: SparkSession, path: str) -> None:
    system, there = file_system(spark, path)
    system.delete(there, True)
