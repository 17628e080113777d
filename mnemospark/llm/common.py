"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop, drop_at_exit, settle, shared_folder  # noqa: F401

#: The white space of the contracts, as a regular expression class.
SPACE = r"\x20\x09-\x0D"


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors' Python workers, once for each Spark context."""
    import atexit
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_mnemospark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="mnemospark-code-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/mnemospark", "zip", package.parent, package.name))
    context._mnemospark_shipped = True


def tidy(batches: Iterator, rows: int = 1000) -> Iterator:
    """The batches in pieces of some rows, and behind the last one gives the memory that a task has freed back to the system.

    Python workers live on from task to task, and their allocators keep what was freed; beside the heap of an executor that
    is what adds up when stages of different needs follow each other.
    """
    import ctypes
    import gc

    import pyarrow as pa

    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by writing Parquet to the shared folder; narrower and compressed, unlike a checkpoint.

    The files go when the application ends; what no result reads can go before (dropped_after).
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._settled = path
    return found


class _Drops:
    def __init__(self):
        self.paths, self.tables = [], []

    def __call__(self, settled: DataFrame) -> DataFrame:
        """Marks a table of settle_table."""
        self.paths.append(settled._settled)
        return settled

    def table(self, name: str) -> None:
        self.tables.append(name)


@contextlib.contextmanager
def dropped_after(spark: SparkSession):
    """Inside, tables are marked that nothing reads once the block is left; then they are deleted."""
    drops = _Drops()
    try:
        yield drops
    finally:
        for name in drops.tables:
            spark.sql(f"drop table if exists {name}")
        for path in drops.paths:
            drop(spark, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
