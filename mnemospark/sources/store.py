"""Changelog tables: append-only Parquet per record type, latest version wins, tombstones delete.

A table is a folder of commits, one subfolder ``commit=<number>`` each, written by Spark; a commit counts once its marker
file lies in ``_commits``. Readers list markers, so a torn commit is never seen. Within a commit the row order column ``seq``
decides. Current state, recovery and compaction are plain queries over the changelog, so nothing needs to be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import validate_tenant
from ..errors import CLOSED, CORRUPTION, IO, NOT_FOUND, MemoryError_
from ..schema import SCHEMAS, VERSION

UPSERT, DELETE = "U", "D"


def latest(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("commit", "seq")) -> DataFrame:
    """The newest row of each key, tombstones included. An aggregate, not a window: it combines before the shuffle."""
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return log.groupBy(key).agg(newest).select(key, *(F.col(f"newest.{c}").alias(c) for c in rest))


def current(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("commit", "seq")) -> DataFrame:
    """The live rows of a changelog."""
    return latest(log, key, order).where(F.col("op") != DELETE)


def deleted_payloads(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("commit", "seq")) -> DataFrame:
    """Of keys whose newest row is a tombstone, the newest row that is none."""
    rest = [c for c in log.columns if c != key]
    place = F.struct(*order)
    live = F.max_by(F.when(F.col("op") != DELETE, F.struct(*rest)), F.when(F.col("op") != DELETE, place)).alias("live")
    found = log.groupBy(key).agg(live, F.max_by("op", place).alias("last_op")).where(f"last_op = '{DELETE}' and live is not null")
    return found.select(key, *(F.col(f"live.{c}").alias(c) for c in rest))


def tombstones(live: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows to delete: those of ids that are live; others are skipped."""
    return live.select(key).join(ids.select(key).distinct(), key, "left_semi")


class Store:
    """The tables of one tenant below a folder of any Hadoop file system. One writer at a time: the lock file says so."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default", create: bool = True):
        self.spark, self.path = spark, f"{root}/{validate_tenant(tenant)}"
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.closed = False
        version = self._path("_version")
        if not self._fs.exists(version):
            if not create:
                raise MemoryError_(NOT_FOUND, f"no store at {self.path}")
            self._fs.mkdirs(self._path(""))
            self._write(version, str(VERSION))
        elif self._read(version) != str(VERSION):
            raise MemoryError_(CORRUPTION, "the store has another format version")
        self._lock = self._path("_lock")
        if not self._fs.createNewFile(self._lock):
            raise MemoryError_(IO, f"{self.path} is open elsewhere")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _check(self) -> None:
        if self.closed:
            raise MemoryError_(CLOSED, "the store is closed")

    def commits(self, table: str) -> list[int]:
        """Numbers of the table's complete commits, rising."""
        folder = self._path(f"{table}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder))

    def _schema(self, table: str) -> StructType:
        return _parse_datatype_string(SCHEMAS[table] + ", op string, seq bigint")

    def append(self, table: str, rows: DataFrame, op: str = UPSERT) -> int:
        """One commit of upserts or tombstones; fields that rows lacks are null. Returns its number."""
        self._check()
        number = max(self.commits(table), default=0) + 1
        have = set(rows.columns)
        columns = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(table).fields[:-2]]
        seq = F.col("seq").cast("long") if "seq" in have and table != "trajectory" else F.monotonically_increasing_id()
        rows.select(*columns, F.lit(op).alias("op"), seq.alias("log_seq")).write.mode("overwrite").parquet(f"{self.path}/{table}/commit={number}")
        self._write(self._path(f"{table}/_commits/{number}"), "")
        return number

    def delete(self, table: str, ids: DataFrame) -> int:
        """Tombstones for the live ones of ids; returns how many."""
        gone = tombstones(self.table(table), ids).cache()
        count = gone.count()
        if count:
            self.append(table, gone, DELETE)
        gone.unpersist()
        return count

    def log(self, table: str) -> DataFrame:
        """The changelog, with commit and log_seq."""
        self._check()
        fields = SCHEMAS[table] + ", op string, log_seq bigint"
        done = self.commits(table)
        if not done:
            return self.spark.createDataFrame([], fields + ", commit bigint")
        read = self.spark.read.schema(fields).option("basePath", f"{self.path}/{table}")
        found = read.parquet(*(f"{self.path}/{table}/commit={n}" for n in done))
        return found.withColumn("commit", F.col("commit").cast("long"))

    def table(self, table: str) -> DataFrame:
        """Live records, with the fields of the schema."""
        return current(self.log(table), order=("commit", "log_seq")).drop("op", "log_seq", "commit")

    def read(self, table: str, id_: int) -> dict:
        """One record or a not-found error; the identifier's filter reaches the scan."""
        row = current(self.log(table).where(F.col("id") == id_), order=("commit", "log_seq")).drop("op", "log_seq", "commit").first()
        if row is None:
            raise MemoryError_(NOT_FOUND, f"no {table} {id_ & (1 << 64) - 1:016x}")
        return row.asDict(recursive=True)

    def contains(self, table: str, id_: int) -> bool:
        return not current(self.log(table).where(F.col("id") == id_), order=("commit", "log_seq")).isEmpty()

    def count(self) -> int:
        """Live records of all tables."""
        return sum(self.table(t).count() for t in SCHEMAS if self.commits(t))

    def size(self) -> int:
        """Bytes of the store."""
        return self._fs.getContentSummary(self._path("")).getLength()

    def deleted(self, table: str) -> DataFrame:
        return deleted_payloads(self.log(table), order=("commit", "log_seq")).drop("op", "log_seq", "commit")

    def restore(self, table: str) -> int:
        """Appends what was deleted again; returns how many."""
        gone = self.deleted(table).cache()
        count = gone.count()
        if count:
            self.append(table, gone)
        gone.unpersist()
        return count

    def compact(self, table: str) -> int:
        """Rewrites the live records as one new commit and drops the older ones."""
        self._check()
        old = self.commits(table)
        if not old:
            return 0
        number = self.append(table, self.table(table))
        for n in old:  # markers first: a reader never finds a marker without its data
            self._fs.delete(self._path(f"{table}/_commits/{n}"), False)
            self._fs.delete(self._path(f"{table}/commit={n}"), True)
        return number

    def save_derived(self, name: str, frame: DataFrame, keep: int = 1) -> str:
        """Materialises a derived table as its newest version and keeps only so many versions."""
        self._check()
        folder = self._path(f"_derived/{name}")
        versions = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        number = (versions[-1] if versions else 0) + 1
        path = f"{self.path}/_derived/{name}/{number}"
        frame.write.parquet(path)
        for n in versions[: max(0, len(versions) + 1 - keep)]:
            self._fs.delete(self._path(f"_derived/{name}/{n}"), True)
        return path

    def derived(self, name: str) -> DataFrame:
        """The newest complete version of a derived table."""
        folder = self._path(f"_derived/{name}")
        versions = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        done = [n for n in versions if self._fs.exists(self._path(f"_derived/{name}/{n}/_SUCCESS"))]
        if not done:
            raise MemoryError_(NOT_FOUND, f"no derived table {name}")
        return self.spark.read.parquet(f"{self.path}/_derived/{name}/{done[-1]}")

    def close(self) -> None:
        if not self.closed:
            self._fs.delete(self._lock, False)
            self.closed = True
