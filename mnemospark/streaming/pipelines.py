"""Structured Streaming forms of ingestion: usage counters, sequence numbers, consolidation triggers, idle sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import hash_id


def ingest_messages(messages: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to ingest(batch, batch_id), which must be idempotent by batch id."""
    writer = messages.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def archive_rows(messages: DataFrame) -> DataFrame:
    """Messages (context_id, role, content, created_at) as archive records; the id makes replays harmless."""
    return messages.withColumn("id", hash_id(F.col("context_id"), ":", F.col("created_at"), ":", F.col("content")))


def usage_counters(hits: DataFrame) -> DataFrame:
    """Streaming counts by scene (scene_id, ts in ms): use output mode update or complete."""
    return hits.groupBy("scene_id").agg(F.count(F.lit(1)).alias("hit_count"), F.max("ts").alias("last_hit_at"))


def windowed_events(events: DataFrame, window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Counts by time window and event type; events later than lateness are dropped. ts may lack a zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window, slide or window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def idle_sessions(activity: DataFrame, gap: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """Sessions (key, start, end, turns) that end after a gap without activity: each asks for a consolidation."""
    timed = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    grouped = timed.groupBy("key", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("turns"))
    return grouped.select("key", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "turns")


class _Sequence(StatefulProcessor):
    """Numbers the events of a session; rows of a micro-batch in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["timestamp", "pos"], kind="stable")
        last = self._last.get()[0] if self._last.exists() else 0
        batch["seq"] = range(last + 1, last + 1 + len(batch))
        self._last.update((last + len(batch),))
        yield batch[["session_id", "seq", "event_type", "payload", "timestamp"]]

    def close(self) -> None:
        pass


def sequence_numbers(events: DataFrame) -> DataFrame:
    """events (session_id, event_type, payload, timestamp, pos) with seq; needs the RocksDB state store."""
    return events.groupBy("session_id").transformWithStateInPandas(
        _Sequence(), "session_id bigint, seq bigint, event_type string, payload string, timestamp bigint", "append", "none"
    )


class _EveryTurns(StatefulProcessor):
    """Emits a row each time a key has had so many more turns."""

    def __init__(self, every: int):
        self._every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._count = handle.getValueState("count", "turns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._count.get()[0] if self._count.exists() else 0
        after = before + sum(len(r) for r in rows)
        self._count.update((after,))
        due = range(before // self._every + 1, after // self._every + 1)
        yield pd.DataFrame({"scene_id": [key[0]] * len(due), "turns": [n * self._every for n in due]}, dtype="int64")

    def close(self) -> None:
        pass


def consolidation_triggers(turns: DataFrame, every: int = 20) -> DataFrame:
    """scene_id, turns: one row whenever a scene has had another so many turns."""
    return turns.groupBy("scene_id").transformWithStateInPandas(_EveryTurns(every), "scene_id bigint, turns bigint", "append", "none")
