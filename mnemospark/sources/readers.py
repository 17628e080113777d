"""Sources besides the store: conversation files, capability cards, graph imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_id

_CONVERSATION = "sessions array<struct<id:string,turns:array<struct<text:string,speaker:string>>>>"
_CARD = (
    "format string, name string, version string, type string, summary string, trigger string,"
    " resources array<struct<type:string,name:string,ref:string,description:string,config:map<string,string>>>,"
    " workflow struct<steps:array<struct<ref:string,action:string>>>"
)
_SESSION_TIME = r"(\d{1,2}):(\d{2}) ([ap]m) on (\d{1,2}) (\w+), (\d{4})"


def session_ms(session_id: Column) -> Column:
    """The time that a session identifier embeds ("session_1_1:56 pm on 8 May, 2023"), in milliseconds; null without one."""
    parts = [F.regexp_extract(session_id, _SESSION_TIME, i) for i in range(1, 7)]
    text = F.concat_ws(" ", parts[3], parts[4], parts[5], F.concat(parts[0], F.lit(":"), parts[1]), F.upper(parts[2]))
    return F.when(parts[5] != "", F.unix_millis(F.try_to_timestamp(text, F.lit("d MMMM yyyy h:mm a"))))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each turn of conversation files: session, turn, speaker, text, session_ms."""
    read = spark.read.schema(_CONVERSATION).option("multiLine", True).json(path)
    sessions = read.select(F.explode("sessions").alias("s"))
    turns = sessions.select(F.col("s.id").alias("session"), F.posexplode("s.turns").alias("turn", "t"))
    return turns.select("session", "turn", F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"), session_ms(F.col("session")).alias("session_ms"))


def capability_cards(spark: SparkSession, path: str) -> DataFrame:
    """Capability cards (files, or folders of capability.json) with the digest of their bytes; malformed ones are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    content = F.decode("content", "UTF-8")
    cards = files.select(F.from_json(content, _CARD, {"mode": "PERMISSIVE"}).alias("card"), F.sha2("content", 256).alias("file_hash"))
    return cards.where("card.name is not null").select("card.*", "file_hash").withColumn(
        "id", hash_id("capability:", F.lower(F.trim("name")))
    )


def new_cards(cards: DataFrame, stored: DataFrame) -> DataFrame:
    """Cards whose bytes are not stored yet: importing the same file again does nothing."""
    return cards.join(stored.where("file_hash is not null").select("file_hash").distinct(), "file_hash", "left_anti")


def next_topics(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as topics: a user turn with the agent's reply that follows it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    reply = F.lead(F.struct("role", "text")).over(order)
    return turns.withColumn("reply", reply).where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("user_text"), F.when(F.col("reply.role") == "assistant", F.col("reply.text")).alias("agent_text")
    )
