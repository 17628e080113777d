"""Exact deduplication by a distributed content sort [native: DataFrame operations only].

Rows are range-partitioned by sampled splitters over the normalised text, sorted inside each range by the whole
normalised bytes (Spark's external sorter spills), and neighbours are compared in full. The splitter key is the first
code points of the normalised text, then a 64-bit hash of it, so that the sample of splitters stays small however long the
texts are, and a frequent beginning is cut into several ranges. Equal keys never fall into two ranges; texts of one
hash are told apart by the comparison, not by the hash. Of a run of equal texts the row that stays sorts first.

A text that holds more of a sample than half a partition's share is heavy: its rows get tie slots, a hash of the identifier and of the input
partition, behind the splitter key, so that a text with a third of all rows is dealt over many ranges. There are at most
two heavy texts for each partition. Of a heavy text, the first row of each slot keeps the text; these few rows meet by the
whole text again.

Defined cases: a null text counts as empty; texts of white space only are equal to it; repeated rows (same identifier)
each count as a member; a null identifier is the least; very long texts are compared whole; an empty table gives an empty
result; other columns are carried along only by ``dedup``, whatever their names. Of rows with equal text, length and identifier
but different other columns, ``dedup`` keeps the one of the least hash over all columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, settle_table, shuffle_partitions, text_or_empty

#: Code points of the normalised text in the splitter key.
PREFIX = 32
#: Share of the rows that heavy texts are looked for in, with its seed; rows there from which a text can be heavy.
SAMPLE, SEED, LEAST = 0.05, 7, 8

_KEYS = ["head", "mark", "slot"]


def heavy_marks(marked: DataFrame, partitions: int) -> DataFrame:
    """mark: of texts that hold more than half a partition's share of a sample of marked."""
    counts = marked.sample(SAMPLE, SEED).groupBy("mark").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.agg(F.sum("c")).first()[0] or 0
    return counts.where(F.col("c") >= max(LEAST, -(-rows // (2 * partitions)))).select("mark", F.lit(True).alias("heavy"))


def in_content_order(docs: DataFrame, id_col: str, text_col: str, mark: Callable[[Column], Column], carry: bool) -> DataFrame:
    """id, points, head, mark, slot, norm, starts (1 at the first row of a run of equal texts, which is the row to keep), run and,
    if carry, row: the columns of docs. Slot 0 is for texts that are not heavy."""
    partitions = shuffle_partitions(docs.sparkSession)
    norm = F.regexp_replace(text_or_empty(text_col), f"[{SPACE}]+", "")
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text_or_empty(text_col)).alias("points"), norm.alias("norm"), *row)
    rows = rows.withColumn("mark", mark(F.col("norm")))
    slots = max(64, partitions)
    slot = F.when(F.col("heavy"), F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(slots)) + 1).otherwise(0).cast("int")
    # At most two heavy texts for a partition: the broadcast has so many rows of one number.
    rows = rows.join(F.broadcast(heavy_marks(rows, partitions)), "mark", "left").withColumn("slot", slot).drop("heavy")
    rows = rows.withColumn("head", F.substring("norm", 1, PREFIX)).repartitionByRange(partitions, *_KEYS)
    # The range partitioning already clusters these keys: the window adds a sort, no exchange.
    ties = [F.xxhash64("row")] if carry else []
    inside = Window.partitionBy(*_KEYS).orderBy("norm", F.col("points").desc(), "id", *ties)
    rows = rows.withColumn("starts", F.when(F.lag("norm").over(inside).eqNullSafe(F.col("norm")), 0).otherwise(1))
    return rows.withColumn("run", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _mark(norm: Column) -> Column:
    return F.xxhash64(norm)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Callable[[Column], Column] = _mark) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. mark: the hash behind the splitter key."""
    ordered = in_content_order(docs, id_col, text_col, mark, False)
    keys = [*_KEYS, "run"]
    shown = F.when((F.col("slot") > 0) & (F.col("starts") == 1), F.col("norm")).alias("shown")
    member = ordered.select("id", "points", *keys, F.sha2("norm", 256).alias("digest"), shown)
    here = Window.partitionBy(*keys)
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").alias("id")))
    member = member.withColumn("best", best.over(here)).withColumn("n", F.count(F.lit(1)).over(here))
    member = settle_table(member.drop("points"), "exact-members")
    # The runs of a heavy text in its slots meet by the whole text.
    same = Window.partitionBy("shown")
    runs = member.where("shown is not null")
    runs = runs.select(*keys, F.min("best").over(same).alias("all_best"), F.sum("n").over(same).alias("all_n"))
    light = member.where("slot = 0").select("id", "digest", "best", "n")
    heavy = member.where("slot > 0").join(runs, keys).select("id", "digest", F.col("all_best").alias("best"), F.col("all_n").alias("n"))
    return light.unionByName(heavy).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns; texts move once."""
    first = in_content_order(docs, id_col, text_col, _mark, True).where("starts = 1")
    # Of a heavy text there is a first row in each slot: at most as many as slots.
    text = F.when(F.col("slot") > 0, F.col("norm")).alias("text")
    first = settle_table(first.select("row", "slot", "points", "id", text), "exact-firsts")
    place = Window.partitionBy("text").orderBy(F.col("points").desc(), "id", F.xxhash64("row"))
    heavy = first.where("slot > 0").withColumn("place", F.row_number().over(place)).where("place = 1")
    return first.where("slot = 0").select("row.*").unionAll(heavy.select("row.*"))


def op2_exact_dedup(spark, sf_dir):
    return groups(documents(spark, sf_dir))


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents),
g as (
  select norm, count(*) as group_size, first(doc_id order by length(text) desc, doc_id) as keep_id from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g using (norm)
"""
