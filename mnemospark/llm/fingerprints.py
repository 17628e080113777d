"""Document fingerprints: threshold-scaled sketches of word shingles [native: DataFrame operations only].

A fingerprint retains every distinct shingle hash below a fixed fraction of the hash range, so that its size follows the
text's, unions of texts have the union of their fingerprints (``merge``), and containment is estimated without bias between
very unequal documents. A text with shingles of which none falls below the threshold retains its smallest hash, so that only
texts without words have empty fingerprints.

The query's neighbour, the next document by descending identifier, is found without a global window: identifiers alone
are range-partitioned, neighbours are taken inside each range, and one row for each range joins the ranges' ends. Each
text is then shuffled once, by its identifier; of the neighbour only the code points that the edit needs are sent, and its
fingerprint.

Defined cases: a null text counts as empty; texts without words have the empty fingerprint, likeness 1 with one another and
0 with others; fewer words than a shingle make one shingle; repeated identifiers each give a row, and stand for the next
document through the row of the least text hash; a null identifier is the smallest; very long texts are read whole; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, settle, shuffle_partitions, text_or_empty

#: Words of a shingle, and the share of the hash range that is retained (one in so many).
WORDS, SCALE = 5, 4
#: Stands for a null identifier: the least.
NO_ID = -(1 << 63)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the shingles of a text, in order, with repeats."""
    hashed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"[^{SPACE}]+"), F.lit(0)), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        rolled = F.transform(
            F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words)))
        )
        return F.when(n >= words, rolled).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))

    # A one-element transform binds the word hashes to a name: they are computed once.
    return F.element_at(F.transform(F.array(hashed), shingles), 1)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The fingerprint of a text: retained hashes, distinct and rising."""
    return retained(shingle_hashes(text, words), scale)


def retained(hashes: Column, scale: int = SCALE) -> Column:
    """Of some hashes those below the threshold, distinct and rising, or else the least."""
    most = -(1 << 63) + (1 << 64) // scale

    def retain(s: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(s, lambda h: h < most)))
        return F.when((F.size(low) > 0) | (F.size(s) == 0), low).otherwise(F.array(F.array_min(s)))

    return F.element_at(F.transform(F.array(hashes), retain), 1)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The fingerprint of two texts together (of their shingles), from their fingerprints."""
    return retained(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def shown(a: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), " ")


def neighbours(ids: DataFrame) -> DataFrame:
    """ids (id, n; ids distinct) with before_id, before_n: the row that has this one as its next by descending id.

    That is the next larger id; the largest is the next of the smallest.
    """
    spark = ids.sparkSession
    ranged = ids.repartitionByRange(shuffle_partitions(spark), "id")
    ranged = settle(ranged.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("id")
    here = F.struct("id", "n")
    # One row for each range: its least member, and so the following range's.
    least = ranged.groupBy("range").agg(F.min(here).alias("least"))
    ordered = Window.orderBy("range")
    following = least.select(
        "range",
        F.coalesce(F.lead("least").over(ordered), F.first("least").over(ordered)).alias("following"),
    )
    after = F.lead(here).over(inside)
    joined = ranged.withColumn("after", after).withColumn("has", F.lead(F.lit(True)).over(inside)).join(following, "range")
    before = F.when(F.col("has"), F.col("after")).otherwise(F.col("following"))
    return joined.select("id", before["id"].alias("before_id"), before["n"].alias("before_n"))


def with_next(docs: DataFrame) -> DataFrame:
    """id, text, patch, next_sketch: each row with what the edit and the comparison need of the next document.

    docs has no null id. Both uses of the placed rows read one shuffle of the texts by id: their joins have that key alone.
    """
    ids = docs.groupBy("id").agg(F.max(F.char_length("text")).alias("n"))
    ids = settle(neighbours(ids))
    placed = docs.join(ids, "id")
    sent = placed.select(
        F.col("before_id").alias("id"),
        F.xxhash64("text").alias("mark"),
        F.struct(
            F.substring("text", F.lit(1), F.floor(F.col("before_n") / 3).cast("int")).alias("patch"),
            sketch(F.col("text")).alias("next_sketch"),
        ).alias("sent"),
    )
    sent = sent.groupBy("id").agg(F.min_by("sent", "mark").alias("sent"))
    return placed.select("id", "text").join(sent, "id").select("id", "text", "sent.patch", "sent.next_sketch")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the query; see the module."""
    rows = with_next(docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text")))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("patch", F.lit(1), cut))
    rows = rows.select("id", "text", "next_sketch", n.alias("n"), edited.alias("edited"))
    rows = rows.select(
        "id", "n", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other")
    )
    return rows.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )


def op7_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
