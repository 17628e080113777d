"""Mixing sources to target weights by a low-discrepancy schedule [native: DataFrame operations only].

Sources are weighed, their targets water-filled below a cap, and a schedule of slots is laid out: slot n takes the point
frac(n * golden ratio), maps it through the cumulative weights to a source, and its rank among that source's slots says
which block of the source's stream it plays. A source's stream is its documents in a hashed order, laid end to end and
repeated; it is cut into blocks of equal tokens. Joining slots with blocks gives, for each document, the tokens that the
mix takes, and the first slot that plays it. A source's last slot is cut short so that it meets its target to the token.

Nothing is ranked in one task by source: ranks and running sums are taken inside bounded buckets (of slot numbers, of
the documents' hash) and shifted by the sums of the buckets before, so a source with a third of all rows is dealt over
all tasks. Tables by source have one row for each distinct source.

Defined cases: a null text has size 0; a document of size 0 takes 0; a null source is a source of its own, last in the
order; repeated rows are separate documents; rows of one identifier and different texts are different documents; a very
long text is cut into as many blocks as it reaches; columns of other names are not read; an empty table gives an empty
result. Results depend on the rows alone, not on partitioning, so that reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, settle, settle_table, text_or_empty

GOLDEN = (math.sqrt(5) - 1) / 2
#: Tokens of a block at most, and blocks that the mix has at least (where it has as many tokens).
BLOCK, LEAST_BLOCKS = 4096, 20_000
#: What tells documents apart; twin counts equal rows.
_ROW = ["id", "source", "size", "mark", "twin"]


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, mark (a hash of the text) and place: a hash that orders the documents of a source."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(f"[^{SPACE}]+")).cast("long")
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(text_col).alias("mark"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit("mix")).alias("place"),
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_size, docs, target, take (whole tokens), low and high (the source's span of the unit interval).

    Water-filling in closed form: by rising cap/weight, a source is full while its cap is below its share of what the
    sources before it leave. The input has a row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    table = table.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = (
        table.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("rest_size", F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("most") * F.col("rest_weight") <= F.col("rest_size") * F.col("weight"))
    )
    # The first source that is not full ends the filling; all later ones share what is left there.
    open_ = F.when(~F.col("full"), F.struct("ratio", F.col("source").isNull(), "source", "rest_size", "rest_weight"))
    table = table.withColumn("open", F.min(open_).over(everything))
    target = F.when(
        F.col("open").isNull() | F.col("full"), F.col("most")
    ).otherwise(F.col("weight") * F.col("open.rest_size") / F.col("open.rest_weight"))
    table = table.withColumn("target", F.least(target, F.col("most")))
    table = table.withColumn("take", F.round("target").cast("long"))
    upto = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        table.withColumn("all_take", F.sum("take").over(everything))
        .withColumn("high", F.sum("take").over(upto) / F.greatest(F.col("all_take"), F.lit(1)))
        .withColumn("low", (F.sum("take").over(upto) - F.col("take")) / F.greatest(F.col("all_take"), F.lit(1)))
        .select("source", "source_size", "docs", "target", "take", "low", "high", "all_take")
    )


def schedule(spark, targets: DataFrame, tokens: int, sources: int, block: int) -> DataFrame:
    """source, rank: the slots of the mix; slot of rank r plays tokens [r * block, (r + 1) * block) of the stream.

    Golden-ratio points fill every interval to within O(log n) points, and the margin is for that; it is shared by weight,
    though, so that a source of a small share can still have too few points, or none. A source needs ceil(take / block)
    slots: ranks past that are cut, and ranks that the points left out are added behind the last slot.
    """
    slots = tokens // block + 1
    slots += int(sources * (8 + 4 * math.log2(slots + 2)))
    point = F.col("n") * F.lit(GOLDEN)
    cells = 1024
    drawn = spark.range(slots).withColumnRenamed("id", "n").withColumn("point", point - F.floor(point))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    spans = targets.where("take > 0").select("source", "take", "low", "high")
    # The unit interval in cells: a slot meets only the sources that reach into its cell.
    first, last = F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    drawn = drawn.join(spans, "cell").where("point >= low and point < high")
    # A rank within (source, bucket of slot numbers), shifted by the buckets before.
    drawn = drawn.withColumn("bucket", F.floor(F.col("n") / math.ceil(math.sqrt(slots))))
    key = [F.col("source"), F.col("bucket")]
    inner = drawn.withColumn("inner", F.row_number().over(Window.partitionBy(*key).orderBy("n")) - 1)
    counts = drawn.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("c"))
    shift = counts.withColumn(
        "shift", F.sum("c").over(Window.partitionBy("source").orderBy("bucket")) - F.col("c")
    ).select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "shift")
    ranked = inner.join(shift, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    ranked = ranked.select("source", "n", (F.col("inner") + F.col("shift")).alias("rank"), "take").where(F.col("rank") * block < F.col("take"))
    had = counts.groupBy(F.col("source").alias("s_")).agg(F.sum("c").alias("had"))
    short = targets.where("take > 0").join(had, F.col("source").eqNullSafe(F.col("s_")), "left")
    short = short.select("source", "take", F.coalesce("had", F.lit(0)).alias("had"), F.floor((F.col("take") - 1) / block).alias("last"))
    short = short.where("had <= last").withColumn("missing", F.col("last") - F.col("had") + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    short = short.withColumn("behind", slots + F.sum("missing").over(by_name) - F.col("missing"))
    added = short.withColumn("rank", F.explode(F.sequence("had", "last")))
    return ranked.unionByName(added.select("source", (F.col("behind") + F.col("rank") - F.col("had")).alias("n"), "rank", "take"))


def streams(sized: DataFrame, total_docs: int) -> DataFrame:
    """Adds start: the document's first token in its source's stream."""
    bits = math.ceil(math.log2(max(1, total_docs)) / 2)
    # The top bits of the hash: the order by (bucket, place) is the order by place, whatever the number of buckets.
    bucketed = sized.withColumn("bucket", F.shiftright("place", 64 - bits) if bits else F.lit(0).cast("long"))
    here = Window.partitionBy("source", "bucket").orderBy("place", "id", "mark", "size", "twin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = bucketed.withColumn("inner", F.sum("size").over(here) - F.col("size"))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    shift = sums.withColumn("shift", F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s"))
    shift = shift.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "shift")
    joined = inner.join(shift, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    return joined.select(*_ROW, (F.col("inner") + F.col("shift")).alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, first_slot (the first slot of the schedule that plays a word of
    it, null if none does)."""
    placed = _mix(docs, id_col, text_col, source_col, weights, cap)
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], cap: float) -> DataFrame:
    """The columns of mix, and those that tell rows apart."""
    spark = docs.sparkSession
    sized = settle_table(with_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    # Repeated rows are told apart by a number among their equals.
    same = Window.partitionBy("id", "source", "size", "mark").orderBy("place")
    sized = sized.withColumn("twin", F.row_number().over(same))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = settle(source_targets(totals, weights, cap))
    found = targets.agg(F.sum("take"), F.count(F.lit(1)), F.sum("docs")).first()
    tokens, sources, total_docs = (int(x or 0) for x in found)
    block = max(1, min(BLOCK, tokens // LEAST_BLOCKS))
    placed = streams(sized, total_docs)
    need = targets.select(F.col("source").alias("s_"), "source_size", "target", "take")
    placed = placed.join(need, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    # Each lap of the stream that the mix reaches, cut at the block borders: tokens [a, b) of block r.
    laps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - 1 - F.col("start")) / F.col("source_size"))))
    pieces = (
        placed.where("size > 0 and start < take")
        .withColumn("lap", laps)
        .withColumn("a", F.col("start") + F.col("lap") * F.col("source_size"))
        .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take")))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
        .withColumn("part", F.least(F.col("b"), (F.col("rank") + 1) * block) - F.greatest(F.col("a"), F.col("rank") * block))
    )
    slots = schedule(spark, targets, tokens, sources, block).select(F.col("source").alias("s_"), F.col("rank").alias("r_"), "n")
    # A document's pieces are summed before the join with the slots only if they meet the same slot, so join pieces.
    played = pieces.join(slots, F.col("source").eqNullSafe(F.col("s_")) & (F.col("rank") == F.col("r_")))
    taken = played.groupBy(*_ROW).agg(F.sum("part").alias("taken"), F.min("n").cast("long").alias("first_slot"))
    taken = taken.select(*(F.col(c).alias(f"{c}_") for c in _ROW), "taken", "first_slot")
    same_row = F.lit(True)
    for c in _ROW:
        same_row &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return placed.join(taken, same_row, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes its text, to the nearest whole time; columns as they are.

    A source's stream is cut inside one document at most, so whole documents come as near to the target as they can. Equal
    rows (identifier, text and source) take their mean.
    """
    keys = {"id": F.col(id_col), "source": F.col(source_col).cast("string"), "mark": F.xxhash64(text_col)}
    times = F.round(F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0))).cast("int")
    taken = _mix(docs, id_col, text_col, source_col, weights, cap).groupBy(*keys).agg(times.alias("__times")).where("__times > 0")
    taken = taken.select(*(F.col(k).alias(f"__{k}_") for k in keys), "__times")
    rows = docs.select("*", *(v.alias(f"__{k}") for k, v in keys.items()))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"__{k}").eqNullSafe(F.col(f"__{k}_"))
    rows = rows.join(taken, same).withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))
