"""Consolidation stages: compression, usage feedback, node sync and rebuild, decay, distillation.

Each stage is a function of explicit frames and now_ms. Replies of language models come in as frames, so that every stage is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Defaults
from ..functions.scalars import clamp, hash_id, hours_between, three_decimals, to_hex
from .graph import without_nodes

DEFAULTS = Defaults()


def scenes_to_compress(topics: DataFrame, least: int = DEFAULTS.compress_min_topics) -> DataFrame:
    """Scenes with enough topics of depth 1."""
    return topics.where("depth = 1").groupBy("scene_id").agg(F.count(F.lit(1)).alias("topics")).where(F.col("topics") >= least)


def group_spans(groups: DataFrame, topics: DataFrame) -> DataFrame:
    """groups (group_id, scene_id, node_ids) of at least two known topics: first user and last agent time, references."""
    member = groups.select("group_id", F.col("scene_id").alias("s_"), F.explode(F.array_distinct("node_ids")).alias("id")).join(topics, "id")
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("l3_refs", F.array().cast("array<bigint>"))))))
    spans = member.groupBy("group_id", F.col("s_").alias("scene_id")).agg(
        F.min("user_ts").alias("user_ts"), F.max("agent_ts").alias("agent_ts"), refs.alias("l3_refs"), F.sort_array(F.collect_list("id")).alias("children_ids")
    )
    return spans.where(F.size("children_ids") >= 2)


def fused_topics(spans: DataFrame) -> DataFrame:
    """The topic of each group. Its id has a mark of its own, so that it never meets that of its earliest child."""
    return spans.select(
        hash_id("fused:", F.col("scene_id"), ":", F.col("user_ts"), ":", F.col("agent_ts")).alias("id"), "group_id", "scene_id",
        F.lit(1).alias("depth"), "user_ts", "agent_ts", "l3_refs", "children_ids",
    )


def with_summaries(fused: DataFrame, summaries: DataFrame) -> DataFrame:
    """fused with what a model and an encoder made of each group's summary (group_id, summary, keywords, vector): its keywords
    and its centroid's id. Groups whose summary gave no keywords are skipped."""
    known = summaries.where(F.size("keywords") > 0)
    joined = fused.join(known, "group_id")
    centroid = hash_id("centroid:", F.array_join(F.transform("vector", lambda x: x.cast("string")), ","))
    return joined.withColumnRenamed("keywords", "fused_keywords").withColumn("centroid_ref", centroid)


def sink_children(topics: DataFrame, fused: DataFrame) -> DataFrame:
    """Topics with the children of fused ones a level deeper below their parent; those that reach depth 4 are gone."""
    child = fused.select(F.col("id").alias("new_parent"), F.explode("children_ids").alias("id"))
    joined = topics.join(child, "id", "left")
    moved = joined.withColumn("depth", F.col("depth") + F.col("new_parent").isNotNull().cast("int"))
    moved = moved.withColumn("parent_id", F.coalesce("new_parent", "parent_id")).drop("new_parent")
    return moved.where("depth < 4")


def usage_feedback(nodes: DataFrame, usage: DataFrame, now_ms: Column, ttl_ms: int = DEFAULTS.ttl_ms, step: float = DEFAULTS.usage_step) -> DataFrame:
    """Node importance up for scenes hit within the ttl, down for others (never hit counts as cold); untouched without any usage."""
    any_usage = usage.agg((F.count(F.lit(1)) > 0).alias("any_usage"))
    joined = nodes.join(usage.select("scene_id", "last_hit_at"), "scene_id", "left").crossJoin(F.broadcast(any_usage))
    hot = F.coalesce(now_ms - F.col("last_hit_at") < ttl_ms, F.lit(False))
    moved = F.when(hot, F.least(F.col("importance") + step, F.lit(1.0))).otherwise(F.greatest(F.col("importance") - step, F.lit(0.0)))
    return joined.withColumn("importance", F.when(F.col("any_usage"), moved).otherwise(F.col("importance"))).drop("last_hit_at", "any_usage")


def scene_members(topics: DataFrame) -> DataFrame:
    """scene_id, topic_ids: the topics of depth 1 and 2 of each scene, rising."""
    return topics.where("depth <= 2").groupBy("scene_id").agg(F.array_sort(F.collect_set("id")).alias("topic_ids"))


def sync_nodes(nodes: DataFrame, topics: DataFrame, now_ms: Column) -> DataFrame:
    """One node per scene: new ones of importance 1, others with their topics and time renewed only if these changed."""
    member = scene_members(topics)
    both = nodes.withColumnRenamed("topic_ids", "old_ids").join(member, "scene_id", "full")
    new = F.col("id").isNull()
    changed = F.col("topic_ids").isNotNull() & ~F.coalesce(F.col("topic_ids") == F.col("old_ids"), F.lit(False))
    return both.select(
        F.coalesce("id", hash_id("l1:", F.col("scene_id"))).alias("id"), "scene_id", F.coalesce("topic_ids", "old_ids").alias("topic_ids"),
        F.coalesce("importance", F.lit(1.0)).alias("importance"), F.coalesce("valence", F.lit(0.0)).alias("valence"),
        F.coalesce("arousal", F.lit(0.0)).alias("arousal"), F.when(changed, now_ms).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(new, "created").when(changed, "updated").otherwise("kept").alias("change"),
    )


def stale_nodes(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Nodes without topics, or whose first topic is missing or too deep (depth 3 below a parent of at most 2 is not)."""
    first = nodes.select("id", F.get("topic_ids", F.lit(0)).alias("topic"))
    known = topics.select(F.col("id").alias("topic"), "depth", "parent_id")
    parent = topics.select(F.col("id").alias("parent_id"), F.col("depth").alias("parent_depth"))
    joined = first.join(known, "topic", "left").join(parent, "parent_id", "left")
    kept = (F.col("depth") <= 2) | ((F.col("depth") == 3) & (F.col("parent_depth") <= 2))
    return joined.where(F.col("depth").isNull() | ~F.coalesce(kept, F.lit(False))).select("id")


def decay_rate(base: float, valence: Column, arousal: Column) -> Column:
    """Emotion slows forgetting."""
    return F.greatest(F.lit(0.0), F.lit(base) - F.abs(valence) * arousal * 2)


def decay_nodes(nodes: DataFrame, now_ms: Column, config: Defaults = DEFAULTS) -> DataFrame:
    """Nodes with new importance and fate: removed, pruned (loses its edges) or kept. deep nodes (depth over 2, if the column is there) stay."""
    rate = decay_rate(config.lambda_node, F.col("valence"), F.col("arousal"))
    faded = F.col("importance") * F.exp(-rate * hours_between(now_ms, F.col("updated_at")))
    deep = F.coalesce(F.col("depth") > 2, F.lit(False)) if "depth" in nodes.columns else F.lit(False)
    out = nodes.withColumn("new_importance", F.when(deep, F.col("importance")).otherwise(faded))
    fate = (
        F.when(deep, "kept")
        .when(F.col("new_importance") < config.node_remove_threshold, "removed")
        .when(F.col("new_importance") < config.node_prune_edges_threshold, "pruned")
        .otherwise("kept")
    )
    return out.withColumn("fate", fate)


def decay_edges(edges: DataFrame, removed: DataFrame, now_ms: Column, config: Defaults = DEFAULTS) -> DataFrame:
    """Edges that survive: without removed nodes (node_id), of faded weight, still large and heavy enough."""
    kept, _ = without_nodes(edges, removed, config.min_edge_nodes)
    since = F.coalesce("last_decay_at", "created_at")
    faded = F.col("weight") * F.exp(-config.lambda_edge * hours_between(now_ms, since))
    return kept.withColumn("weight", faded).where(F.col("weight") >= config.edge_remove_threshold).withColumn("last_decay_at", now_ms)


def distill_samples(nodes: DataFrame, now_ms: Column, config: Defaults = DEFAULTS) -> DataFrame:
    """The nodes of the greatest importance by age."""
    rank = F.col("importance") * F.exp(-config.distill_lambda * hours_between(now_ms, F.col("updated_at")))
    return nodes.withColumn("rank", rank).orderBy(F.desc("rank"), "id").limit(config.distill_samples)


def sample_keywords(nodes: DataFrame, topics: DataFrame, most: int = DEFAULTS.distill_keywords) -> DataFrame:
    """id, keywords: the first fused keywords over a node's topics, in order."""
    each = nodes.select("id", F.posexplode("topic_ids").alias("pos", "topic")).join(topics.select(F.col("id").alias("topic"), "fused_keywords"), "topic")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.slice(F.coalesce("fused_keywords", F.array().cast("array<string>")), 1, most).alias("k"))))
    gathered = each.groupBy("id").agg(F.flatten(F.transform(ordered, lambda x: x["k"])).alias("keywords"))
    return gathered.withColumn("keywords", F.slice("keywords", 1, most))


def distill_prompt(samples: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row: the samples as lines for the model, in their order, each with its identifier, importance and keywords."""
    joined = samples.join(keywords, "id", "left")
    line = F.concat(
        F.lit("id_hex="), to_hex(F.col("id")), F.lit(" importance="), F.format_string("%.3f", F.col("importance").cast("double")), F.lit(" keywords="),
        F.coalesce(F.array_join("keywords", " "), F.lit("")),
    )
    lines = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "id", line.alias("line"))))
    return joined.agg(F.count(F.lit(1)).alias("samples"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def distilled_profile(reply: DataFrame) -> DataFrame:
    """reply (valence, arousal, dominance, ie, ns, tf, jp) as the texts that enter the profile."""
    letters = [F.when(clamp(F.col(c), -1, 1) < 0, low).otherwise(high) for c, low, high in (("ie", "I", "E"), ("ns", "N", "S"), ("tf", "T", "F"), ("jp", "J", "P"))]
    return reply.select(
        three_decimals(clamp(F.col("valence"), -1, 1)).alias("valence"), three_decimals(clamp(F.col("arousal"), 0, 1)).alias("arousal"),
        three_decimals(clamp(F.col("dominance"), 0, 1)).alias("dominance"), F.concat(*letters).alias("mbti_type"),
        *(three_decimals(clamp(F.col(c), -1, 1)).alias(f"mbti_{c[0]}_{c[1]}") for c in ("ie", "ns", "tf", "jp")),
    )


def backfill_emotions(nodes: DataFrame, emotions: DataFrame, now_ms: Column) -> DataFrame:
    """Emotions (id, new_valence, new_arousal) enter nodes that have none, whose time is renewed."""
    joined = nodes.join(emotions, "id", "left")
    fill = (F.col("valence") == 0) & (F.col("arousal") == 0) & F.col("new_valence").isNotNull()
    for c in ("valence", "arousal"):
        joined = joined.withColumn(f"{c}_", F.when(fill, F.col(f"new_{c}")).otherwise(F.col(c)))
    joined = joined.withColumn("updated_at", F.when(fill, now_ms).otherwise(F.col("updated_at")))
    return joined.drop("valence", "arousal", "new_valence", "new_arousal").withColumnsRenamed({"valence_": "valence", "arousal_": "arousal"})
