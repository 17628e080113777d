"""Filters, joins, aggregates and merges of the memory layers; each a transformation of explicit inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Defaults, IMPORT_MODES
from ..errors import INVALID_QUERY, MemoryError_
from ..functions.scalars import hash_id
from ..functions.text import words

DEFAULTS = Defaults()


# Topics and scenes


def list_topics(topics: DataFrame, depth: int = 1, scene_id: int | None = None, topic_id: int | None = None) -> DataFrame:
    """Topics down to a depth (0 counts as 1, at most 4), of one scene or one topic if named, by time."""
    found = topics.where(F.col("depth") <= min(max(depth, 1), 4))
    if scene_id is not None:
        found = found.where(F.col("scene_id") == scene_id)
    if topic_id is not None:
        found = found.where(F.col("id") == topic_id)
    return found.orderBy("user_ts", "id")


def refers_to(topics: DataFrame, l3_id: int) -> DataFrame:
    return topics.where(F.array_contains("l3_refs", l3_id))


def topic_card(topics: DataFrame) -> DataFrame:
    """The metadata row of a topic: title from fused, else user keywords; turns and archived messages counted."""
    keywords = F.when(F.size(F.coalesce("fused_keywords", F.array())) > 0, F.col("fused_keywords")).otherwise(F.col("user_keywords"))
    return topics.select(
        "id", "scene_id", "depth", "user_ts", F.array_join(keywords, ", ").alias("title"),
        F.size(F.coalesce("children_ids", F.array())).alias("turn_count"), F.size(F.coalesce("l4_refs", F.array())).alias("archive_count"),
    )


def scene_topic_counts(scenes: DataFrame, topics: DataFrame) -> DataFrame:
    """Every scene with the number of its topics of depth 1."""
    counts = topics.where("depth = 1").groupBy("scene_id").agg(F.count(F.lit(1)).alias("topic_count"))
    joined = scenes.join(counts, scenes["id"] == counts["scene_id"], "left")
    return joined.select("id", "scene_name", F.coalesce("topic_count", F.lit(0)).cast("bigint").alias("topic_count"))


def pick(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ids (pos, id) in that order; missing ones are skipped."""
    return frame.join(ids, "id").orderBy("pos")


def child_counts(topics: DataFrame) -> DataFrame:
    """Topics of depth 1 and 2 with the number of their children among them."""
    near = topics.where("depth <= 2")
    counts = near.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return near.join(counts, "id", "left").select("id", "scene_id", "depth", F.coalesce("children", F.lit(0)).alias("children"))


def topic_archives(topics: DataFrame, archive: DataFrame) -> DataFrame:
    """Each topic with the contents that its l4_refs name, in the order of the references; missing ones are skipped."""
    refs = topics.select("id", F.posexplode("l4_refs").alias("pos", "ref"))
    found = refs.join(archive.select(F.col("id").alias("ref"), "content"), "ref")
    gathered = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("refs"))
    return gathered.select("id", F.transform("refs", lambda r: r["content"]).alias("contents"))


def merge_scenes(topics: DataFrame, primary: int, secondary: list[int]) -> DataFrame:
    """Topics with those of the secondary scenes moved to the primary one."""
    if not secondary or primary in secondary:
        raise MemoryError_(INVALID_QUERY, "the secondary scenes must be others than the primary one")
    return topics.withColumn("scene_id", F.when(F.col("scene_id").isin(*secondary), primary).otherwise(F.col("scene_id")))


def associated_scene(scene_id: int, nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: the scene of most topics that the scene's nodes hold; ties by id."""
    held = nodes.where(F.col("scene_id") == scene_id).select(F.explode("topic_ids").alias("id"))
    counts = held.join(topics.select("id", "scene_id"), "id").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "scene_id").limit(1)


def active_scenes(active: list[int], scene_id: int, capacity: int = DEFAULTS.capacity) -> list[int]:
    """The active list after a scene is activated: first in, first out, a scene in it already stays where it is."""
    if scene_id in active:
        return active
    both = [*active, scene_id]
    return both[-capacity:] if capacity > 0 else both


def entries_touched(hits: DataFrame) -> DataFrame:
    """Usage by scene of a hit log (scene_id, ts, seq): the count, and the time of the latest write."""
    return hits.groupBy("scene_id").agg(F.count(F.lit(1)).alias("hit_count"), F.max_by("ts", "seq").alias("last_hit_at"))


# Archive


def archive_containing(archive: DataFrame, keyword: str) -> DataFrame:
    """Case-sensitive substring search."""
    return archive.where(F.col("content").contains(keyword))


def archive_between(archive: DataFrame, start: int, end: int) -> DataFrame:
    return archive.where(F.col("created_at").between(start, end)).orderBy("created_at", "id")


def search_archive(archive: DataFrame, keyword: str = "", start: int = 0, end: int = 0, ids: DataFrame | None = None,
                   context_id: int | None = None) -> DataFrame:
    """The first criterion that is given (keyword, time range, ids) selects; context_id narrows."""
    if keyword:
        found = archive_containing(archive, keyword)
    elif start > 0 and end > 0:
        found = archive_between(archive, start, end)
    elif ids is not None:
        found = pick(archive, ids)
    else:
        found = archive.limit(0)
    return found if context_id is None else found.where(F.col("context_id") == context_id)


# Knowledge graphs: nodes and imports


def query_nodes(nodes: DataFrame, graph_id: int | None = None, ids: list[int] | None = None, keyword: str = "", node_type: str = "",
                limit: int = 0) -> DataFrame:
    """Nodes by ids, else by keyword (case-insensitive, in title, content or a keyword), else by exact type."""
    found = nodes if graph_id is None else nodes.where(F.col("graph_id") == graph_id)
    if ids:
        found = found.where(F.col("id").isin(*ids))
    elif keyword:
        k = keyword.lower()
        inside = F.lower("title").contains(k) | F.lower("content").contains(k)
        if "keywords" in nodes.columns:
            inside = inside | F.coalesce(F.exists("keywords", lambda x: F.lower(x).contains(k)), F.lit(False))
        found = found.where(inside)
    elif node_type:
        found = found.where(F.col("node_type") == node_type)
    else:
        return found.limit(0)
    found = found.orderBy("id")
    return found.limit(limit) if limit > 0 else found


def _touches(term: str):
    return lambda keyword: F.lower(keyword).contains(term) | F.lit(term).contains(F.lower(keyword))


def match_graphs(nodes: DataFrame, terms: list[str], text: str = "") -> DataFrame:
    """Graphs with a node that a term or the text touches: distinct ids, rising."""
    title, content = F.lower("title"), F.lower("content")
    hit = F.lit(False)
    for term in (t.lower() for t in terms if t):
        hit = hit | title.contains(term) | content.contains(term)
        hit = hit | F.exists("keywords", _touches(term))
    if text:
        low = F.lit(text.lower())
        hit = hit | ((title != "") & low.contains(title)) | F.exists("keywords", lambda k: (k != "") & low.contains(F.lower(k)))
    return nodes.where(hit).select("graph_id").distinct().orderBy("graph_id")


def merge_content(old: Column, new: Column) -> Column:
    """Old and new content in one: the longer if one holds the other, else both by line."""
    return (
        F.when(F.coalesce(new, F.lit("")) == "", old)
        .when(F.coalesce(old, F.lit("")) == "", new)
        .when(old.contains(new), old)
        .when(new.contains(old), new)
        .otherwise(F.concat(old, F.lit("\n"), new))
    )


def import_nodes(nodes: DataFrame, items: DataFrame, mode: str = "", now_ms: int = 0) -> DataFrame:
    """Nodes after an import of items (seq, title, domain, node_type, content, keywords).

    Items of one title are folded in their order, as if imported one by one; the mode (skip, merge, overwrite; empty counts as overwrite)
    decides against what is there. Empty titles are skipped. A graph's id is the hash of its domain.
    """
    mode = mode.lower() or "overwrite"
    if mode not in IMPORT_MODES:
        raise MemoryError_(INVALID_QUERY, f"unknown import mode {mode!r}")
    graph = hash_id("graph:", F.col("domain"))
    given = items.where(F.trim("title") != "").withColumn("graph_id", graph)
    entry = F.struct("seq", "node_type", "content", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    grouped = given.groupBy("graph_id", "title").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    state = F.struct("node_type", "content", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    known = nodes.select("graph_id", "title", "id", state.alias("old"), "created_at")
    both = known.join(grouped, ["graph_id", "title"], "full")
    plain = lambda e: F.struct(e["node_type"], e["content"], e["keywords"])
    kind = "struct<node_type:string,content:string,keywords:array<string>>"
    first = F.coalesce(F.col("old"), plain(F.element_at("entries", 1)).cast(kind)).cast(kind)
    rest = F.when(F.col("old").isNull(), F.slice("entries", 2, F.greatest(F.size("entries") - 1, F.lit(0)))).otherwise(F.col("entries"))

    def fold(s: Column, e: Column) -> Column:
        if mode == "skip":
            return s
        if mode == "overwrite":
            return plain(e).cast(kind)
        node_type = F.when(F.coalesce(e["node_type"], F.lit("")) != "", e["node_type"]).otherwise(s["node_type"])
        merged = F.struct(node_type, merge_content(s["content"], e["content"]), F.array_union(s["keywords"], e["keywords"]))
        return merged.cast(kind)

    folded = F.when(F.col("entries").isNull(), F.col("old").cast(kind)).otherwise(F.aggregate(rest, first, fold))
    out = both.withColumn("new", folded)
    return out.select(
        F.coalesce("id", hash_id(F.col("graph_id"), ":", F.col("title"))).alias("id"), "graph_id", "title", "new.node_type", "new.content",
        "new.keywords", F.coalesce("created_at", F.lit(now_ms)).alias("created_at"), F.col("entries").isNotNull().alias("touched"),
    )


# Capabilities


def list_capabilities(stored: DataFrame, builtin: DataFrame, status: int | None = None, kind: str = "", keyword: str = "") -> DataFrame:
    """Stored capabilities and the built-in ones that are not stored, filtered, newest first."""
    whole = stored.unionByName(builtin.join(stored.select("id"), "id", "left_anti"), allowMissingColumns=True)
    if status is not None:
        whole = whole.where(F.col("status") == status)
    if kind:
        whole = whole.where(F.col("type") == kind)
    if keyword:
        text = F.lower(F.concat_ws(" ", "name", "summary", "trigger"))
        whole = whole.where(text.contains(keyword.lower()))
    return whole.orderBy(F.desc("updated_at"), "id")


def match_capabilities(stored: DataFrame, query_tokens: list[str]) -> DataFrame:
    """Active capabilities whose text contains any of the query's tokens."""
    resources = F.transform("resources", lambda r: F.concat_ws(" ", r["name"], r["description"]))
    steps = F.transform("workflow.steps", lambda s: F.concat_ws(" ", s["ref"], s["action"]))
    text = F.lower(F.concat_ws(" ", "name", "summary", "trigger", resources, steps))
    hit = F.lit(False)
    for t in query_tokens:
        hit = hit | text.contains(t)
    return stored.where((F.col("status") == 1) & hit)


def capability_usage(uses: DataFrame) -> DataFrame:
    """By capability of a log (cap_id, ts, success): count, running success rate, last use."""
    return uses.groupBy("cap_id").agg(
        F.count(F.lit(1)).alias("trigger_count"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.max("ts").alias("last_used")
    )


def upsert_capabilities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored capabilities after an upsert: usage, creation time and a status beyond draft survive."""
    keep = {"success_rate", "trigger_count", "created_at"}
    both = stored.alias("o").join(incoming.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    columns = []
    for c in stored.columns:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep or c == "id":
            columns.append(F.coalesce(old, new).alias(c))
        elif c == "status":
            value = F.when(F.col("n.id").isNull(), old).when(F.col("o.id").isNotNull() & (old != 0) & (new == 0), old).otherwise(new)
            columns.append(value.alias(c))
        else:
            columns.append(F.when(F.col("n.id").isNull(), old).otherwise(new).alias(c))
    return both.select(*columns)


def capability_errors(cards: DataFrame) -> DataFrame:
    """Cards with error: why a card may not be imported, null if it may."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    resources = F.coalesce(F.size("resources"), F.lit(0))
    one = (resources == 1) & (F.get("resources", F.lit(0))["type"] == F.col("type"))
    steps = F.coalesce(F.exists("workflow.steps", lambda s: F.trim(F.coalesce(s["ref"], F.lit(""))) == ""), F.lit(False))
    error = (
        F.when(blank("name"), "capability name is required")
        .when(blank("trigger") & blank("summary"), "capability trigger or summary is required")
        .when(blank("type"), "capability type is required")
        .when(F.col("type").isin("mcp", "skill") & ~one, "exactly one resource of the same type is required")
        .when((F.col("type") == "composite") & (resources == 0), "composite capability requires at least one resource")
        .when((F.col("type") == "composite") & steps, "workflow step ref is required")
        .when(~F.col("type").isin("mcp", "skill", "composite"), "unknown capability type")
    )
    return cards.withColumn("error", error)


def crystallize(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """candidates (seq, name, action, reuse_id, error) with target and disposition: reuse, merge, create or error.

    The name decides first, then the named id. A candidate that finds no target is created, and must be valid for that.
    """
    by_name = stored.select(F.col("id").alias("name_target"))
    by_id = stored.select(F.col("id").alias("id_target"))
    named = candidates.withColumn("own_id", hash_id("capability:", F.lower(F.trim("name"))))
    found = named.join(by_name, F.col("own_id") == F.col("name_target"), "left").join(by_id, F.col("reuse_id") == F.col("id_target"), "left")
    target = F.coalesce("name_target", "id_target")
    action = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    disposition = (
        F.when(target.isNotNull() & (action == "merge"), "merge")
        .when(target.isNotNull() & (action.isin("reuse") | F.col("error").isNull()), "reuse")
        .when(F.col("error").isNotNull(), "error")
        .otherwise("create")
    )
    return found.select("seq", "name", F.coalesce(target, "own_id").alias("target"), disposition.alias("disposition"))


def prompt_card(capabilities: DataFrame) -> DataFrame:
    """id, card: a capability as a few lines of text."""
    steps = F.array_join(F.transform("workflow.steps", lambda s: F.concat_ws(": ", s["ref"], s["action"])), "; ")
    lines = F.concat_ws(
        "\n", F.format_string("%s (%s, v%s)", "name", "type", "version"), F.concat(F.lit("summary: "), "summary"),
        F.concat(F.lit("trigger: "), "trigger"), F.when(F.size("workflow.steps") > 0, F.concat(F.lit("steps: "), steps)),
    )
    return capabilities.select("id", lines.alias("card"))


# Trajectories


def session_events(trajectory: DataFrame, session_id: int) -> DataFrame:
    return trajectory.where(F.col("session_id") == session_id).orderBy("seq")


def next_sequence(trajectory: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (session_id, event_type, payload, timestamp, pos) numbered on from each session's last event."""
    last = trajectory.groupBy("session_id").agg(F.max("seq").alias("last"))
    order = Window.partitionBy("session_id").orderBy("timestamp", "pos")
    numbered = incoming.join(last, "session_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.row_number().over(order))
    return numbered.withColumn("id", hash_id(F.col("session_id"), ":", F.col("seq"))).drop("last", "pos")


# Profile


def default_profile(terms: list[str], records: int) -> dict:
    return {
        "name": "Agent", "role": "assistant", "personality": ", ".join(terms[:5]),
        "preferences": {"top_keywords": ", ".join(terms[:20]), "total_engrams": str(records)},
        "lexicon": {}, "style_traits": [], "emotion_patterns": {},
    }


def profile_from_terms(frequencies: DataFrame, records: Column) -> DataFrame:
    """One row: personality of the 5, top keywords of the 20 most frequent terms, the number of records."""
    top = frequencies.orderBy(F.desc("df"), "term").limit(20)
    terms = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("d"), "term"))), lambda t: t["term"])
    gathered = top.agg(terms.alias("terms"))
    return gathered.select(
        F.array_join(F.slice("terms", 1, 5), ", ").alias("personality"), F.array_join("terms", ", ").alias("top_keywords"),
        records.cast("string").alias("total_engrams"),
    )


def search_text(topics: DataFrame) -> DataFrame:
    """id, tokens of topics of depth 1 and 2: what the sparse index holds of a topic's keywords."""
    parts = [F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("user_keywords", "agent_keywords", "fused_keywords")]
    return topics.where("depth <= 2").select("id", words(F.concat_ws(" ", *parts)).alias("tokens"))


# Sessions


def history_window(nodes: DataFrame, keep: int = 40, least: int = 8) -> DataFrame:
    """nodes (session_id, pos, kind) with hidden: whether a snapshot takes the node's place.

    The last keep nodes (at least so many as least says) stay; what is hidden before them ends where no tool call waits for
    its result, so that call and result are never parted.
    """
    inside = Window.partitionBy("session_id").orderBy("pos")
    waiting = F.when(F.col("kind") == "tool_call", 1).when(F.col("kind") == "tool_result", -1).otherwise(0)
    counted = nodes.withColumn("waiting", F.sum(waiting).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = counted.withColumn("behind", F.count(F.lit(1)).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    cut = F.max(F.when((F.col("waiting") == 0) & (F.col("behind") >= max(least, keep)), F.col("pos"))).over(Window.partitionBy("session_id"))
    return counted.withColumn("hidden", F.coalesce(F.col("pos") <= cut, F.lit(False))).drop("waiting", "behind")


#: First and last line of a snapshot.
SNAPSHOT, CUT = "Memory snapshot: what was found for this session; the current messages take precedence.", "\u2026(snapshot cut)"


def snapshot_text(parts: DataFrame, most: int = 4000) -> DataFrame:
    """parts (key, profile: array of texts, topics: array of keyword arrays, archives: array of (role, content)) as key, snapshot."""
    profile = F.array_join(F.filter("profile", lambda t: t != ""), " \u00b7 ")
    shown = F.filter(F.transform("topics", lambda k: F.array_join(F.slice(k, 1, 8), "/")), lambda t: t != "")
    said = F.transform(
        "archives",
        lambda a: F.struct(a["role"].alias("role"), F.trim(F.regexp_replace(F.coalesce(a["content"], F.lit("")), r"\s+", " ")).alias("text")),
    )
    lines = F.transform(F.filter(said, lambda a: a["text"] != ""), lambda a: F.concat(F.when(a["role"] == 1, "agent: ").otherwise("user: "), a["text"]))
    head = F.array(
        F.lit(SNAPSHOT), F.when(profile != "", F.concat(F.lit("profile: "), profile)),
        F.when(F.size(shown) > 0, F.concat(F.lit("topics ("), F.size("topics").cast("string"), F.lit("): "), F.array_join(shown, " | "))),
    )
    text = F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), lines), "\n")
    cut = F.concat(F.substring(text, 1, most), F.lit(f"\n{CUT}"))
    return parts.select("key", F.when(F.char_length(text) > most, cut).otherwise(text).alias("snapshot"))


def active_list(scenes: DataFrame, active: list[int]) -> DataFrame:
    """The active scenes with their names; at most the capacity's many."""
    return scenes.where(F.col("id").isin(*active)) if active else scenes.limit(0)


def scene_nodes(nodes: DataFrame, scene_id: int | None = None) -> DataFrame:
    return nodes if scene_id is None else nodes.where(F.col("scene_id") == scene_id)


def doomed(topics: DataFrame, scene_ids: list[int], topic_ids: list[int]) -> DataFrame:
    """id: the topics that go with some scenes, and topics by their own ids."""
    none = F.lit(False)
    of_scene = F.col("scene_id").isin(*scene_ids) if scene_ids else none
    return topics.where(of_scene | (F.col("id").isin(*topic_ids) if topic_ids else none)).select("id")


def search_nodes(nodes: DataFrame, text: str = "", keyword: str = "", node_type: str = "", graph_id: int | None = None, limit: int = 0) -> DataFrame:
    """Nodes of a graph index: by exact keyword, by type, by graph, or by BM25 over title and content (id, score)."""
    from .retrieval import bm25

    if keyword:
        nodes = nodes.where(F.array_contains("keywords", keyword))
    if node_type:
        nodes = nodes.where(F.col("node_type") == node_type)
    if text:
        # The statistics are those of the whole index, the scores those of the graph.
        asked = nodes.sparkSession.range(1).select(words(F.lit(text))).first()[0]
        docs = nodes.select("id", words(F.concat_ws(" ", "title", "content")).alias("tokens"), "graph_id")
        found = bm25(docs, asked, candidates=F.lit(True) if graph_id is None else F.col("graph_id") == graph_id)
        found = found.orderBy(F.desc("score"), "id")
    else:
        found = (nodes if graph_id is None else nodes.where(F.col("graph_id") == graph_id)).orderBy("id")
    return found.limit(limit) if limit > 0 else found


def joined_keywords(old: Column, new: Column) -> Column:
    """Old and new keywords in order, without repeats."""
    return F.array_union(old, new)


def without_references(old: Column, gone: Column) -> Column:
    return F.array_except(old, gone)


def existing(ids: DataFrame, live: DataFrame) -> DataFrame:
    """Those of ids that are live records."""
    return ids.join(live.select("id"), "id", "left_semi")


def capability_by_id(stored: DataFrame, builtin: DataFrame) -> DataFrame:
    """One card for each id: a stored one goes before a built-in one of the same id."""
    both = stored.withColumn("place", F.lit(0)).unionByName(builtin.withColumn("place", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("id", "place")]
    first = both.groupBy("id").agg(F.min_by(F.struct(*rest), "place").alias("c"))
    return first.select("id", *(F.col(f"c.{c}").alias(c) for c in rest))
