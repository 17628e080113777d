"""Queries of the memory layers over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CAPABILITY_STATUS, GRAPH_EDGE_KINDS, Defaults
from ..functions import scalars as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import layers as L
from ..operators import lifecycle as C
from ..sources import readers
from ..sources import store as ST
from .fixtures import ctes, table, view

NOW_MS = 1_706_745_600_000  # 2024-02-01 00:00:00
_MS = "cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {}) div 1000 as bigint)"
D = Defaults()


def _now():
    return F.lit(NOW_MS)


def _ms(column):
    return F.expr(_MS.format(column))


def _topics(spark, sf):
    t = view(spark, sf, "v_topic")
    return t.withColumns({
        "user_keywords": T.words(F.col("user_text")), "agent_keywords": T.words(F.col("agent_text")),
        "fused_keywords": F.array().cast("array<string>"),
        "l4_refs": F.when(F.col("agent_ts") > 0, F.array("id", F.col("id") + 1)).otherwise(F.array("id")),
        "l3_refs": F.array(F.col("id") % 7, F.col("id") % 5), "children_ids": F.array().cast("array<bigint>"),
    })


def _nodes(spark, sf):
    return view(spark, sf, "v_l1").withColumn("updated_at", _ms("updated_at"))


def _archive(spark, sf):
    return view(spark, sf, "v_archive")


def _parts(spark, sf):
    return view(spark, sf, "v_node").withColumn("keywords", F.split("title", " "))


def _edges(spark, sf):
    m = view(spark, sf, "v_edge_member")
    return m.groupBy(F.col("edge_id").alias("id"), "kind").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


# Store


def current_state(spark, sf):
    return ST.current(view(spark, sf, "v_log"), order=("seq",)).select("id", "seq", "payload")


def deleted_payloads(spark, sf):
    return ST.deleted_payloads(view(spark, sf, "v_log"), order=("seq",)).select("id", "seq", "payload")


def delete_batch(spark, sf):
    live = ST.current(view(spark, sf, "v_log"), order=("seq",))
    return ST.tombstones(live, table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id")))


def point_read(spark, sf):
    return ST.current(view(spark, sf, "v_log").where("id = 7"), order=("seq",)).select("id", "seq", "payload")


def existing(spark, sf):
    """Which keys exist: a semi join."""
    return L.existing(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), ST.current(view(spark, sf, "v_log"), order=("seq",)))


def record_count(spark, sf):
    return ST.current(view(spark, sf, "v_log"), order=("seq",)).agg(F.count(F.lit(1)).alias("n"))


# Topics, scenes, usage


def topics_by_depth(spark, sf):
    return L.list_topics(_topics(spark, sf), 2).select("id", "scene_id", "depth", "user_ts")


def topics_of_scene(spark, sf):
    return L.list_topics(_topics(spark, sf), 4, scene_id=12).select("id", "depth", "user_ts")


def topics_by_reference(spark, sf):
    return L.refers_to(_topics(spark, sf), 3).select("id", "scene_id")


def topic_cards(spark, sf):
    return L.topic_card(_topics(spark, sf))


def scene_topic_counts(spark, sf):
    scenes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("scene_name"))
    return L.scene_topic_counts(scenes, _topics(spark, sf))


def scenes_by_ids(spark, sf):
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") * 11 % 40).cast("long").alias("id"))
    scenes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("scene_name"))
    return L.pick(scenes, wanted)


def child_counts(spark, sf):
    return L.child_counts(_topics(spark, sf))


def topic_archives(spark, sf):
    found = L.topic_archives(_topics(spark, sf), _archive(spark, sf))
    return found.select("id", F.size("contents").alias("n"), F.md5(F.array_join("contents", "|")).alias("contents_md5"))


def merge_scenes(spark, sf):
    merged = L.merge_scenes(_topics(spark, sf), 1, [2, 3, 5])
    return merged.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


def associated_scene(spark, sf):
    topics = _topics(spark, sf)
    nodes = C.scene_members(topics.withColumn("scene_id", F.floor(F.col("scene_id") / 4))).withColumn("scene_id", F.col("scene_id") * 4)
    return L.associated_scene(8, nodes, topics).select("scene_id", "n")


def scene_usage(spark, sf):
    hits = table(spark, sf, "events").select(F.col("user_id").alias("scene_id"), _ms("ts").alias("ts"), F.col("event_id").alias("seq"))
    return L.entries_touched(hits)


def usage_join(spark, sf):
    """Nodes with their usage, cold ones without."""
    usage = view(spark, sf, "v_usage").where("scene_id % 3 <> 0")
    return _nodes(spark, sf).join(usage, "scene_id", "left").select("scene_id", F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


# Archive


def archive_keyword(spark, sf):
    return L.archive_containing(_archive(spark, sf), "the").select("id", "role", "created_at")


def archive_range(spark, sf):
    return L.archive_between(_archive(spark, sf), 1_000_000, 3_000_000).select("id", "created_at")


def archive_ids(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 1000).alias("id"))
    return L.pick(_archive(spark, sf), ids).select("pos", "id", "role")


def archive_search(spark, sf):
    return L.search_archive(_archive(spark, sf), keyword="e", context_id=5000).select("id", "role", "context_id")


# Knowledge


def nodes_by_keyword(spark, sf):
    return L.query_nodes(_parts(spark, sf), keyword="PROMO").select("id", "graph_id")


def nodes_by_type(spark, sf):
    return L.query_nodes(_parts(spark, sf).withColumn("graph_id", F.col("graph_id")), node_type="STANDARD", limit=25).select("id", "node_type")


def nodes_by_ids(spark, sf):
    return L.query_nodes(_parts(spark, sf), ids=[3, 5, 10_000_000]).select("id", "graph_id", "title")


def match_graphs(spark, sf):
    return L.match_graphs(_parts(spark, sf), ["Part#1", "brand#12"], "about part#77 and more")


def graph_summary(spark, sf):
    """Each graph with its nodes and the edges that lie fully inside it."""
    member = view(spark, sf, "v_edge_member").join(_parts(spark, sf).select(F.col("id").alias("node_id"), "graph_id"), "node_id")
    spread = member.groupBy("edge_id").agg(F.min("graph_id").alias("graph_id"), F.max("graph_id").alias("other"))
    inside = spread.where("graph_id = other").groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    nodes = _parts(spark, sf).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(inside, "graph_id", "left").select("graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def adjacency_degree(spark, sf):
    return G.adjacency(view(spark, sf, "v_edge_member")).groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node_id")


def _start(spark):
    return spark.range(1).select(F.lit(1).cast("long").alias("node_id"))


def bfs(spark, sf):
    return G.breadth_first(view(spark, sf, "v_edge_member"), _start(spark), 2)


def bfs_kinds(spark, sf):
    return G.breadth_first(view(spark, sf, "v_edge_member"), _start(spark), 2, [1, 2]).select("node_id", "depth")


def induced_edges(spark, sf):
    visited = G.breadth_first(view(spark, sf, "v_edge_member"), _start(spark), 1)
    found = G.induced_edges(_edges(spark, sf), visited)
    return found.select("id", "kind", F.size("node_ids").alias("n"), F.expr("aggregate(node_ids, 0L, (a, x) -> a + x)").alias("node_sum"))


def edges_without_nodes(spark, sf):
    removed = _parts(spark, sf).where("node_type = 'PROMO'").select(F.col("id").alias("node_id"))
    kept, _ = G.without_nodes(_edges(spark, sf), removed)
    return kept.select("id", F.size("node_ids").alias("n"), F.expr("aggregate(node_ids, 0L, (a, x) -> a + x)").alias("node_sum"))


def _import(mode):
    def run(spark, sf):
        parts = table(spark, sf, "part")
        nodes = parts.where("p_partkey % 2 = 0").select(
            F.col("p_partkey").alias("id"), S.hash_id("graph:", F.col("p_brand")).alias("graph_id"), F.concat(F.lit("t"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 10).cast("string")).alias("title"),
            F.col("p_type").alias("node_type"), F.col("p_type").alias("content"), F.array("p_type").alias("keywords"), F.lit(1).cast("long").alias("created_at"),
        )
        nodes = nodes.groupBy("graph_id", "title").agg(F.min_by(F.struct("id", "node_type", "content", "keywords", "created_at"), "id").alias("x")).select("graph_id", "title", "x.*")
        items = parts.where("p_partkey % 2 = 1").select(
            F.col("p_partkey").alias("seq"), F.concat(F.lit("t"), F.col("p_size").cast("string"), F.lit("_"), ((F.col("p_partkey") + 1) % 10).cast("string")).alias("title"),
            F.col("p_brand").alias("domain"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("node_type"),
            F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 4 == 1, " more").otherwise("")).alias("content"), F.array("p_type", "p_brand").alias("keywords"),
        )
        brands = parts.select("p_brand").distinct().select("p_brand", S.hash_id("graph:", F.col("p_brand")).alias("graph_id"))
        after = L.import_nodes(nodes, items, mode, NOW_MS).join(brands, "graph_id")
        return after.select("p_brand", "title", "node_type", "content", F.array_join("keywords", ",").alias("keywords"), "created_at", "touched")

    return run


_ITEMS = """nodes as (select p_brand, 't' || p_size || '_' || (p_partkey % 10) as title, p_type as node_type, p_type as content, [p_type] as keywords,
  row_number() over (partition by p_brand, 't' || p_size || '_' || (p_partkey % 10) order by p_partkey) as k from part where p_partkey % 2 = 0),
old as (select * from nodes where k = 1),
items as (select p_brand, 't' || p_size || '_' || ((p_partkey + 1) % 10) as title, p_partkey as seq, case when p_partkey % 3 > 0 then p_type end as node_type,
  p_type || case when p_partkey % 4 = 1 then ' more' else '' end as content, [p_type, p_brand] as keywords from part where p_partkey % 2 = 1),
g as (select p_brand, title, list(struct_pack(node_type := node_type, content := content, keywords := keywords) order by seq) as e from items group by all),
b as (select coalesce(o.p_brand, g.p_brand) as p_brand, coalesce(o.title, g.title) as title, o.node_type, o.content, o.keywords, o.p_brand is not null as known, e
  from old o full join g on o.p_brand = g.p_brand and o.title = g.title)"""
_OUT = "array_to_string({k}, ',') as keywords, case when known then 1 else 1706745600000 end as created_at, e is not null as touched from b"
_MERGE = f"""with recursive {_ITEMS},
f(p_brand, title, node_type, content, keywords, known, e, i) as (
  select p_brand, title, case when known then node_type else e[1].node_type end, case when known then content else e[1].content end,
         case when known then keywords else e[1].keywords end, known, e, case when known then 1 else 2 end from b
  union all
  select p_brand, title, case when coalesce(e[i].node_type, '') <> '' then e[i].node_type else node_type end,
         case when contains(content, e[i].content) then content when contains(e[i].content, content) then e[i].content else content || chr(10) || e[i].content end,
         keywords || list_filter(e[i].keywords, lambda k: not list_contains(keywords, k)), known, e, i + 1
  from f where e is not null and i <= len(e))
select p_brand, title, node_type, content, array_to_string(keywords, ',') as keywords, case when known then 1 else 1706745600000 end as created_at,
       e is not null as touched from f where e is null or i = len(e) + 1"""


# Capabilities and trajectories


def _capabilities(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("1").alias("version"),
        F.when(F.col("s_suppkey") % 3 == 0, "mcp").when(F.col("s_suppkey") % 3 == 1, "skill").otherwise("composite").alias("type"),
        F.concat(F.lit("supplies nation "), F.col("s_nationkey").cast("string")).alias("summary"), F.concat(F.lit("when in "), F.col("s_nationkey").cast("string")).alias("trigger"),
        F.expr("array(named_struct('type', case s_suppkey % 3 when 0 then 'mcp' when 1 then 'skill' else 'mcp' end, 'name', s_name, 'ref', 'r', 'description', 'about ' || s_nationkey, 'config', cast(map() as map<string,string>)))").alias("resources"),
        F.expr("named_struct('steps', array(named_struct('ref', case when s_suppkey % 10 = 8 then '' else 'r' end, 'action', 'act')))").alias("workflow"),
        (F.col("s_suppkey") % 3).cast("tinyint").alias("status"), F.lit("host").alias("origin"), F.round(F.col("s_acctbal"), 2).alias("success_rate"),
        F.col("s_suppkey").alias("trigger_count"), F.lit(1).cast("long").alias("created_at"), (F.col("s_suppkey") * 7 % 13).cast("long").alias("updated_at"),
    )


def _builtin(spark, sf):
    return table(spark, sf, "nation").select((F.col("n_nationkey") * 9).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("mcp").alias("type"),
                                             F.lit("nation 1").alias("summary"), F.lit("").alias("trigger"), F.lit(1).cast("tinyint").alias("status"), F.lit(0).cast("long").alias("updated_at"))


def capability_list(spark, sf):
    return L.list_capabilities(_capabilities(spark, sf), _builtin(spark, sf), status=1, keyword="NATION 1").select("id", "name", "updated_at")


def capability_get(spark, sf):
    """Stored before built-in for every id."""
    return L.capability_by_id(_capabilities(spark, sf).select("id", "name"), _builtin(spark, sf).select("id", "name"))


def capability_match(spark, sf):
    return L.match_capabilities(_capabilities(spark, sf), ["about 3", "nation 17"]).select("id", "name")


def capability_usage(spark, sf):
    return L.capability_usage(view(spark, sf, "v_cap_use")).select("cap_id", "trigger_count", F.round("success_rate", 6).alias("success_rate"), _ms("last_used").alias("last_used"))


def capability_upsert(spark, sf):
    stored = _capabilities(spark, sf).where("id % 2 = 0")
    incoming = _capabilities(spark, sf).where("id % 3 <> 1").withColumns({
        "summary": F.lit("new"), "status": F.lit(0).cast("tinyint"), "trigger_count": F.lit(0).cast("long"), "created_at": F.lit(99).cast("long"), "updated_at": F.lit(99).cast("long")})
    return L.upsert_capabilities(stored, incoming).select("id", "summary", "status", "trigger_count", "created_at", "updated_at")


def capability_validation(spark, sf):
    return L.capability_errors(_capabilities(spark, sf)).select("id", F.coalesce("error", F.lit("")).alias("error"))


def crystallization(spark, sf):
    stored = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(S.hash_id("capability:", F.lower(F.trim("s_name"))).alias("id"))
    candidates = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit(" "), F.upper("s_name")).alias("name"),
        F.when(F.col("s_suppkey") % 3 == 0, "merge").when(F.col("s_suppkey") % 3 == 1, " Reuse").alias("action"), F.lit(None).cast("long").alias("reuse_id"),
        F.when(F.col("s_suppkey") % 5 == 0, "bad").alias("error"),
    )
    return L.crystallize(candidates, stored).select("seq", "disposition")


def prompt_cards(spark, sf):
    return L.prompt_card(_capabilities(spark, sf)).select("id", F.md5("card").alias("card_md5"))


def session_events(spark, sf):
    traj = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "event_type")
    return L.session_events(traj, 5)


def sequence_numbers(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_type", F.col("props").alias("payload"), _ms("ts").alias("timestamp"), F.col("event_id").alias("pos"))
    old = e.where("pos % 2 = 0").groupBy("session_id").agg(F.count(F.lit(1)).alias("seq"))
    new = e.where("pos % 2 = 1")
    return L.next_sequence(old, new.withColumn("event", F.col("pos"))).select("session_id", "event", "seq")


def turn_pairs(spark, sf):
    found = readers.next_topics(table(spark, sf, "conversations"))
    return found.select("conv_id", "turn", F.md5("user_text").alias("user_md5"), F.md5("agent_text").alias("agent_md5"))


def recent_turns(spark, sf):
    """The last four turns of each conversation: history control."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").withColumn("k", F.row_number().over(order)).where("k <= 4").select("conv_id", "turn", "k")


# Lifecycle


def compress_candidates(spark, sf):
    return C.scenes_to_compress(_topics(spark, sf), 2)


def _groups(spark, sf):
    t = _topics(spark, sf).where("depth = 1")
    return t.groupBy((F.col("scene_id") * 10 + F.floor(F.col("id") / 4) % 2).alias("group_id"), "scene_id").agg(F.collect_list("id").alias("node_ids"))


def compress_groups(spark, sf):
    topics = _topics(spark, sf)
    spans = C.group_spans(_groups(spark, sf), topics.drop("scene_id"))
    return spans.select("group_id", "scene_id", "user_ts", "agent_ts", F.array_join(F.col("l3_refs").cast("array<string>"), ",").alias("l3_refs"), F.size("children_ids").alias("n"))


def compress_sink(spark, sf):
    topics = _topics(spark, sf)
    fused = C.fused_topics(C.group_spans(_groups(spark, sf), topics.drop("scene_id")))
    # Ids of fused topics are hashes: what is compared is whether a topic has a parent.
    sunk = C.sink_children(topics.withColumn("parent_id", F.lit(None).cast("long")), fused)
    return sunk.select("id", "depth", F.col("parent_id").isNotNull().alias("has_parent"))


def usage_feedback(spark, sf):
    usage = view(spark, sf, "v_usage").select("scene_id", _ms("last_hit").alias("last_hit_at")).where("scene_id % 4 <> 0")
    fed = C.usage_feedback(_nodes(spark, sf), usage, _now(), 6 * 3_600_000)
    return fed.select("id", F.round("importance", 6).alias("importance"))


def node_sync(spark, sf):
    topics = _topics(spark, sf)
    old = C.scene_members(topics.where("scene_id % 3 > 0 and (scene_id % 5 > 0 or depth = 1)")).select(
        F.col("scene_id").alias("id"), "scene_id", "topic_ids", F.lit(0.5).alias("importance"), F.lit(0.0).alias("valence"), F.lit(0.0).alias("arousal"), F.lit(1).cast("long").alias("updated_at"))
    return C.sync_nodes(old, topics, _now()).select("scene_id", F.size("topic_ids").alias("n"), "importance", "updated_at", "change")


def stale_nodes(spark, sf):
    topics = _topics(spark, sf)
    nodes = topics.select((F.col("id") * 10).alias("id"), F.array(F.col("id") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("topic_ids"))
    return C.stale_nodes(nodes, topics)


def node_decay(spark, sf):
    return C.decay_nodes(_nodes(spark, sf), _now()).select("id", F.round("new_importance", 6).alias("importance"), "fate")


def edge_decay(spark, sf):
    edges = _edges(spark, sf).withColumns({"weight": F.lit(0.9), "created_at": F.lit(NOW_MS) - F.col("id") % 200 * 3_600_000, "last_decay_at": F.lit(None).cast("long")})
    removed = _parts(spark, sf).where("node_type = 'PROMO'").select(F.col("id").alias("node_id"))
    return C.decay_edges(edges, removed, _now()).select("id", F.size("node_ids").alias("n"), F.round("weight", 6).alias("weight"))


def distill_samples(spark, sf):
    return C.distill_samples(_nodes(spark, sf), _now(), Defaults(distill_samples=50)).select("id", F.round("rank", 6).alias("rank"))


def sample_keywords(spark, sf):
    topics = _topics(spark, sf).withColumn("fused_keywords", F.col("user_keywords"))
    nodes = C.scene_members(topics).withColumnRenamed("scene_id", "id")
    return C.sample_keywords(nodes, topics).select("id", F.array_join("keywords", " ").alias("keywords"))


def distilled_profile(spark, sf):
    reply = _nodes(spark, sf).select(
        "id", (F.col("valence") * 2 - 0.3).alias("valence"), (F.col("arousal") * 30).alias("arousal"), F.col("importance").alias("dominance"),
        *((F.col("valence") * 5 - F.lit(c)).alias(n) for n, c in (("ie", 0.9), ("ns", 1.0), ("tf", 1.1), ("jp", 0.8))))
    joined = C.distilled_profile(reply)
    return joined.groupBy("mbti_type").agg(F.count(F.lit(1)).alias("n"), F.min("valence").alias("least_valence"), F.max("arousal").alias("most_arousal"))


def emotion_backfill(spark, sf):
    nodes = _nodes(spark, sf).withColumns({"valence": F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("valence")), "arousal": F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("arousal"))})
    emotions = nodes.where("id % 3 = 0").select("id", F.lit(0.25).alias("new_valence"), F.lit(0.5).alias("new_arousal"))
    return C.backfill_emotions(nodes, emotions, _now()).select("id", F.round("valence", 6).alias("valence"), F.round("arousal", 6).alias("arousal"), "updated_at")


def profile_terms(spark, sf):
    from ..operators import retrieval as R

    docs = L.search_text(_topics(spark, sf))
    return L.profile_from_terms(R.document_frequencies(R.postings(docs)), F.lit(7))


# Scalars


def camel_case(spark, sf):
    """Identifiers built from names, split at their camel-case borders."""
    word = F.concat(F.lit("fetch"), F.initcap("p_type"), F.lit("ID"), F.initcap(F.lower("p_type")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.split_camel_lower(word), " ").alias("parts"))


def trimmed(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.trim_punctuation(F.concat(F.lit("(#"), F.col("p_brand"), F.lit("!)_."))).alias("trimmed"))


def first_characters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.first_points(F.coalesce("text", F.lit("")), 100)).alias("head_md5"))


def enum_names(spark, sf):
    m = view(spark, sf, "v_edge_member").select("kind").distinct()
    return m.select("kind", S.enum_name(F.col("kind"), {k: v for k, v in GRAPH_EDGE_KINDS.items() if k < 4}, "Kind").alias("name"))


def scene_names(spark, sf):
    return _archive(spark, sf).where("role = 0").select("id", F.concat(F.col("created_at").cast("string"), F.lit(":"), T.first_points(F.col("content"), 10)).alias("name"))


def hex_ids(spark, sf):
    ids = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 1_000_003).alias("id"))
    return ids.select("o_orderkey", S.to_hex(F.col("id")).alias("hex"), S.from_hex(S.to_hex(F.col("id"))).alias("back"))


def keyword_cleaning(spark, sf):
    given = F.split(F.regexp_replace("p_name", "#", " # "), "#")
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.clean_keywords(F.concat(given, given, F.array(F.lit(" ")))), "|").alias("keywords"))


def json_replies(spark, sf):
    """Model replies in code fences, parsed."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(S.strip_fences(fenced), "$.k").cast("long").alias("k"))


def usage_windows(spark, sf):
    """Hourly counts by type: the batch form of the windowed stream."""
    from ..streaming import pipelines as P

    found = P.windowed_events(table(spark, sf, "events"), "1 hour", "1 hour")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


def payload_cut(spark, sf):
    """Texts cut to 50 bytes at a character."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.first_bytes(F.coalesce("text", F.lit("")), 50)).alias("cut_md5"))


def edit_distances(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein(F.col("p_name"), F.lit("green anvil")).alias("distance"))


def reverse_index(spark, sf):
    """Scene to topics: how many, and which, as a sum."""
    found = C.scene_members(_topics(spark, sf))
    return found.select("scene_id", F.size("topic_ids").alias("n"), F.expr("aggregate(topic_ids, 0L, (a, x) -> a + x)").alias("id_sum"))


def delete_graph(spark, sf):
    """Nodes that stay when the graphs of one brand are deleted with all they hold."""
    gone = _parts(spark, sf).where("graph_id = 'Brand#11'").select("id")
    live = _parts(spark, sf)
    return live.join(ST.tombstones(live, gone), "id", "left_anti").groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))


def delete_session(spark, sf):
    """Events that stay when some sessions are deleted."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"))
    return e.join(ST.tombstones(e, e.where("session_id % 5 = 0").select("id")), "id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


def flexible_ids(spark, sf):
    ids = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lpad(F.lower(F.hex("o_orderkey")), 16, "a")).alias("text"))
    return ids.where("o_orderkey % 2 = 0 or length(text) = 16").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, S.flexible_id(F.col("text"))).otherwise(F.lit(-1)).alias("id"))


def nodes_by_exact_keyword(spark, sf):
    return L.search_nodes(_parts(spark, sf), keyword="anvil").select("id", "graph_id")


def active_capabilities(spark, sf):
    return _capabilities(spark, sf).where("status = 1").select("id", S.enum_name(F.col("status"), CAPABILITY_STATUS, "Status").alias("status"))


def keyword_unions(spark, sf):
    """Old and new keywords in one, in order, without repeats; and old references without removed ones."""
    parts = table(spark, sf, "part")
    old, new = F.split("p_name", " "), F.array("p_brand", F.split("p_name", " ")[0])
    return parts.select("p_partkey", F.array_join(L.joined_keywords(old, new), "|").alias("merged"), F.array_join(L.without_references(old, new), "|").alias("rest"))


def node_bm25(spark, sf):
    """BM25 over title and content of graph nodes, scores of one graph."""
    return L.search_nodes(_parts(spark, sf), "Red ANVIL economy", graph_id="Brand#2").select("id", F.round("score", 6).alias("score"))


def nodes_of_graph_by_type(spark, sf):
    return L.search_nodes(_parts(spark, sf), node_type="ECONOMY", graph_id="Brand#2", limit=5).select("id")


def history_window(spark, sf):
    """What a snapshot hides of each conversation: calls and results are a user's and an assistant's turns here."""
    kind = F.when(F.col("role") == "user", "tool_call").when(F.col("role") == "assistant", "tool_result").otherwise("message")
    nodes = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), kind.alias("kind"))
    return L.history_window(nodes, 3, 2)


def snapshots(spark, sf):
    """A snapshot of each conversation, cut at 300 characters."""
    turns = table(spark, sf, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("role"), "text")))
    parts = turns.groupBy(F.col("conv_id").alias("key")).agg(F.transform(said, lambda a: F.struct(a["role"].alias("role"), a["text"].alias("content"))).alias("archives"))
    number = F.col("key").cast("string")
    parts = parts.withColumns({"profile": F.array(F.lit("Agent"), F.lit(""), number), "topics": F.array(F.array(F.lit("a"), number), F.array().cast("array<string>"))})
    return L.snapshot_text(parts, 300).select("key", "snapshot")


def active_scene_list(spark, sf):
    scenes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("scene_name"))
    return L.active_list(scenes, [3, 5, 99]).select("id", "scene_name")


def scene_delete(spark, sf):
    """The topics that are left after two scenes and some topics are deleted."""
    topics = _topics(spark, sf).select("id", "scene_id")
    return topics.join(L.doomed(topics, [1, 4], [2000, 3002]), "id", "left_anti")


def nodes_of_scene(spark, sf):
    return L.scene_nodes(_nodes(spark, sf), 7).select("id", F.round("importance", 6).alias("importance"))


def fused_summaries(spark, sf):
    """Fused topics with the keywords of their summaries; groups without keywords are skipped."""
    spans = C.group_spans(_groups(spark, sf), _topics(spark, sf).drop("scene_id"))
    words = F.when(F.col("group_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("kept"), F.col("group_id").cast("string")))
    summaries = spans.select("group_id", F.lit("s").alias("summary"), words.alias("keywords"), F.array(F.lit(1.0)).cast("array<float>").alias("vector"))
    made = C.with_summaries(C.fused_topics(spans), summaries)
    return made.select("group_id", F.array_join("fused_keywords", " ").alias("keywords"), F.col("centroid_ref").isNotNull().alias("has_centroid"))


def distill_prompt(spark, sf):
    """The prompt of the samples: how many lines, and its digest."""
    samples = _nodes(spark, sf).select("id", F.round("importance", 6).alias("importance"), F.round("importance", 6).alias("rank"))
    keywords = samples.where("id % 2 = 0").select("id", F.array(F.lit("k"), F.col("id").cast("string")).alias("keywords"))
    return C.distill_prompt(samples, keywords).select("samples", F.md5("prompt").alias("prompt_md5"))


def message_counts(spark, sf):
    """Messages by role name and conversation length: a grouped view of the archive."""
    a = _archive(spark, sf)
    role = S.enum_name(F.col("role"), {0: "user", 1: "agent", 2: "system"}, "Role")
    return a.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


_L1 = ctes("v_l1") + ", nd as (select id, scene_id, importance, valence, arousal, epoch_us(updated_at) // 1000 as updated_at from v_l1)"
_T = ctes("v_topic")
_TK = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({}, ''), '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[\p{{L}}\p{{Nd}}]+')"""
_UK, _AK = _TK.format("user_text"), _TK.format("agent_text")
_LOG = ctes("v_log") + ", cur as (select id, arg_max(seq, seq) as seq, arg_max(op, seq) as op, arg_max(payload, seq) as payload from v_log group by id)"
_EDGE = ctes("v_edge_member", "v_node")
_BFS = """, h1 as (select distinct b.node_id from v_edge_member a join v_edge_member b using (edge_id) where a.node_id = 1 {k}),
v1 as (select 1 as node_id, 0 as depth union select node_id, 1 from h1 where node_id <> 1)"""
_H2 = """, h2 as (select distinct b.node_id from v1 join v_edge_member a on a.node_id = v1.node_id join v_edge_member b using (edge_id) where true {k})
select node_id::bigint as node_id, depth from v1 union all select node_id, 2 from h2 where node_id not in (select node_id from v1)"""
_CAP = """cap as (select s_suppkey as id, s_name as name, case s_suppkey % 3 when 0 then 'mcp' when 1 then 'skill' else 'composite' end as type,
 'supplies nation ' || s_nationkey as summary, 'when in ' || s_nationkey as trig, 'about ' || s_nationkey as about, s_suppkey % 3 as status, s_suppkey * 7 % 13 as updated_at,
 s_suppkey % 10 = 8 as blank_step from supplier),
bi as (select n_nationkey * 9 as id, n_name as name, 'nation 1' as summary, '' as trig, 1 as status, 0 as updated_at from nation)"""
_GR = """, gr as (select scene_id * 10 + (id // 4) % 2 as group_id, scene_id, id, user_ts, agent_ts from v_topic where depth = 1),
ok as (select group_id, scene_id, min(user_ts) as user_ts, max(agent_ts) as agent_ts, count(*) as n from gr group by all having count(*) >= 2)"""
_DEC = """, de as (select *, importance * exp(-greatest(0, 0.01 - abs(valence) * arousal * 2) * greatest(1706745600000 - updated_at, 0) / 3600000.0) as f from nd)"""

QUERIES = {
    "current_state": (current_state, _LOG + "select id, seq, payload from cur where op <> 'D'"),
    "deleted_payloads": (deleted_payloads, _LOG + ", lv as (select id, arg_max(seq, seq) as seq, arg_max(payload, seq) as payload from v_log where op <> 'D' group by id)"
                         " select lv.id, lv.seq, lv.payload from lv join cur using (id) where cur.op = 'D'"),
    "delete_batch": (delete_batch, _LOG + "select id from cur where op <> 'D' and id in (select c_custkey * 2 from customer)"),
    "point_read": (point_read, _LOG + "select id, seq, payload from cur where op <> 'D' and id = 7"),
    "existing": (existing, _LOG + "select c_custkey as id from customer where c_custkey in (select id from cur where op <> 'D')"),
    "record_count": (record_count, _LOG + "select count(*) as n from cur where op <> 'D'"),
    "topics_by_depth": (topics_by_depth, _T + "select id, scene_id, depth, user_ts from v_topic where depth <= 2"),
    "topics_of_scene": (topics_of_scene, _T + "select id, depth, user_ts from v_topic where scene_id = 12"),
    "topics_by_reference": (topics_by_reference, _T + "select id, scene_id from v_topic where id % 7 = 3 or id % 5 = 3"),
    "topic_cards": (topic_cards, _T + f"select id, scene_id, depth, user_ts, array_to_string({_UK}, ', ') as title, 0 as turn_count, case when agent_ts > 0 then 2 else 1 end as archive_count from v_topic"),
    "scene_topic_counts": (scene_topic_counts, _T + "select c_custkey as id, c_name as scene_name, count(v.id) as topic_count from customer left join v_topic v on v.scene_id = c_custkey and v.depth = 1 group by all"),
    "scenes_by_ids": (scenes_by_ids, "select c_custkey as id, c_name as scene_name, n_nationkey as pos from nation join customer on c_custkey = n_nationkey * 11 % 40"),
    "child_counts": (child_counts, _T + "select a.id, a.scene_id, a.depth, count(b.id) as children from v_topic a left join v_topic b on b.parent_id = a.id and b.depth <= 2 where a.depth <= 2 group by all"),
    "topic_archives": (topic_archives, ctes("v_topic", "v_archive") + "select t.id, count(*) as n, md5(string_agg(a.content, '|' order by a.id)) as contents_md5 from v_topic t join v_archive a on a.id = t.id or (t.agent_ts > 0 and a.id = t.id + 1) group by t.id"),
    "merge_scenes": (merge_scenes, _T + "select case when scene_id in (2, 3, 5) then 1 else scene_id end as scene_id, count(*) as n from v_topic group by 1"),
    "associated_scene": (associated_scene, _T + "select scene_id, count(*) as n from v_topic where depth <= 2 and scene_id // 4 = 2 group by 1 order by n desc, scene_id limit 1"),
    "scene_usage": (scene_usage, "select user_id as scene_id, count(*) as hit_count, arg_max(epoch_us(ts) // 1000, event_id) as last_hit_at from events group by 1"),
    "usage_join": (usage_join, ctes("v_usage") + "select scene_id, case when scene_id % 3 <> 0 then hit_count else 0 end as hit_count from v_usage"),
    "archive_keyword": (archive_keyword, ctes("v_archive") + "select id, role, created_at from v_archive where contains(content, 'the')"),
    "archive_range": (archive_range, ctes("v_archive") + "select id, created_at from v_archive where created_at between 1000000 and 3000000"),
    "archive_ids": (archive_ids, ctes("v_archive") + "select c_custkey as pos, id, role from v_archive join customer on id = c_custkey * 1000"),
    "archive_search": (archive_search, ctes("v_archive") + "select id, role, context_id from v_archive where contains(content, 'e') and context_id = 5000"),
    "nodes_by_keyword": (nodes_by_keyword, ctes("v_node") + "select id, graph_id from v_node where contains(lower(title), 'promo') or contains(lower(content), 'promo')"),
    "nodes_by_type": (nodes_by_type, ctes("v_node") + "select id, node_type from v_node where node_type = 'STANDARD' order by id limit 25"),
    "nodes_by_ids": (nodes_by_ids, ctes("v_node") + "select id, graph_id, title from v_node where id in (3, 5, 10000000)"),
    "match_graphs": (match_graphs, ctes("v_node") + ", k as (select *, unnest(string_split(title, ' ')) as kw from v_node), t as (select unnest(['part#1', 'brand#12']) as t), tx as (select 'about part#77 and more' as x)"
                     " select distinct graph_id from k, t, tx where contains(lower(title), t) or contains(lower(content), t) or contains(lower(kw), t) or contains(t, lower(kw)) or contains(x, lower(title)) or (kw <> '' and contains(x, lower(kw)))"),
    "graph_summary": (graph_summary, _EDGE + ", s as (select edge_id, min(graph_id) as g, max(graph_id) as h from v_edge_member join v_node on node_id = id group by 1), c as (select g, count(*) as edges from s where g = h group by 1)"
                      " select graph_id, count(*) as nodes, coalesce(any_value(edges), 0) as edges from v_node left join c on g = graph_id group by 1"),
    "adjacency_degree": (adjacency_degree, ctes("v_edge_member") + "select a.node_id, count(distinct b.node_id) as degree from v_edge_member a join v_edge_member b using (edge_id) where a.node_id <> b.node_id group by 1"),
    "bfs": (bfs, ctes("v_edge_member") + _BFS.format(k="") + _H2.format(k="")),
    "bfs_kinds": (bfs_kinds, ctes("v_edge_member") + _BFS.format(k="and a.kind in (1, 2)") + _H2.format(k="and a.kind in (1, 2)")),
    "induced_edges": (induced_edges, ctes("v_edge_member") + _BFS.format(k="") + " select edge_id as id, any_value(kind) as kind, count(*) as n, sum(node_id)::bigint as node_sum from v_edge_member group by edge_id having bool_and(node_id in (select node_id from v1))"),
    "edges_without_nodes": (edges_without_nodes, _EDGE + "select edge_id as id, count(*) as n, sum(node_id)::bigint as node_sum from v_edge_member where node_id not in (select id from v_node where node_type = 'PROMO') group by 1 having count(*) >= 2"),
    "import_skip": (_import("skip"), f"with {_ITEMS} select p_brand, title, case when known then node_type else e[1].node_type end as node_type, case when known then content else e[1].content end as content, " + _OUT.format(k="case when known then keywords else e[1].keywords end")),
    "import_overwrite": (_import(""), f"with {_ITEMS} select p_brand, title, case when e is null then node_type else e[-1].node_type end as node_type, case when e is null then content else e[-1].content end as content, " + _OUT.format(k="case when e is null then keywords else e[-1].keywords end")),
    "import_merge": (_import("merge"), _MERGE),
    "capability_list": (capability_list, f"with {_CAP}, w as (select id, name, summary, trig, status, updated_at from cap union all select * from bi where id not in (select id from cap)) select id, name, updated_at from w where status = 1 and contains(lower(concat_ws(' ', name, summary, trig)), 'nation 1')"),
    "capability_get": (capability_get, f"with {_CAP}, w as (select id, name, 0 as p from cap union all select id, name, 1 from bi) select id, arg_min(name, p) as name from w group by id"),
    "capability_match": (capability_match, f"with {_CAP} select id, name from cap where status = 1 and (contains(lower(concat_ws(' ', name, summary, trig, name, about, 'r act')), 'about 3') or contains(summary, 'nation 17'))"),
    "capability_usage": (capability_usage, ctes("v_cap_use") + "select cap_id, count(*) as trigger_count, round(avg(success), 6) as success_rate, epoch_us(max(ts)) // 1000 as last_used from v_cap_use group by 1"),
    "capability_upsert": (capability_upsert, f"with {_CAP} select id, case when id % 3 <> 1 then 'new' else summary end as summary, case when id % 2 = 0 then status else 0 end as status, case when id % 2 = 0 then id else 0 end as trigger_count,"
                          " case when id % 2 = 0 then 1 else 99 end as created_at, case when id % 3 <> 1 then 99 else updated_at end as updated_at from cap where id % 2 = 0 or id % 3 <> 1"),
    "capability_validation": (capability_validation, f"with {_CAP} select id, case when type = 'composite' and blank_step then 'workflow step ref is required' else '' end as error from cap"),
    "crystallization": (crystallization, "select s_suppkey as seq, case when s_suppkey % 2 = 0 and s_suppkey % 3 = 0 then 'merge' when s_suppkey % 2 = 0 and (s_suppkey % 3 = 1 or s_suppkey % 5 <> 0) then 'reuse' when s_suppkey % 5 = 0 then 'error' else 'create' end as disposition from supplier"),
    "prompt_cards": (prompt_cards, f"with {_CAP} select id, md5(name || ' (' || type || ', v1)' || chr(10) || 'summary: ' || summary || chr(10) || 'trigger: ' || trig || chr(10) || 'steps: ' || case when blank_step then '' else 'r' end || ': act') as card_md5 from cap"),
    "session_events": (session_events, "select user_id as session_id, event_id as seq, event_type from events where user_id = 5"),
    "sequence_numbers": (sequence_numbers, "with o as (select user_id, count(*) as c from events where event_id % 2 = 0 group by 1) select e.user_id as session_id, event_id as event, coalesce(c, 0) + row_number() over (partition by e.user_id order by epoch_us(ts) // 1000, event_id) as seq from events e left join o using (user_id) where event_id % 2 = 1"),
    "turn_pairs": (turn_pairs, ctes("v_topic") + "select scene_id as conv_id, id % 1000 as turn, md5(user_text) as user_md5, md5(agent_text) as agent_md5 from v_topic"),
    "recent_turns": (recent_turns, "select * from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as k from conversations) x where k <= 4"),
    "compress_candidates": (compress_candidates, _T + "select scene_id, count(*) as topics from v_topic where depth = 1 group by 1 having count(*) >= 2"),
    "compress_groups": (compress_groups, _T + _GR.lstrip(",").join([", ", ""]) + ", rf as (select group_id, string_agg(r::varchar, ',' order by r) as l3_refs from (select distinct group_id, unnest([id % 7, id % 5]) as r from gr) group by 1)"
                        " select group_id, scene_id, user_ts, agent_ts, l3_refs, n from ok join rf using (group_id)"),
    "compress_sink": (compress_sink, _T + _GR + " select t.id, t.depth + case when ok.group_id is null then 0 else 1 end as depth, ok.group_id is not null as has_parent from v_topic t left join gr on gr.id = t.id left join ok on ok.group_id = gr.group_id"),
    "usage_feedback": (usage_feedback, _L1 + " select id, round(case when id % 4 <> 0 and 1706745600000 - updated_at < 21600000 then least(importance + 0.05, 1.0) else greatest(importance - 0.05, 0.0) end, 6) as importance from nd"),
    "node_sync": (node_sync, _T + ", m as (select scene_id, count(*) as n, count(*) filter (depth = 1) as one from v_topic where depth <= 2 group by 1),"
                  " s as (select *, case when scene_id % 3 = 0 or (scene_id % 5 = 0 and one = 0) then 'created' when scene_id % 5 = 0 and one < n then 'updated' else 'kept' end as change from m)"
                  " select scene_id, n, case change when 'created' then 1.0 else 0.5 end as importance, case change when 'kept' then 1 else 1706745600000 end as updated_at, change from s"),
    "stale_nodes": (stale_nodes, _T + ", f as (select id * 10 as id, id + case when id % 4 = 0 then 1 else 0 end as topic from v_topic)"
                    " select f.id from f left join v_topic t on t.id = f.topic left join v_topic p on p.id = t.parent_id where t.id is null or not (t.depth <= 2 or coalesce(t.depth = 3 and p.depth <= 2, false))"),
    "node_decay": (node_decay, _L1 + _DEC + " select id, round(f, 6) as importance, case when f < 0.05 then 'removed' when f < 0.15 then 'pruned' else 'kept' end as fate from de"),
    "edge_decay": (edge_decay, _EDGE + ", k as (select edge_id as id, count(*) as n from v_edge_member where node_id not in (select id from v_node where node_type = 'PROMO') group by 1 having count(*) >= 2), w as (select id, n, 0.9 * exp(-0.02 * (id % 200)) as weight from k)"
                   " select id, n, round(weight, 6) as weight from w where weight >= 0.05"),
    "distill_samples": (distill_samples, _L1 + " select id, round(importance * exp(-0.01 * greatest(1706745600000 - updated_at, 0) / 3600000.0), 6) as rank from nd order by importance * exp(-0.01 * greatest(1706745600000 - updated_at, 0) / 3600000.0) desc, id limit 50"),
    "sample_keywords": (sample_keywords, _T + f", w as (select scene_id as id, id as t, unnest({_UK}) as k, generate_subscripts({_UK}, 1) as i from v_topic where depth <= 2), r as (select *, row_number() over (partition by id order by t, i) as n from w)"
                        " select id, string_agg(k, ' ' order by n) as keywords from r where n <= 20 group by id"),
    "distilled_profile": (distilled_profile, _L1 + ", r as (select least(greatest(valence * 2 - 0.3, -1), 1) as v, least(greatest(arousal * 30, 0), 1) as a, case when valence * 5 - 0.9 < 0 then 'I' else 'E' end || case when valence * 5 - 1.0 < 0 then 'N' else 'S' end"
                          " || case when valence * 5 - 1.1 < 0 then 'T' else 'F' end || case when valence * 5 - 0.8 < 0 then 'J' else 'P' end as mbti_type from nd) select mbti_type, count(*) as n, min(format('{:.3f}', v)) as least_valence, max(format('{:.3f}', a)) as most_arousal from r group by 1"),
    "emotion_backfill": (emotion_backfill, _L1 + ", z as (select id, case when id % 2 = 0 then 0 else valence end as v, case when id % 2 = 0 then 0 else arousal end as a, updated_at from nd)"
                         " select id, round(case when v = 0 and a = 0 and id % 3 = 0 then 0.25 else v end, 6) as valence, round(case when v = 0 and a = 0 and id % 3 = 0 then 0.5 else a end, 6) as arousal, case when v = 0 and a = 0 and id % 3 = 0 then 1706745600000 else updated_at end as updated_at from z"),
    "profile_terms": (profile_terms, _T + f", tk as (select id, unnest(list_distinct({_UK} || {_AK})) as term from v_topic where depth <= 2), df as (select term, count(*) as df from tk group by 1 order by df desc, term limit 20), k as (select *, row_number() over (order by df desc, term) as i from df)"
                      " select string_agg(term, ', ' order by i) filter (i <= 5) as personality, string_agg(term, ', ' order by i) as top_keywords, '7' as total_engrams from k"),
    "camel_case": (camel_case, "select p_partkey, 'fetch ' || lower(p_type) || ' id ' || lower(p_type) as parts from part"),
    "trimmed": (trimmed, "select p_partkey, p_brand || '!)_' as trimmed from part"),
    "first_characters": (first_characters, "select doc_id, md5(substring(coalesce(text, ''), 1, 100)) as head_md5 from documents"),
    "enum_names": (enum_names, ctes("v_edge_member") + "select distinct kind, case kind when 0 then 'related' when 1 then 'causal' when 2 then 'part_of' when 3 then 'sequence' else 'Kind(' || kind || ')' end as name from v_edge_member"),
    "scene_names": (scene_names, ctes("v_archive") + "select id, created_at || ':' || substring(content, 1, 10) as name from v_archive where role = 0"),
    "hex_ids": (hex_ids, "select o_orderkey, lpad(lower(to_hex(o_orderkey * 1000003)), 16, '0') as hex, o_orderkey * 1000003 as back from orders"),
    "keyword_cleaning": (keyword_cleaning, "select p_partkey, case when contains(p_name, '#') then trim(split_part(p_name, '#', 1)) || '|' || trim(split_part(p_name, '#', 2)) else trim(p_name) end as keywords from part"),
    "json_replies": (json_replies, "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"),
    "payload_cut": (payload_cut, "select doc_id, md5(substring(t, 1, list_max(list_filter(range(0, 51), lambda i: octet_length(encode(substring(t, 1, i))) <= 50)))) as cut_md5 from (select doc_id, coalesce(text, '') as t from documents) x"),
    "edit_distances": (edit_distances, "select p_partkey, levenshtein(p_name, 'green anvil') as distance from part"),
    "reverse_index": (reverse_index, _T + "select scene_id, count(*) as n, sum(id)::bigint as id_sum from v_topic where depth <= 2 group by 1"),
    "delete_graph": (delete_graph, ctes("v_node") + "select graph_id, count(*) as nodes from v_node where graph_id <> 'Brand#11' group by 1"),
    "delete_session": (delete_session, "select user_id as session_id, count(*) as events from events where user_id % 5 <> 0 group by 1"),
    "flexible_ids": (flexible_ids, "select o_orderkey, case when o_orderkey % 2 = 0 then o_orderkey else -1 end as id from orders"),
    "nodes_by_exact_keyword": (nodes_by_exact_keyword, ctes("v_node") + "select id, graph_id from v_node where list_contains(string_split(title, ' '), 'anvil')"),
    "active_capabilities": (active_capabilities, f"with {_CAP} select id, 'active' as status from cap where status = 1"),
    "node_bm25": (node_bm25, ctes("v_node") + r""", tok as (select id, graph_id, regexp_extract_all(lower(title || ' ' || content), '[\p{L}\p{Nd}]+') as toks from v_node),
        st as (select count(*) as n, avg(len(toks)) as avgdl from tok), tf as (select id, graph_id, len(toks) as dl, q.term, len(list_filter(toks, lambda x: x = q.term)) as tf
        from tok, (values ('red'), ('anvil'), ('economy')) q(term)), df as (select term, count(*) as df from tf where tf > 0 group by term)
        select id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
        from tf join df using (term), st where tf > 0 and graph_id = 'Brand#2' group by id"""),
    "nodes_of_graph_by_type": (nodes_of_graph_by_type, ctes("v_node") + "select id from v_node where node_type = 'ECONOMY' and graph_id = 'Brand#2' order by id limit 5"),
    "history_window": (history_window, """with c as (select conv_id as session_id, turn as pos, case role when 'user' then 'tool_call' when 'assistant' then 'tool_result' else 'message' end as kind from conversations),
        w as (select *, sum(case kind when 'tool_call' then 1 when 'tool_result' then -1 else 0 end) over (partition by session_id order by pos) as waiting,
                     count(*) over (partition by session_id) - row_number() over (partition by session_id order by pos) as behind from c),
        k as (select session_id, max(pos) as cut from w where waiting = 0 and behind >= 3 group by 1)
        select session_id, pos, kind, coalesce(pos <= cut, false) as hidden from c left join k using (session_id)"""),
    "snapshots": (snapshots, r"""with m as (select conv_id as key, turn, case when role = 'assistant' then 'agent: ' else 'user: ' end as who, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from conversations),
        j as (select key, 'Memory snapshot: what was found for this session; the current messages take precedence.' || chr(10) || 'profile: Agent · ' || key || chr(10)
              || 'topics (2): a/' || key || coalesce(chr(10) || string_agg(who || t, chr(10) order by turn) filter (t <> ''), '') as s from m group by key)
        select key, case when length(s) > 300 then substring(s, 1, 300) || chr(10) || '…(snapshot cut)' else s end as snapshot from j"""),
    "active_scene_list": (active_scene_list, "select n_nationkey as id, n_name as scene_name from nation where n_nationkey in (3, 5, 99)"),
    "scene_delete": (scene_delete, _T + "select id, scene_id from v_topic where scene_id not in (1, 4) and id not in (2000, 3002)"),
    "nodes_of_scene": (nodes_of_scene, _L1 + " select id, round(importance, 6) as importance from nd where scene_id = 7"),
    "fused_summaries": (fused_summaries, _T + _GR + " select group_id, 'kept ' || group_id as keywords, true as has_centroid from ok where group_id % 3 <> 0"),
    "distill_prompt": (distill_prompt, _L1 + """, s as (select id, round(importance, 6) as imp from nd),
        l as (select id, imp, 'id_hex=' || lpad(to_hex(id), 16, '0') || ' importance=' || printf('%.3f', imp) || ' keywords=' || case when id % 2 = 0 then 'k ' || id else '' end as line from s)
        select count(*) as samples, md5(string_agg(lower(line[:23]) || line[24:], chr(10) order by imp desc, id)) as prompt_md5 from l"""),
    "keyword_unions": (keyword_unions, "select p_partkey, p_name_m || '|' || p_brand as merged, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> string_split(p_name, ' ')[1]), '|') as rest from (select *, replace(p_name, ' ', '|') as p_name_m from part) x"),
    "message_counts": (message_counts, ctes("v_archive") + "select case role when 0 then 'user' when 1 then 'agent' else 'system' end as role, count(*) as n, min(created_at) as first_at, max(created_at) as last_at from v_archive group by 1"),
    "usage_windows": (usage_windows, "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2"),
}
