"""The facade: the operations of the memory engine on one store.

Retrieval only reads; what a search also writes (topic, message, centroid, usage) is done by ingest(). search() is both in one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GRAPH_EDGE_KINDS, Defaults, code_of
from .errors import ENCODER, INVALID_QUERY, LLM, NOT_FOUND, MemoryError_
from .functions.scalars import clamp, enum_name, format_id, hash_id, parse_id, to_hex
from .functions.text import tokens, with_bigrams, words
from .operators import graph, layers, lifecycle, retrieval
from .providers import Encoder, HashEncoder, LanguageModel, OfflineModel
from .schema import SCHEMAS
from .sources import readers
from .sources.builtin import builtin_capabilities
from .sources.shared import settle
from .sources.store import Store


def _now() -> int:
    return int(time.time() * 1000)


class Memory:
    """All operations by name; identifiers outside are 16 hexadecimal digits."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default", encoder: Encoder | None = None,
                 model: LanguageModel | None = None, config: Defaults | None = None, builtin: DataFrame | None = None):
        self.spark, self.config = spark, (config or Defaults()).validate()
        self.encoder, self.model = encoder or HashEncoder(), model or OfflineModel()
        if hasattr(self.encoder, "available") and not self.encoder.available():
            raise MemoryError_(ENCODER, "the encoder is not available")
        self.store = Store(spark, root, tenant)
        self.active: list[int] = []
        self.last_dream = 0
        self.builtin = builtin if builtin is not None else builtin_capabilities(spark)

    # Helpers

    def _rows(self, table: str, rows: list[dict]) -> DataFrame:
        from pyspark.sql.types import _parse_datatype_string

        schema = _parse_datatype_string(SCHEMAS[table])
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    def _put(self, table: str, *rows: dict) -> None:
        self.store.append(table, self._rows(table, list(rows)))

    def _hash(self, *parts) -> int:
        """The identifier of a key, on the driver: one expression over literals."""
        return self.spark.range(1).select(hash_id(*(F.lit(p) if not isinstance(p, str) else p for p in parts))).first()[0]

    def _vectors(self) -> DataFrame:
        topics = self.store.table("topic").where("centroid_ref is not null")
        return topics.join(self.store.table("centroid").withColumnRenamed("id", "centroid_ref"), "centroid_ref").select("id", "vector")

    def _searchable(self) -> DataFrame:
        topics = self.store.table("topic")
        whole = F.array_union(F.coalesce("user_keywords", F.array().cast("array<string>")), F.coalesce("agent_keywords", F.array().cast("array<string>")))
        whole = F.array_union(whole, F.coalesce("fused_keywords", F.array().cast("array<string>")))
        return topics.withColumn("keywords", whole)

    # Core

    def retrieve(self, text: str, keywords: list[str] | None = None, l3_id: str | None = None) -> dict | None:
        """The best scene above the threshold, or None."""
        keywords = self.model.keywords(text) if keywords is None else keywords
        # Every channel searches the text and the keywords.
        wanted = " ".join(x for x in (text, " ".join(keywords)) if x)
        asked = self.spark.range(1).select(tokens(F.lit(wanted)).alias("t"), with_bigrams(words(F.lit(wanted))).alias("w")).first()
        topics = self._searchable()
        docs = layers.search_text(topics)
        scenes = retrieval.retrieve(topics, docs, self._vectors(), asked["t"], asked["w"], keywords, self.encoder.encode(wanted), self.active,
                                    parse_id(l3_id) if l3_id else None, self.config, self._index(docs))
        best = retrieval.winner(scenes, self.config.min_scene_score).first()
        return None if best is None else {"scene_id": format_id(best["scene_id"]), "score": best["score"]}

    def _index(self, docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Postings and lengths of all topics: the stored ones, but for topics that were written since. None without a stored index."""
        try:
            known = self.store.derived("indexed").first()["commit"]
            posted, lengths = self.store.derived("postings"), self.store.derived("lengths")
        except MemoryError_:
            return None
        changed = self.store.log("topic").where(F.col("commit") > known).select("id").distinct()
        fresh = docs.join(changed, "id", "left_semi")
        old = lambda x: x.join(changed, "id", "left_anti")
        return old(posted).unionByName(retrieval.postings(fresh)), old(lengths).unionByName(retrieval.document_lengths(fresh))

    def ingest(self, text: str, timestamp: int, scene_id: int | None = None, keywords: list[str] | None = None, l3_refs: list[int] | None = None) -> dict:
        """Writes a message as a topic of a scene (a new one if none is named)."""
        if timestamp <= 0:
            raise MemoryError_(INVALID_QUERY, "timestamp must be positive")
        keywords = self.model.keywords(text) if keywords is None else keywords
        if scene_id is None:
            name = f"{timestamp}:{text[:10]}"
            scene_id = self._hash(name)
            self._put("scene", {"id": scene_id, "scene_name": name})
        vector = [float(x) for x in self.encoder.encode(text)]
        centroid = self._hash("centroid:", ",".join(f"{x:.9g}" for x in vector))
        topic, archive = self._hash(scene_id, ":", timestamp, ":", 0), self._hash(scene_id, ":", timestamp, ":", text)
        self._put("centroid", {"id": centroid, "vector": vector})
        self._put("archive", {"id": archive, "content_type": 0, "role": 0, "context_id": topic, "created_at": timestamp, "content": text})
        self._put("topic", {"id": topic, "scene_id": scene_id, "depth": 1, "user_keywords": keywords, "agent_keywords": [], "fused_keywords": [],
                            "user_ts": timestamp, "agent_ts": 0, "children_ids": [], "l3_refs": l3_refs or [], "l4_refs": [archive], "centroid_ref": centroid})
        usage = self._hash("usage:", scene_id)
        old = self.store.table("scene_usage").where(F.col("scene_id") == scene_id).first()
        self._put("scene_usage", {"id": usage, "scene_id": scene_id, "hit_count": (old["hit_count"] if old else 0) + 1, "last_hit_at": _now()})
        self.active = layers.active_scenes(self.active, scene_id, self.config.capacity)
        return {"scene_id": format_id(scene_id), "topic_id": format_id(topic)}

    def search(self, text: str, timestamp: int, auto_create: bool = False, directed_l2: str | None = None, directed_l3: str | None = None) -> dict:
        """Finds or makes the scene of a message, stores the message there and returns the scene's topics."""
        if timestamp <= 0:
            raise MemoryError_(INVALID_QUERY, "timestamp must be positive")
        keywords, scene = self.model.keywords(text), None
        if not auto_create:
            hit = {"scene_id": directed_l2} if directed_l2 else self.retrieve(text, keywords, directed_l3)
            scene = parse_id(hit["scene_id"]) if hit else None
        made = self.ingest(text, timestamp, scene, keywords, [parse_id(directed_l3)] if directed_l3 else None)
        near = layers.associated_scene(parse_id(made["scene_id"]), self.store.table("scene_node"), self.store.table("topic")).first()
        return made | {"topics": self.scene_topics(made["scene_id"]), "profile": self.profile_get(), "associated": format_id(near[0]) if near else None}

    def update(self, topic_id: str, text: str, timestamp: int) -> None:
        """Adds the agent's reply to a topic: the message, its keywords (in place of the last), its time."""
        topic = self.store.read("topic", parse_id(topic_id))
        archive = self._hash(topic["id"], ":", timestamp, ":", text)
        self._put("archive", {"id": archive, "content_type": 0, "role": 1, "context_id": topic["id"], "created_at": timestamp, "content": text})
        refs = sorted({*(topic["l4_refs"] or []), archive})
        self._put("topic", topic | {"agent_keywords": self.model.keywords(text), "agent_ts": timestamp, "l4_refs": refs})

    def dream(self, scene_id: str | None = None, now_ms: int | None = None) -> dict:
        """Consolidates the named scene or the active ones."""
        targets = [parse_id(scene_id)] if scene_id else list(self.active)
        if not targets:
            return {"groups": 0}
        now = F.lit(now_ms or _now())
        topics = self.store.table("topic")
        due = lifecycle.scenes_to_compress(topics.where(F.col("scene_id").isin(*targets)), self.config.compress_min_topics)
        made, failed = 0, None
        for row in due.collect():  # at most as many scenes as may be active
            try:
                made += self._compress(row["scene_id"], self.model.consolidate(self._consolidate_prompt(row["scene_id"])), int(now_ms or _now()))
            except MemoryError_ as error:
                failed = error
        if failed and not made:
            raise MemoryError_(LLM, "no scene could be consolidated") from failed
        topics, nodes = self.store.table("topic"), self.store.table("scene_node")
        fed = lifecycle.usage_feedback(nodes, self.store.table("scene_usage"), now, self.config.ttl_ms, self.config.usage_step)
        synced = lifecycle.sync_nodes(fed, topics, now).join(nodes.select("id", "edge_ids", "created_at"), "id", "left")
        stale = lifecycle.stale_nodes(synced, topics)
        faded = lifecycle.decay_nodes(synced.join(stale, "id", "left_anti"), now, self.config)
        kept = faded.where("fate <> 'removed'").withColumn("importance", F.col("new_importance"))
        kept = kept.withColumn("edge_ids", F.when(F.col("fate") == "kept", F.col("edge_ids"))).withColumn("updated_at", now)
        gone = nodes.select("id").join(kept.select("id"), "id", "left_anti")
        edges = self.store.table("scene_edge")
        live_edges = lifecycle.decay_edges(edges, gone.select(F.col("id").alias("node_id")), now, self.config)
        # Both results are fixed before anything is written.
        kept, gone, live_edges = (settle(x) for x in (kept, gone, live_edges))
        dead = settle(edges.select("id").join(live_edges.select("id"), "id", "left_anti"))
        self.store.append("scene_node", kept)
        self.store.delete("scene_node", gone)
        self.store.append("scene_edge", live_edges)
        self.store.delete("scene_edge", dead)
        self._profile_from_index()
        self._distill(int(now_ms or _now()))
        self.last_dream = now_ms or _now()
        return {"groups": made}

    def _consolidate_prompt(self, scene: int) -> str:
        rows = self.store.table("topic").where((F.col("scene_id") == scene) & (F.col("depth") == 1))
        line = F.concat_ws(" ", to_hex(F.col("id")), F.array_join("user_keywords", ", "))
        lines = F.array_sort(F.collect_list(F.struct("user_ts", line.alias("line"))))
        return rows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).first()[0]

    def _compress(self, scene: int, groups: list[dict], now: int) -> int:
        given = []
        for i, g in enumerate(groups):
            summary = g.get("merged_summary", "")
            given.append((i, scene, [parse_id(h) for h in g["node_hashes"]], summary, self.model.keywords(summary), [float(x) for x in self.encoder.encode(summary)]))
        if not given:
            return 0
        schema = "group_id int, scene_id bigint, node_ids array<bigint>, summary string, keywords array<string>, vector array<float>"
        frame = self.spark.createDataFrame(given, schema)
        topics = self.store.table("topic")
        fused = lifecycle.fused_topics(lifecycle.group_spans(frame, topics.where("depth = 1").drop("scene_id")))
        fused = settle(lifecycle.with_summaries(fused, frame.select("group_id", "summary", "keywords", "vector")))
        self.store.append("centroid", fused.select(F.col("centroid_ref").alias("id"), "vector"))
        archive = fused.select(hash_id(F.col("id"), ":", F.lit(now), ":", F.col("summary")).alias("archive_id"), "id", "summary")
        self.store.append("archive", archive.select(
            F.col("archive_id").alias("id"), F.lit(0).alias("content_type"), F.lit(3).alias("role"), F.col("id").alias("context_id"),
            F.lit(now).alias("created_at"), F.col("summary").alias("content")))
        sunk = settle(lifecycle.sink_children(topics, fused))
        gone = settle(topics.select("id").join(sunk.select("id"), "id", "left_anti"))
        new = fused.join(archive.select("id", F.array("archive_id").alias("l4_refs")), "id")
        self.store.append("topic", sunk)
        self.store.append("topic", new)
        self.store.delete("topic", gone)
        return fused.count()

    def _profile_from_index(self) -> None:
        docs = layers.search_text(self.store.table("topic"))
        found = layers.profile_from_terms(retrieval.document_frequencies(retrieval.postings(docs)), F.lit(self.store.count())).first()
        terms = found["top_keywords"].split(", ") if found["top_keywords"] else []
        profile = self.profile_get() or layers.default_profile([], 0)
        profile["personality"] = ", ".join(terms[:5])
        profile["preferences"] = (profile.get("preferences") or {}) | {"top_keywords": found["top_keywords"], "total_engrams": found["total_engrams"]}
        self.profile_update(profile)

    def _distill(self, now: int) -> None:
        """Profile emotions and type from the nodes that matter most, as the model reads them; nodes without emotions get theirs."""
        nodes, topics = self.store.table("scene_node"), self.store.table("topic")
        samples = lifecycle.distill_samples(nodes, F.lit(now), self.config)
        row = lifecycle.distill_prompt(samples, lifecycle.sample_keywords(samples, topics, self.config.distill_keywords)).first()
        reply = self.model.distill(row["prompt"]) if row["samples"] else None
        if not reply:
            return
        emotion, kinds = reply.get("emotion") or {}, reply.get("mbti") or {}
        values = {c: float(emotion.get(c) or 0) for c in ("valence", "arousal", "dominance")} | {c: float(kinds.get(c) or 0) for c in ("ie", "ns", "tf", "jp")}
        found = lifecycle.distilled_profile(self.spark.createDataFrame([values])).first().asDict()
        profile = self.profile_get() or layers.default_profile([], 0)
        patterns = {c: found[c] for c in ("valence", "arousal", "dominance")} | {"updated_at_ms": str(now)}
        types = {c: v for c, v in found.items() if c.startswith("mbti")} | {"mbti_updated_at_ms": str(now)}
        profile |= {"emotion_patterns": (profile.get("emotion_patterns") or {}) | patterns, "preferences": (profile.get("preferences") or {}) | types, "personality": found["mbti_type"]}
        self.profile_update(profile)
        each = [(parse_id(n["id_hex"]), float(n.get("valence") or 0), float(n.get("arousal") or 0)) for n in reply.get("per_node") or []]
        if each:  # at most as many as there are samples
            emotions = self.spark.createDataFrame(each, "id bigint, new_valence double, new_arousal double")
            clamped = emotions.select("id", *(clamp(F.col(c), 0, 1).alias(c) for c in ("new_valence", "new_arousal")))
            felt = lifecycle.backfill_emotions(nodes.join(clamped.select("id"), "id", "left_semi"), clamped, F.lit(now))
            self.store.append("scene_node", settle(felt))

    def checkpoint(self) -> dict:
        """Materialises the sparse index, and notes the commit up to which it holds."""
        commits = self.store.commits("topic")
        docs = settle(layers.search_text(self.store.table("topic")))
        paths = {"postings": self.store.save_derived("postings", retrieval.postings(docs)), "lengths": self.store.save_derived("lengths", retrieval.document_lengths(docs))}
        self.store.save_derived("indexed", self.spark.createDataFrame([(commits[-1] if commits else 0,)], "commit bigint"))
        return paths

    def status(self) -> dict:
        return {"closed": self.store.closed, "active": [format_id(s) for s in self.active], "records": self.store.count(), "bytes": self.store.size(),
                "last_dream": self.last_dream, "dim": self.encoder.dim}

    def close(self) -> None:
        if not self.store.closed:
            self.checkpoint()
            self.store.close()

    # Profile and scenes

    def profile_get(self) -> dict:
        row = self.store.table("profile").first()
        return row.asDict(recursive=True) if row else {}

    def profile_update(self, profile: dict) -> None:
        self._put("profile", profile | {"id": self._hash("profile")})

    def scene_list(self) -> DataFrame:
        return layers.scene_topic_counts(self.store.table("scene"), self.store.table("topic"))

    def scene_active_list(self) -> list[str]:
        return [format_id(s) for s in self.active]

    def scene_active(self) -> DataFrame:
        """The active scenes with their names."""
        return layers.active_list(self.store.table("scene"), self.active)

    def scene_delete(self, scene_ids: list[str] | None = None, topic_ids: list[str] | None = None) -> int:
        """Deletes scenes with their topics, and topics by id; returns how many records went."""
        scenes, topics = [parse_id(s) for s in scene_ids or []], [parse_id(t) for t in topic_ids or []]
        gone = settle(layers.doomed(self.store.table("topic"), scenes, topics))
        count = self.store.delete("topic", gone)
        if scenes:
            count += self.store.delete("scene", self.spark.createDataFrame([(s,) for s in scenes], "id bigint"))
        self.active = [s for s in self.active if s not in scenes]
        return count

    def snapshot(self, found: dict, most: int = 4000) -> str:
        """What search() found as text for a host's prompt."""
        profile = found.get("profile") or {}
        topics = found["topics"].withColumn("l4", F.get("l4_refs", F.lit(0)))
        said = self.store.table("archive").join(topics.select(F.col("id").alias("context_id")), "context_id", "left_semi")
        order = F.array_sort(F.collect_list(F.struct("created_at", "id", F.col("role").cast("int").alias("role"), "content")))
        archives = said.agg(F.transform(order, lambda a: F.struct(a["role"].alias("role"), a["content"].alias("content"))).alias("archives"))
        keywords = topics.agg(F.transform(F.array_sort(F.collect_list(F.struct("user_ts", "id", "user_keywords"))), lambda t: t["user_keywords"]).alias("topics"))
        bits = F.array(*(F.lit(profile.get(c) or "") for c in ("name", "role", "personality"))).alias("profile")
        # Each side is one row.
        parts = keywords.crossJoin(archives).select(F.lit(0).alias("key"), bits, "topics", "archives")
        return layers.snapshot_text(parts, most).first()["snapshot"]

    def scene_topics(self, scene_id: str, depth: int = 1) -> DataFrame:
        return layers.list_topics(self.store.table("topic"), depth, parse_id(scene_id))

    def scene_merge(self, primary: str, secondary: list[str]) -> None:
        first, others = parse_id(primary), [parse_id(s) for s in secondary]
        topics = self.store.table("topic")
        moved = settle(layers.merge_scenes(topics, first, others).join(topics.where(F.col("scene_id").isin(*others)).select("id"), "id", "left_semi"))
        self.store.append("topic", moved)
        self.store.delete("scene", self.spark.createDataFrame([(s,) for s in others], "id bigint"))
        self.active = [s for s in self.active if s not in others]

    # Knowledge

    def knowledge_list(self) -> DataFrame:
        return self.store.table("graph").orderBy("id")

    def knowledge_get(self, graph_id: str) -> dict:
        g = parse_id(graph_id)
        own = lambda t: self.store.table(t).where(F.col("graph_id") == g)
        return self.store.read("graph", g) | {"nodes": own("graph_node"), "edges": own("graph_edge")}

    def knowledge_import(self, items: list[dict], mode: str = "") -> int:
        rows = [(i, x.get("title", ""), x.get("domain", ""), x.get("node_type"), x.get("content"), x.get("keywords")) for i, x in enumerate(items)]
        frame = self.spark.createDataFrame(rows, "seq int, title string, domain string, node_type string, content string, keywords array<string>")
        now = _now()
        after = layers.import_nodes(self.store.table("graph_node"), frame, mode, now)
        touched = settle(after.where("touched").drop("touched").withColumn("updated_at", F.lit(now)))
        graphs = frame.where(F.trim("title") != "").select(hash_id("graph:", F.col("domain")).alias("id"), F.col("domain").alias("name")).distinct()
        fresh = settle(graphs.join(self.store.table("graph").select("id"), "id", "left_anti").withColumn("created_at", F.lit(now)))
        self.store.append("graph", fresh)
        self.store.append("graph_node", touched)
        return touched.count()

    def knowledge_create(self, name: str) -> str:
        """An empty graph."""
        id_ = self._hash("graph:", name)
        self._put("graph", {"id": id_, "name": name, "created_at": _now(), "updated_at": _now()})
        return format_id(id_)

    def knowledge_node_search(self, text: str = "", graph_id: str | None = None, **query) -> DataFrame:
        return layers.search_nodes(self.store.table("graph_node"), text, graph_id=parse_id(graph_id) if graph_id else None, **query)

    def knowledge_update(self, graph_id: str, name: str) -> None:
        self._put("graph", self.store.read("graph", parse_id(graph_id)) | {"name": name, "updated_at": _now()})

    def knowledge_delete(self, graph_id: str) -> int:
        g = parse_id(graph_id)
        self.store.read("graph", g)
        count = self.store.delete("graph", self.spark.createDataFrame([(g,)], "id bigint"))
        return count + sum(self.store.delete(t, self.store.table(t).where(F.col("graph_id") == g).select("id")) for t in ("graph_node", "graph_edge"))

    def knowledge_nodes(self, graph_id: str | None = None, **query) -> DataFrame:
        return layers.query_nodes(self.store.table("graph_node"), parse_id(graph_id) if graph_id else None, **query)

    def knowledge_subgraph(self, graph_id: str, start_id: str, depth: int = 1, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        codes = [code_of(GRAPH_EDGE_KINDS, k) for k in kinds or []]
        return graph.subgraph(self.store.table("graph_node"), self.store.table("graph_edge"), parse_id(graph_id), parse_id(start_id), depth, codes)

    def knowledge_edge(self, graph_id: str, node_ids: list[str], kind: str = "related", weight: float = 1.0, label: str | None = None) -> str:
        ids = [parse_id(n) for n in node_ids]
        id_ = self._hash(graph_id, ":", ",".join(map(str, ids)))
        self._put("graph_edge", {"id": id_, "graph_id": parse_id(graph_id), "kind": code_of(GRAPH_EDGE_KINDS, kind), "node_ids": ids, "weight": float(weight), "label": label})
        return format_id(id_)

    def knowledge_match(self, terms: list[str], text: str = "") -> DataFrame:
        return layers.match_graphs(self.store.table("graph_node"), terms, text)

    # Archive

    def archive_search(self, keyword: str = "", start: int = 0, end: int = 0, ids: list[str] | None = None, context_id: str | None = None) -> DataFrame:
        wanted = self.spark.createDataFrame([(i, parse_id(x)) for i, x in enumerate(ids)], "pos int, id bigint") if ids else None
        return layers.search_archive(self.store.table("archive"), keyword, start, end, wanted, parse_id(context_id) if context_id else None)

    def archive_get(self, archive_id: str) -> dict:
        return self.store.read("archive", parse_id(archive_id))

    # Capabilities

    def _capabilities(self) -> DataFrame:
        return self.store.table("capability")

    def capability_import(self, path: str) -> int:
        now = _now()
        cards = layers.capability_errors(readers.new_cards(readers.capability_cards(self.spark, path), self._capabilities()))
        bad = cards.where("error is not null").first()
        if bad is not None:
            raise MemoryError_(INVALID_QUERY, bad["error"])
        rows = cards.drop("error", "format").withColumns({"status": F.lit(0), "origin": F.lit("imported"), "created_at": F.lit(now), "updated_at": F.lit(now),
                                                          "success_rate": F.lit(0.0), "trigger_count": F.lit(0)})
        shaped = rows.select(*self._capabilities().columns)
        merged = layers.upsert_capabilities(self._capabilities(), shaped).join(shaped.select("id"), "id", "left_semi")
        merged = settle(merged)
        self.store.append("capability", merged)
        return merged.count()

    def capability_get(self, capability_id: str) -> dict:
        one = lambda x: x.where(F.col("id") == parse_id(capability_id))
        row = layers.capability_by_id(one(self._capabilities()), one(self.builtin)).first()
        if row is None:
            raise MemoryError_(NOT_FOUND, "capability not found")
        return row.asDict(recursive=True)

    def _own_capability(self, capability_id: str) -> dict:
        found = self.capability_get(capability_id)
        if found["origin"] == "builtin":
            raise MemoryError_(INVALID_QUERY, "built-in capabilities are read-only")
        return found

    def capability_list(self, **query) -> DataFrame:
        return layers.list_capabilities(self._capabilities(), self.builtin, **query)

    def capability_delete(self, capability_id: str) -> int:
        return self.store.delete("capability", self.spark.createDataFrame([(self._own_capability(capability_id)["id"],)], "id bigint"))

    def capability_activate(self, capability_id: str) -> None:
        self._put("capability", self._own_capability(capability_id) | {"status": 1, "updated_at": _now()})

    def capability_update(self, capability_id: str, **patch) -> None:
        old = self._own_capability(capability_id)
        if "name" in patch:
            raise MemoryError_(INVALID_QUERY, "a capability's name is its identity")
        if patch.get("status") == 0 and old["status"] != 0:
            patch.pop("status")
        self._put("capability", old | patch | {"file_hash": None, "updated_at": _now()})

    def capability_usage(self, capability_id: str, success: bool) -> None:
        old = self._own_capability(capability_id)
        n = (old["trigger_count"] or 0) + 1
        rate = ((old["success_rate"] or 0.0) * (n - 1) + float(success)) / n
        self._put("capability", old | {"trigger_count": n, "success_rate": rate, "updated_at": _now()})

    def capability_match(self, text: str) -> DataFrame:
        asked = self.spark.range(1).select(tokens(F.lit(text))).first()[0]
        return layers.match_capabilities(self._capabilities(), asked)

    # Trajectories

    def trajectory_append(self, session_id: str, events: list[dict]) -> int:
        limit = self.config.payload_bytes
        rows = []
        for i, e in enumerate(events):
            payload = e.get("payload", "").encode()[:limit].decode("utf-8", "ignore")
            rows.append((i, parse_id(session_id), e["event_type"], payload, e.get("timestamp") or _now()))
        frame = self.spark.createDataFrame(rows, "pos int, session_id bigint, event_type string, payload string, timestamp bigint")
        numbered = settle(layers.next_sequence(self.store.table("trajectory"), frame))
        self.store.append("trajectory", numbered)
        return numbered.count()

    def trajectory_read(self, session_id: str) -> DataFrame:
        return layers.session_events(self.store.table("trajectory"), parse_id(session_id))

    def trajectory_delete(self, session_id: str) -> int:
        return self.store.delete("trajectory", self.trajectory_read(session_id).select("id"))

    def crystallize(self, session_id: str) -> dict:
        """Turns a session's events into capabilities, as the model proposes."""
        events = self.trajectory_read(session_id)
        if events.isEmpty():
            raise MemoryError_(NOT_FOUND, "no trajectory for session")
        prompt = events.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_type", "payload"))),
                                                     lambda e: F.concat_ws(" ", e["event_type"], e["payload"])), "\n")).first()[0]
        proposed = self.model.crystallize(prompt)
        result: dict[str, list] = {"created_ids": [], "reused_ids": [], "merged_ids": [], "errors": []}
        if not proposed:
            return result
        now = _now()
        cards = self._rows("capability", [p | {"id": 0, "status": 0, "origin": "crystallized", "version": p.get("version") or "1", "created_at": now, "updated_at": now} for p in proposed])
        extra = self.spark.createDataFrame([(p.get("name"), p.get("action"), parse_id(p["reuse_id"]) if p.get("reuse_id") else None, i) for i, p in enumerate(proposed)],
                                           "name string, action string, reuse_id bigint, seq int")
        checked = layers.capability_errors(cards.drop("id")).join(extra, "name")
        decided = settle(checked.join(layers.crystallize(checked.select("seq", "name", "action", "reuse_id", "error"), self._capabilities()).drop("name"), "seq"))
        names = self._capabilities().select(F.col("id").alias("target"), F.col("name").alias("known"))
        changed = decided.where("disposition in ('create', 'merge')").join(names, "target", "left")
        # A merge keeps the existing record's name, and so its identity.
        changed = changed.withColumn("name", F.coalesce("known", "name")).withColumnRenamed("target", "id").select(*self._capabilities().columns)
        merged = layers.upsert_capabilities(self._capabilities(), changed).join(changed.select("id"), "id", "left_semi")
        self.store.append("capability", settle(merged))
        for row in decided.select("disposition", "target", "name", "error").collect():  # as many as the model proposed
            if row["disposition"] == "error":
                result["errors"].append(f"{row['name']}: {row['error']}")
            else:
                result[{"create": "created_ids", "reuse": "reused_ids", "merge": "merged_ids"}[row["disposition"]]].append(format_id(row["target"]))
        return result


def shown(frame: DataFrame, id_columns: tuple[str, ...] = ("id",), kinds: dict[int, str] | None = None) -> DataFrame:
    """A frame with identifiers as hexadecimal text and kinds by name."""
    out = frame.withColumns({c: to_hex(F.col(c)) for c in id_columns})
    return out.withColumn("kind", enum_name(F.col("kind"), kinds, "Kind")) if kinds else out
