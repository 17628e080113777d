"""The store, the facade and the streams end to end."""

import json

import pytest
from pyspark.sql import functions as F

from mnemospark import errors
from mnemospark.operators import layers
from mnemospark.providers import OfflineModel
from mnemospark.service import Memory, shown
from mnemospark.sources import readers
from mnemospark.sources.store import Store
from mnemospark.streaming import pipelines as P


def test_store_life(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(errors.MemoryError_):
        Store(spark, f"file://{tmp_path}")
    rows = lambda *r: spark.createDataFrame(r, "id long, scene_name string")
    store.append("scene", rows((1, "a"), (2, "b")))
    store.append("scene", rows((1, "a2"), (3, "c")))
    assert store.delete("scene", rows((2, ""), (99, ""))) == 1
    names = lambda: {r["id"]: r["scene_name"] for r in store.table("scene").collect()}
    assert names() == {1: "a2", 3: "c"} and store.read("scene", 1)["scene_name"] == "a2" and store.contains("scene", 3)
    with pytest.raises(errors.MemoryError_) as e:
        store.read("scene", 2)
    assert e.value.code == errors.NOT_FOUND
    assert [r["scene_name"] for r in store.deleted("scene").collect()] == ["b"]
    assert store.restore("scene") == 1 and names()[2] == "b"
    # A commit without its marker was torn: it is not seen.
    rows((7, "torn")).write.parquet(f"file://{tmp_path}/default/scene/commit=50")
    assert 7 not in names()
    store.compact("scene")
    assert len(store.commits("scene")) == 1 and names() == {1: "a2", 2: "b", 3: "c"} and store.count() == 3 and store.size() > 0
    first = store.save_derived("x", spark.range(3))
    assert store.save_derived("x", spark.range(4)) != first and store.derived("x").count() == 4
    store.close()
    with pytest.raises(errors.MemoryError_):
        store.table("scene")
    Store(spark, f"file://{tmp_path}", create=False).close()


def test_search_update_and_dream(spark, tmp_path):
    model = OfflineModel()
    memory = Memory(spark, f"file://{tmp_path}", model=model)
    first = memory.search("Learning Rust ownership and borrowing", 1000, auto_create=True)
    memory.search("Cooking pasta with tomato sauce", 2000, auto_create=True)
    again = memory.search("Rust ownership borrowing learning", 3000)
    assert again["scene_id"] == first["scene_id"] and again["topics"].count() == 2
    memory.update(first["topic_id"], "Ownership moves values", 1500)
    assert memory.archive_search(keyword="moves").count() == 1 and memory.archive_search(start=900, end=2500).count() == 3
    assert memory.scene_list().count() == 2 and len(memory.scene_active_list()) == 2
    memory.config = memory.config.__class__(compress_min_topics=2)
    model._groups = [{"node_hashes": [first["topic_id"], again["topic_id"]], "merged_summary": "Rust ownership"}]
    assert memory.dream(first["scene_id"], now_ms=10_000_000)["groups"] == 1
    topics = memory.scene_topics(first["scene_id"], 3).collect()
    assert sorted(t["depth"] for t in topics) == [1, 2, 2]
    assert memory.profile_get()["name"] == "Agent" and memory.store.table("scene_node").count() == 2
    # The fused topic has the model's keywords and a centroid of its own, so that it is found by vector.
    fused = next(t for t in topics if t["depth"] == 1)
    assert fused["fused_keywords"] == model.keywords("Rust ownership") and memory._vectors().where(F.col("id") == fused["id"]).count() == 1
    other = next(s for s in memory.scene_active_list() if s != first["scene_id"])
    memory.scene_merge(first["scene_id"], [other])
    assert memory.scene_list().count() == 1
    assert memory.status()["records"] > 0 and "postings" in memory.checkpoint()
    with pytest.raises(errors.MemoryError_):
        memory.search("x", 0)
    memory.close()


def test_distillation(spark, tmp_path):
    model = OfflineModel()
    memory = Memory(spark, f"file://{tmp_path}", model=model)
    made = memory.search("Learning Rust ownership", 1000, auto_create=True)
    memory.dream(made["scene_id"], now_ms=10_000_000)
    node = shown(memory.store.table("scene_node")).first()
    model._profile = {"emotion": {"valence": 0.25, "arousal": 7, "dominance": -1}, "mbti": {"ie": -0.5, "ns": 0.5, "tf": 0, "jp": -2},
                      "per_node": [{"id_hex": node["id"], "valence": 0.5, "arousal": 0.75}]}
    memory.dream(made["scene_id"], now_ms=20_000_000)
    profile = memory.profile_get()
    assert profile["personality"] == "ISFJ" and profile["preferences"]["mbti_type"] == "ISFJ" and profile["preferences"]["mbti_j_p"] == "-1.000"
    assert {c: profile["emotion_patterns"][c] for c in ("valence", "arousal", "dominance")} == {"valence": "0.250", "arousal": "1.000", "dominance": "0.000"}
    felt = memory.store.table("scene_node").first()
    assert (felt["valence"], felt["arousal"], felt["updated_at"]) == (0.5, 0.75, 20_000_000)
    model._profile["per_node"][0]["valence"] = 0.9
    memory.dream(made["scene_id"], now_ms=20_000_001)
    assert memory.store.table("scene_node").first()["valence"] == 0.5  # once felt, it stays
    memory.close()


def test_consolidation_that_fails(spark, tmp_path):
    class Broken(OfflineModel):
        def consolidate(self, prompt):
            raise errors.MemoryError_(errors.LLM, "no reply")

    memory = Memory(spark, f"file://{tmp_path}", model=Broken())
    made = memory.search("one topic of a scene", 1000, auto_create=True)
    memory.config = memory.config.__class__(compress_min_topics=1)
    with pytest.raises(errors.MemoryError_) as e:
        memory.dream(made["scene_id"], now_ms=10_000)
    assert e.value.code == errors.LLM
    memory.close()


def test_stored_index_and_snapshot(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}")
    first = memory.search("Learning Rust ownership and borrowing", 1000, auto_create=True)
    second = memory.search("Cooking pasta with tomato sauce", 2000, auto_create=True)
    scanned = [memory.retrieve(q) for q in ("Rust ownership borrowing learning", "pasta sauce tomato", "astronomy")]
    memory.checkpoint()
    assert memory._index(layers.search_text(memory.store.table("topic"))) is not None
    assert [memory.retrieve(q) for q in ("Rust ownership borrowing learning", "pasta sauce tomato", "astronomy")] == scanned
    # What is written after the checkpoint is found, and what changed counts once.
    third = memory.search("Gardening roses in spring", 3000, auto_create=True)
    memory.update(first["topic_id"], "Ownership moves values", 1500)
    with_index = [memory.retrieve(q) for q in ("gardening roses spring", "ownership moves values rust")]
    assert with_index[0]["scene_id"] == third["scene_id"] and with_index[1]["scene_id"] == first["scene_id"]
    memory.store._fs.delete(memory.store._path("_derived/indexed"), True)
    assert [memory.retrieve(q) for q in ("gardening roses spring", "ownership moves values rust")] == with_index
    # Keywords alone find a scene in every channel.
    assert memory.retrieve("", ["pasta", "tomato", "sauce", "cooking"])["scene_id"] == second["scene_id"]
    text = memory.snapshot(memory.search("Rust ownership again", 4000, directed_l2=first["scene_id"]))
    assert text.split("\n")[0].startswith("Memory snapshot") and "agent: Ownership moves values" in text and "topics (2): " in text
    assert memory.snapshot({"topics": memory.scene_topics(first["scene_id"])}, 20).endswith("(snapshot cut)")
    assert {r["id"] for r in shown(memory.scene_active()).collect()} == set(memory.scene_active_list())
    assert memory.scene_delete([second["scene_id"]], [third["topic_id"]]) == 3 and memory.scene_list().count() == 2
    memory.close()


def test_knowledge(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}")
    items = [{"title": "A", "domain": "d", "content": "one", "keywords": ["k"]}, {"title": "B", "domain": "d", "content": "two"}, {"title": " ", "domain": "d"}]
    assert memory.knowledge_import(items) == 2
    memory.knowledge_import([{"title": "A", "domain": "d", "content": "more", "keywords": ["k", "l"]}], "merge")
    g = shown(memory.knowledge_list()).first()["id"]
    nodes = {r["title"]: r for r in shown(memory.knowledge_nodes(g, keyword="o"), ("id", "graph_id")).collect()}
    assert nodes["A"]["content"] == "one\nmore" and nodes["A"]["keywords"] == ["k", "l"]
    memory.knowledge_edge(g, [nodes["A"]["id"], nodes["B"]["id"]], "causal")
    found, edges = memory.knowledge_subgraph(g, nodes["A"]["id"], 1, ["causal"])
    assert found.count() == 2 and edges.count() == 1
    assert [r["id"] for r in shown(memory.knowledge_node_search("more one", g)).collect()] == [nodes["A"]["id"]]
    assert memory.knowledge_node_search(keyword="k", limit=3).count() == 1
    empty_graph = memory.knowledge_create("empty")
    assert memory.knowledge_get(empty_graph)["nodes"].count() == 0 and memory.knowledge_delete(empty_graph) == 1
    assert memory.knowledge_match(["L"]).count() == 1 and memory.knowledge_get(g)["name"] == "d"
    memory.knowledge_update(g, "renamed")
    assert memory.knowledge_delete(g) == 4 and memory.knowledge_list().count() == 0
    memory.close()


def test_capabilities_and_trajectories(spark, tmp_path):
    card = {"name": "Search It", "type": "mcp", "summary": "find", "trigger": "when lost", "resources": [{"type": "mcp", "name": "s", "ref": "x"}]}
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "capability.json").write_text(json.dumps(card))
    model = OfflineModel(capabilities=[card | {"name": " search it", "action": "merge", "summary": "better"}, {"name": "bad", "type": "mcp"}, card | {"name": "New"}])
    memory = Memory(spark, f"file://{tmp_path}/db", model=model)
    path = f"file://{tmp_path}/cards"
    assert memory.capability_import(path) == 1 and memory.capability_import(path) == 0
    assert memory.capability_list().count() == 14
    id_ = shown(memory.capability_list(status=0)).first()["id"]
    built_in = shown(memory.capability_list(keyword="consolidate")).first()
    assert memory.capability_get(built_in["id"])["origin"] == "builtin"
    with pytest.raises(errors.MemoryError_):
        memory.capability_delete(built_in["id"])
    memory.capability_activate(id_)
    memory.capability_usage(id_, True)
    memory.capability_usage(id_, False)
    got = memory.capability_get(id_)
    assert (got["status"], got["trigger_count"], got["success_rate"]) == (1, 2, 0.5)
    assert memory.capability_match("I am lost").count() == 1
    session = "00000000000000aa"
    assert memory.trajectory_append(session, [{"event_type": "tool_call", "payload": "é" * 5000, "timestamp": 1}, {"event_type": "tool_result", "timestamp": 2}]) == 2
    memory.trajectory_append(session, [{"event_type": "tool_call", "timestamp": 3}])
    events = memory.trajectory_read(session).collect()
    assert [e["seq"] for e in events] == [1, 2, 3] and len(events[0]["payload"].encode()) == 4096
    made = memory.crystallize(session)
    assert (len(made["created_ids"]), made["merged_ids"], len(made["errors"])) == (1, [id_], 1)
    assert memory.capability_get(id_)["summary"] == "better" and memory.capability_get(id_)["status"] == 1
    memory.capability_update(id_, summary="s")
    assert memory.capability_delete(id_) == 1 and memory.trajectory_delete(session) == 3
    memory.close()


def test_conversation_reader(spark, tmp_path):
    turns = [{"text": "hi", "speaker": "A"}, {"text": "yo", "speaker": "B"}]
    (tmp_path / "c.json").write_text(json.dumps({"sessions": [{"id": "session_1_1:56 pm on 8 May, 2023", "turns": turns}, {"id": "x", "turns": []}]}))
    rows = readers.conversations(spark, f"file://{tmp_path}/c.json").orderBy("turn").collect()
    assert [r["text"] for r in rows] == ["hi", "yo"] and rows[0]["session_ms"] == 1_683_554_160_000


def _stream(spark, tmp_path, frame, name):
    frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/{name}")


def _run(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    traj = events.select(F.col("user_id").alias("session_id"), "event_type", F.col("props").alias("payload"), ms.alias("timestamp"), F.col("event_id").alias("pos"))
    numbered = _run(spark, P.sequence_numbers(_stream(spark, tmp_path, traj, "traj")), tmp_path, "numbered")
    assert numbered.count() == traj.count()
    assert numbered.groupBy("session_id").agg((F.max("seq") == F.count("*")).alias("ok")).where("not ok").count() == 0
    hits = _stream(spark, tmp_path, events.select(F.col("user_id").alias("scene_id"), ms.alias("ts")), "hits")
    counted = _run(spark, P.usage_counters(hits), tmp_path, "counted", "complete")
    assert counted.agg(F.sum("hit_count")).first()[0] == events.count()
    due = _run(spark, P.consolidation_triggers(_stream(spark, tmp_path, events.select(F.col("user_id").alias("scene_id")), "turns"), 5), tmp_path, "due")
    wanted = events.groupBy("user_id").agg(F.floor(F.count("*") / 5).alias("n")).agg(F.sum("n")).first()[0]
    assert due.count() == wanted
    idle = P.idle_sessions(_stream(spark, tmp_path, events.select(F.col("user_id").alias("key"), "ts"), "activity"))
    assert _run(spark, idle, tmp_path, "idle").count() > 0
    seen = []
    query = P.ingest_messages(hits, lambda batch, i: seen.append(batch.count()), f"{tmp_path}/cp_ingest", once=True)
    query.awaitTermination(120)
    assert sum(seen) == events.count()
