"""Explicit schemas of the memory layers. Identifiers are 64-bit hashes, times are milliseconds."""

from __future__ import annotations

VERSION = 2

_SOURCE = "struct<kind:tinyint,value:string,context_id:bigint>"
_RESOURCE = "struct<type:string,name:string,ref:string,description:string,config:map<string,string>>"
_WORKFLOW = "struct<steps:array<struct<ref:string,action:string>>>"

SCHEMAS = {
    "profile": "id bigint, name string, role string, personality string, preferences map<string,string>, lexicon map<string,string>,"
    " style_traits array<string>, emotion_patterns map<string,string>",
    "scene_node": "id bigint, scene_id bigint, topic_ids array<bigint>, importance float, valence double, arousal double,"
    " created_at bigint, updated_at bigint, edge_ids array<bigint>, last_decay_at bigint",
    "scene_edge": "id bigint, kind tinyint, node_ids array<bigint>, weight float, created_at bigint, last_decay_at bigint",
    "scene": "id bigint, scene_name string",
    "topic": "id bigint, scene_id bigint, parent_id bigint, children_ids array<bigint>, depth int, user_keywords array<string>,"
    " agent_keywords array<string>, fused_keywords array<string>, user_ts bigint, agent_ts bigint, l3_refs array<bigint>,"
    " l4_refs array<bigint>, centroid_ref bigint",
    "centroid": "id bigint, vector array<float>",
    "graph": f"id bigint, name string, source {_SOURCE}, created_at bigint, updated_at bigint",
    "graph_node": "id bigint, graph_id bigint, title string, node_type string, content string, keywords array<string>,"
    " source_ref string, importance float, created_at bigint, updated_at bigint",
    "graph_edge": "id bigint, graph_id bigint, kind tinyint, node_ids array<bigint>, weight float, label string",
    "archive": "id bigint, content_type tinyint, role tinyint, context_id bigint, created_at bigint, content string, metadata string",
    "capability": f"id bigint, name string, version string, type string, summary string, trigger string, resources array<{_RESOURCE}>,"
    f" workflow {_WORKFLOW}, status tinyint, origin string, file_hash string, success_rate float, trigger_count bigint,"
    " created_at bigint, updated_at bigint",
    "scene_usage": "id bigint, scene_id bigint, hit_count bigint, last_hit_at bigint",
    "trajectory": "id bigint, session_id bigint, seq bigint, event_type string, payload string, l4_ref bigint, timestamp bigint",
}
