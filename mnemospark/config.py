"""Defaults, limits and enumerations of the memory engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from .errors import CONFIG, INVALID_QUERY, MemoryError_

# Codes and names of the enumerations, as records carry them.
CONTENT_TYPES = {0: "text", 1: "image", 2: "video", 3: "document", 4: "audio", 5: "code", 255: "other"}
CAPABILITY_STATUS = {0: "draft", 1: "active", 2: "deprecated"}
CAPABILITY_TYPES = ("mcp", "skill", "composite")
CAPABILITY_ORIGINS = ("imported", "crystallized", "host", "builtin")
SCENE_EDGE_KINDS = {0: "co_occurrence", 1: "causal", 2: "semantic", 3: "temporal", 4: "hierarchical", 5: "sequence"}
SOURCE_KINDS = {0: "path", 1: "context", 2: "url", 3: "manual"}
GRAPH_EDGE_KINDS = {0: "related", 1: "causal", 2: "part_of", 3: "sequence", 4: "dependency", 5: "custom"}
LAYERS = {0: "L0", 1: "L1", 2: "L2", 3: "L3", 4: "L4", 5: "L5"}
ROLES = {0: "user", 1: "agent", 2: "system", 3: "dream"}
IMPORT_MODES = ("skip", "merge", "overwrite")
TOKENIZER_ENGINES = ("", "auto", "gse")

_TENANT = re.compile(r"[A-Za-z0-9_-]{1,64}")


@dataclass(frozen=True)
class Defaults:
    """Tunable values of the engine."""

    rrf_k: float = 60.0
    activation_bonus: float = 0.2
    recent_bonus: float = 0.1
    lambda_node: float = 0.01
    lambda_edge: float = 0.02
    node_remove_threshold: float = 0.05
    node_prune_edges_threshold: float = 0.15
    edge_remove_threshold: float = 0.05
    min_edge_nodes: int = 2
    ttl_ms: int = 3_600_000
    capacity: int = 7
    tokenizer_engine: str = "auto"
    min_scene_score: float = 1.0
    vector_min_score: float = 0.5
    compress_min_topics: int = 20
    distill_samples: int = 200
    distill_keywords: int = 20
    distill_lambda: float = 0.01
    usage_step: float = 0.05
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    fuzzy_distance: int = 2
    payload_bytes: int = 4096

    def validate(self) -> Defaults:
        """Raises a configuration error for values out of range."""
        unit = ("node_remove_threshold", "node_prune_edges_threshold", "edge_remove_threshold", "vector_min_score")
        for field in fields(self):
            value = getattr(self, field.name)
            if isinstance(value, (int, float)) and value < 0:
                raise MemoryError_(CONFIG, f"{field.name} must not be negative")
            if field.name in unit and value > 1:
                raise MemoryError_(CONFIG, f"{field.name} must be at most 1")
        if self.tokenizer_engine not in TOKENIZER_ENGINES:
            raise MemoryError_(CONFIG, f"unknown tokenizer engine {self.tokenizer_engine!r}")
        return self


def validate_dim(dim: int) -> int:
    if not 1 <= dim <= 65_535:
        raise MemoryError_(CONFIG, "vector dimension must lie in 1..65535")
    return dim


def validate_tenant(tenant: str) -> str:
    if not _TENANT.fullmatch(tenant):
        raise MemoryError_(INVALID_QUERY, f"invalid tenant {tenant!r}")
    return tenant


def code_of(names: dict[int, str], name: str) -> int:
    """The code of an enumeration's name."""
    for code, known in names.items():
        if known == name.strip().lower():
            return code
    raise MemoryError_(INVALID_QUERY, f"unknown name {name!r}")
