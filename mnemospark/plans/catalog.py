"""The registered queries of the memory engine and their SQL."""

from __future__ import annotations

from . import layer_queries, retrieval_queries

FLAGSHIP = "retrieve_scene"

_ALL = {**retrieval_queries.QUERIES, **layer_queries.QUERIES}


def queries():
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
