"""Hypergraph operators: adjacency, breadth-first search, induced subgraphs, removal of nodes from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import INVALID_QUERY, NOT_FOUND, MemoryError_
from ..sources.shared import settle, shares


def members(edges: DataFrame) -> DataFrame:
    """edge_id, kind, node_id of edges (id, kind, node_ids)."""
    return edges.select(F.col("id").alias("edge_id"), "kind", F.explode(F.array_distinct("node_ids")).alias("node_id"))


def adjacency(member: DataFrame) -> DataFrame:
    """Ordered pairs (a, b) of different nodes that share an edge. For small edges; searches use members directly.

    Edges are dealt into tasks by their members' number, pairs (each once, a < b) by the pairs' number, both counted before, so that a
    task's share does not grow with the graph. A pair of many edges is made one inside each task before it is sent.
    """
    spark = member.sparkSession
    member = member.select("edge_id", "node_id")
    of_edge = member.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
    rows, n_pairs = of_edge.agg(F.sum("n"), F.sum(F.expr("n * (n - 1) div 2"))).first()
    n = shares(spark, rows or 0)
    # An edge is in one part and a part in one task: neither the edges' lists nor the pairs of a part are sent again to be made distinct.
    dealt = member.where("edge_id is not null").withColumn("part", F.pmod(F.xxhash64("edge_id"), F.lit(16 * n))).repartition(n, "part")
    lists = dealt.groupBy("part", "edge_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    each = lists.select("part", "nodes", F.posexplode("nodes").alias("pos", "a"))
    local = each.select("part", "a", F.explode(F.slice("nodes", F.col("pos") + 2, F.size("nodes"))).alias("b")).distinct()
    pairs = local.select("a", "b").repartition(shares(spark, n_pairs or 0), "a", "b").distinct()
    return pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def breadth_first(member: DataFrame, start: DataFrame, depth: int, kinds: list[int] | None = None) -> DataFrame:
    """node_id, depth of what lies within so many hops (at least one) of start (node_id).

    A hop goes from the frontier to its edges and from these to their nodes, never over pairs of nodes, so that an edge of
    n nodes costs n rows. Each hop is checkpointed to the shared folder: lineage stays short, lost executors are survived.
    """
    if kinds:
        member = member.where(F.col("kind").isin(*kinds))
    member = member.select("edge_id", "node_id")
    visited = frontier = settle(start.select("node_id", F.lit(0).alias("depth")).distinct())
    used = None
    for hop in range(1, max(depth, 1) + 1):
        touched = member.join(frontier.select("node_id"), "node_id", "left_semi").select("edge_id").distinct()
        if used is not None:  # an edge's nodes are all visited once it was used
            touched = touched.join(used, "edge_id", "left_anti")
        touched = settle(touched)
        reached = member.join(touched, "edge_id", "left_semi").select("node_id").distinct()
        frontier = settle(reached.join(visited, "node_id", "left_anti").select("node_id", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        visited = settle(visited.union(frontier))
        used = touched if used is None else settle(used.union(touched))
    return visited


def induced_edges(edges: DataFrame, visited: DataFrame, kinds: list[int] | None = None) -> DataFrame:
    """Edges all of whose nodes are visited; an edge without nodes counts as such."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    outside = edges.select("id", F.explode("node_ids").alias("node_id")).join(visited.select("node_id"), "node_id", "left_anti")
    return edges.join(outside.select("id").distinct(), "id", "left_anti")


def subgraph(nodes: DataFrame, edges: DataFrame, graph_id: int, start_id: int, depth: int, kinds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (with depth) and induced edges around a start node of a graph."""
    start = nodes.where(F.col("id") == start_id)
    row = start.select("graph_id").first()
    if row is None:
        raise MemoryError_(NOT_FOUND, "start node not found")
    if row[0] != graph_id:
        raise MemoryError_(INVALID_QUERY, "start node belongs to another graph")
    own = edges.where(F.col("graph_id") == graph_id)
    visited = breadth_first(members(own), start.select(F.col("id").alias("node_id")), depth, kinds)
    found = nodes.join(visited, nodes["id"] == visited["node_id"]).drop("node_id")
    return found, induced_edges(own, visited, kinds)


def without_nodes(edges: DataFrame, removed: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Edges after nodes (node_id) are gone: those that keep at least so many, with what they keep; and the ids of the others."""
    gone = removed.select("node_id").distinct().withColumn("gone", F.lit(True))
    exploded = edges.select("id", F.posexplode_outer("node_ids").alias("pos", "node_id")).join(gone, "node_id", "left")
    kept = exploded.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("gone").isNull() & F.col("node_id").isNotNull(), F.struct("pos", "node_id")))).alias("kept")
    )
    left = edges.join(kept, "id").withColumn("node_ids", F.transform("kept", lambda k: k["node_id"])).drop("kept")
    enough = F.size("node_ids") >= least
    return left.where(enough), left.where(~enough).select("id")
