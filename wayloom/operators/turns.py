"""Turn costs: edge-based search as node-based search on the graph of arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import costs
from wayloom.operators import contraction
from wayloom.operators.paths import cut, distances


def turn_links(arcs: DataFrame, turns: DataFrame, u_turn: float = -1.0, weight: str = "millis") -> DataFrame:
    """(edge_key, base, adj, millis): which arc may follow which, as arcs between edge keys; the weight is the turn's and the following arc's.

    turns: (from_edge, via_node, to_edge, cost, restricted). A negative u_turn forbids turning back.
    """
    came = arcs.select(F.col("edge_key").alias("k1"), F.col("adj").alias("via_node"))
    goes = arcs.select(F.col("edge_key").alias("k2"), F.col("base").alias("via_node"), F.col(weight).alias("w"))
    from_edge, to_edge = F.shiftright("k1", 1), F.shiftright("k2", 1)
    pairs = came.join(goes, "via_node").select("*", from_edge.alias("from_edge"), to_edge.alias("to_edge"))
    known = pairs.join(turns, ["from_edge", "via_node", "to_edge"], "left")
    extra = costs.turn_weight(F.col("from_edge"), F.col("to_edge"), F.col("cost"), F.col("restricted"), u_turn)
    priced = known.withColumn("extra", extra).filter(F.col("extra") < float("inf"))
    return priced.select(F.col("k2").alias("edge_key"), F.col("k1").alias("base"), F.col("k2").alias("adj"), (F.col("w") + F.col("extra")).cast("long").alias("millis"))


def turn_distances(arcs: DataFrame, turns: DataFrame, sources: DataFrame, u_turn: float = -1.0, first_edges: DataFrame | None = None, last_edges: DataFrame | None = None, search=distances) -> DataFrame:
    """(source, node, weight): the shortest ways with turn costs. first_edges and last_edges (node, edge_id) restrict how a node is left and reached.

    search(links, sources) gives (source, node, weight) on the graph of arcs.
    """
    starts = arcs.join(sources.select(F.col("node").alias("base")), "base").select("edge_key", F.col("base").alias("source"), F.col("adj").alias("first"), F.col("millis").alias("w0"))
    if first_edges is not None:
        allowed = first_edges.select(F.col("node").alias("source"), F.col("edge_id"))
        starts = starts.withColumn("edge_id", F.shiftright("edge_key", 1)).join(allowed, ["source", "edge_id"], "left_semi")
    tree = search(turn_links(arcs, turns, u_turn), starts.select(F.col("edge_key").alias("node")).distinct())
    reached = tree.select(F.col("source").alias("edge_key"), F.col("node").alias("last"), "weight")
    whole = reached.join(starts, "edge_key").select("source", "last", (F.col("w0") + F.col("weight")).alias("weight"))
    ends = whole.join(arcs.select(F.col("edge_key").alias("last"), F.col("adj").alias("node")), "last")
    if last_edges is not None:
        ends = ends.withColumn("edge_id", F.shiftright("last", 1)).join(last_edges.select("node", "edge_id"), ["node", "edge_id"], "left_semi")
    own = sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("weight"))
    return ends.select("source", "node", "weight").union(own).groupBy("source", "node").agg(F.min("weight").alias("weight"))


def by_hierarchy(links: DataFrame, sources: DataFrame) -> DataFrame:
    """distances() over a contraction of the graph of arcs: a hierarchy whose levels belong to arcs, with turns in its weights."""
    links = cut(links)
    nodes = links.select(F.col("base").alias("node")).union(links.select("adj")).union(sources.select("node")).distinct()
    _, ch_arcs = contraction.prepared(links)
    own = sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("weight"))
    found = contraction.ch_distances(ch_arcs, sources, nodes).union(own)
    return found.groupBy("source", "node").agg(F.min("weight").alias("weight"))
