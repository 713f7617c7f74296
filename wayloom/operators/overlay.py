"""The query graph: the base graph with edges cut at snapped points, as a union without the cut edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_VIRTUAL = 1 << 40  # ids of virtual nodes and edges start here


def virtual_nodes(snaps: DataFrame) -> DataFrame:
    """(edge_id, share, node): snaps (edge_id, share) on the inside of edges; points at one share of an edge are one node, named by edge and order."""
    inner = snaps.filter((F.col("share") > 0) & (F.col("share") < 1)).select("edge_id", "share").distinct()
    place = F.row_number().over(Window.partitionBy("edge_id").orderBy("share"))
    return inner.select("edge_id", "share", (FIRST_VIRTUAL + F.col("edge_id") * 1024 + place).alias("node"))


def virtual_edges(snaps: DataFrame, edges: DataFrame) -> DataFrame:
    """The parts of cut edges, with the edge's other columns: edge_id is new, base_edge the old one; a and b are the ends, distance_mm sums to the edge's."""
    cuts = virtual_nodes(snaps)
    of_edge = cuts.join(edges, "edge_id")
    order = Window.partitionBy("edge_id").orderBy("share")
    at = F.round(F.col("share") * F.col("distance_mm")).cast("long")
    inner = of_edge.select("edge_id", "share", F.col("node"), at.alias("at"))
    ends = edges.join(cuts.select("edge_id").distinct(), "edge_id", "left_semi")
    stops = inner.union(ends.select("edge_id", F.lit(1.0), "b", "distance_mm")).union(ends.select("edge_id", F.lit(0.0), "a", F.lit(0).cast("long")))
    parts = stops.select("edge_id", F.row_number().over(order).alias("part"), F.lag("node").over(order).alias("from_node"), F.col("node").alias("to_node"), (F.col("at") - F.lag("at").over(order)).alias("length")).filter("from_node IS NOT NULL")
    other = [c for c in edges.columns if c not in ("edge_id", "a", "b", "distance_mm")]
    joined = parts.join(edges.select("edge_id", *other), "edge_id")
    return joined.select((FIRST_VIRTUAL + F.col("edge_id") * 1024 + F.col("part")).alias("edge_id"), F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("length").alias("distance_mm"), F.col("edge_id").alias("base_edge"), *other)


def query_graph(snaps: DataFrame, edges: DataFrame) -> DataFrame:
    """edges without those that are cut, and the virtual edges instead; base_edge is the edge itself where it wasn't cut."""
    cut_ids = virtual_nodes(snaps).select("edge_id").distinct()
    rest = edges.join(cut_ids, "edge_id", "left_anti").withColumn("base_edge", F.col("edge_id"))
    return rest.unionByName(virtual_edges(snaps, edges))
