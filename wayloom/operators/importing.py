"""From ways (ordered node references with tags) to graph edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo


def way_refs(ways: DataFrame) -> DataFrame:
    """(way, pos, node, is_end)."""
    return ways.select("way", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node")).select("way", "pos", "node", ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("is_end"))


def node_types(refs: DataFrame) -> DataFrame:
    """(node, node_type): END and INTERMEDIATE are seen once, CONNECTION joins two ends, JUNCTION is all else."""
    seen = refs.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.col("is_end").cast("int")).alias("ends"))
    kind = F.when(F.col("n") == 1, F.when(F.col("ends") == 1, "END").otherwise("INTERMEDIATE")).when((F.col("n") == 2) & (F.col("ends") == 2), "CONNECTION").otherwise("JUNCTION")
    return seen.select("node", kind.alias("node_type"))


POINT = "struct<node:bigint,lat:double,lon:double>"


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, segment, part, points): each way cut at gaps, junctions and connections; loops are cut before their last node.

    A gap ends a segment of two nodes or more; a single node before a gap goes
    on with the next known node. A boundary node belongs to both segments. The
    fold runs inside one way, whose length the data format bounds.
    """
    refs = way_refs(ways)
    typed = refs.join(node_types(refs), "node").join(nodes.select("node", "lat", "lon"), "node", "left")
    tower = F.col("node_type").isin("JUNCTION", "CONNECTION")
    rows = typed.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "lat", "lon", tower.alias("tower")))).alias("refs"))
    none = F.array().cast(f"array<{POINT}>")
    closed = lambda s: F.concat(s["done"], F.array(s["cur"]))
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))

    def step(s, r):
        point = F.array(F.struct(r["node"].alias("node"), r["lat"].alias("lat"), r["lon"].alias("lon")))
        longer = F.concat(s["cur"], point)
        at_gap = F.when(F.size(s["cur"]) > 1, state(closed(s), none)).otherwise(s)
        at_tower = F.when(F.size(longer) > 1, state(F.concat(s["done"], F.array(longer)), point)).otherwise(state(s["done"], longer))
        return F.when(r["lat"].isNull(), at_gap).when(r["tower"], at_tower).otherwise(state(s["done"], longer))

    folded = F.aggregate("refs", state(F.array().cast(f"array<array<{POINT}>>"), none), step, lambda s: F.when(F.size(s["cur"]) > 1, closed(s)).otherwise(s["done"]))
    whole = rows.select("way", F.posexplode(folded).alias("segment", "points"))
    loop, n = F.element_at("points", 1)["node"] == F.element_at("points", -1)["node"], F.size("points")
    parts = F.when(loop & (n == 2), F.array().cast(f"array<array<{POINT}>>")).when(loop, F.array(F.slice("points", 1, n - 1), F.slice("points", n - 1, 2))).otherwise(F.array("points"))
    return whole.select("way", "segment", F.posexplode(parts).alias("part", "points"))


def edges_of(segments_: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, segment, part, from_node, to_node, n_points, geometry, distance_mm, tags) of each segment; what split_at_barriers() adds stays."""
    line = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    more = [c for c in ("piece", "barrier") if c in segments_.columns]
    ends = [F.element_at("points", 1)["node"].alias("from_node"), F.element_at("points", -1)["node"].alias("to_node")]
    lines = segments_.select("way", "segment", "part", *more, *ends, F.size("points").alias("n_points"), line.alias("geometry"))
    return lines.withColumn("distance_mm", geo.millimetres(geo.polyline_length(F.col("geometry")))).join(ways.select("way", "tags"), "way")


def without_loops(edges: DataFrame) -> DataFrame:
    """edges, with an error on reading one whose ends are the same node."""
    loop = F.col("from_node") == F.col("to_node")
    refused = F.raise_error(F.concat(F.lit("an edge from a node to itself: way "), F.col("way").cast("string"))).cast("long")
    return edges.withColumn("from_node", F.when(loop, refused).otherwise(F.col("from_node")))


def not_empty(nodes: DataFrame) -> DataFrame:
    if not nodes.limit(1).count():
        raise ValueError("the graph after import is empty")
    return nodes


def barrier_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, way, pos): where a barrier node that is no junction splits its first way; each gives an edge of no length."""
    refs = way_refs(ways)
    first = refs.join(node_types(refs).filter("node_type <> 'JUNCTION'"), "node").join(nodes.filter("barrier").select("node"), "node")
    return first.groupBy("node").agg(F.min(F.struct("way", "pos")).alias("x")).select("node", "x.way", "x.pos")


def copy_of(node):
    """The id of a barrier node's artificial copy: below zero, where no read node has one, and known without counting."""
    return -1 - node


def split_at_barriers(segments_: DataFrame, stops: DataFrame) -> DataFrame:
    """(way, segment, part, piece, barrier, points): segments cut at barrier nodes (node), each at its first place in the order of ways.

    A cut leaves the node at the end of the piece before it, puts a copy at the
    start of the piece after it, and joins both by an edge of no length with
    barrier set. At a segment's last node they change places, so that the node
    itself stays with what follows.
    """
    points = segments_.select("way", "segment", "part", F.posexplode("points").alias("i", "point"))
    places = points.select(F.col("point.node").alias("node"), "way", "segment", "part", (F.col("i") + 1).alias("i"))
    first = places.join(stops.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("way", "segment", "part", "i")).alias("x"))
    cuts = first.groupBy("x.way", "x.segment", "x.part").agg(F.array_sort(F.collect_list("x.i")).alias("cuts"))
    n, k = F.size("points"), F.size("cuts")
    at = lambda i: F.element_at("points", i)
    copied = lambda p: F.struct(copy_of(p["node"]).alias("node"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    before = lambda i: F.when(i == n, copied(at(i))).otherwise(at(i))
    after = lambda i: F.when(i == n, at(i)).otherwise(copied(at(i)))
    cut = lambda j: F.get("cuts", j)

    def piece(j):
        start, end = F.when(j == 0, 1).otherwise(cut(j - 1)), F.when(j == k, n).otherwise(cut(j))
        head = F.when(j == 0, F.slice("points", start, 1)).otherwise(F.array(after(start)))
        tail = F.when(j == k, F.slice("points", end, 1)).otherwise(F.array(before(end)))
        whole = F.concat(head, F.slice("points", start + 1, F.greatest(end - start - 1, F.lit(0))), tail)
        return F.struct(F.lit(False).alias("barrier"), F.when(end > start, whole).alias("points"))

    def gate(j):
        return F.struct(F.lit(True).alias("barrier"), F.when(j < k, F.array(before(cut(j)), after(cut(j)))).alias("points"))

    both = F.flatten(F.transform(F.sequence(F.lit(0), k), lambda j: F.array(piece(j), gate(j))))
    joined = segments_.join(cuts, ["way", "segment", "part"], "left")
    whole = F.array(F.struct(F.lit(False).alias("barrier"), F.col("points").alias("points")))
    pieces = F.when(F.col("cuts").isNull(), whole).otherwise(F.filter(both, lambda x: x["points"].isNotNull()))
    return joined.select("way", "segment", "part", F.posexplode(pieces).alias("piece", "x")).select("way", "segment", "part", "piece", "x.barrier", "x.points")


def dense_ids(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df with gapless numbers in the order of by; numbered by range, so no task sees all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *by).withColumn("·p", F.spark_partition_id()).persist()
    starts = placed.groupBy("·p").count().select("·p", F.coalesce(F.sum("count").over(Window.orderBy("·p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("·s"))
    inside = F.row_number().over(Window.partitionBy("·p").orderBy(*by)) - 1
    return placed.withColumn("·i", inside).join(F.broadcast(starts), "·p").withColumn(name, F.col("·s") + F.col("·i")).drop("·p", "·i", "·s")


def hilbert_order(nodes: DataFrame, order: int = 31) -> DataFrame:
    """nodes with their place on the curve and new dense ids along it."""
    return dense_ids(nodes.withColumn("hilbert", geo.hilbert(F.col("lat"), F.col("lon"), order)), "new_id", "hilbert", "node")


def sorted_graph(nodes: DataFrame, edges: DataFrame, turns: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, turns) numbered along the curve: new_id of nodes; new_edge, new_a and new_b of edges; the same of turns' edges and node.

    Edges follow the first of their ends, those of one node the latest first.
    nodes: (node, lat, lon); edges: (edge_id, a, b); turns: (from_edge, via_node, to_edge).
    """
    placed = hilbert_order(nodes)
    of = lambda old, new: placed.select(F.col("node").alias(old), F.col("new_id").alias(new))
    ends = edges.join(of("a", "new_a"), "a").join(of("b", "new_b"), "b")
    numbered = dense_ids(ends.withColumn("·first", F.least("new_a", "new_b")).withColumn("·late", -F.col("edge_id")), "new_edge", "·first", "·late").drop("·first", "·late")
    if turns is None:
        return placed, numbered, None
    edge = lambda old, new: numbered.select(F.col("edge_id").alias(old), F.col("new_edge").alias(new))
    moved = turns.join(edge("from_edge", "new_from"), "from_edge").join(edge("to_edge", "new_to"), "to_edge").join(of("via_node", "new_via"), "via_node")
    return placed, numbered, moved
