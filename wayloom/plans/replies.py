"""Registered queries of split and renumbered graphs, answers, sides of roads and alternatives, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import alternatives, answers, contraction, importing, paths, resolvers
from wayloom.plans import fixtures as fx


def barrier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-8, I-9, I-13: segments cut at barriers, with copies of the barrier nodes and edges of no length."""
    ways, nodes = fx.order_ways(spark, sf_dir), fx.part_nodes(spark, sf_dir)
    cut = importing.split_at_barriers(importing.segments(ways, nodes), importing.barrier_edges(ways, nodes))
    return cut.select("way", "segment", "part", "piece", "barrier", F.concat_ws(",", F.transform("points", lambda p: p["node"].cast("string"))).alias("nodes"))


def graph_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-25: lanes with their new numbers and those of their ends."""
    _, edges, _ = importing.sorted_graph(fx.lane_nodes(spark, sf_dir), fx.lane_edges(spark, sf_dir).select("edge_id", "a", "b"))
    return edges.select("edge_id", "new_edge", "new_a", "new_b")


def route_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-1, R-3, R-4: an order's line items as legs between its parts' places, put together and rendered."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    k = F.col("l_partkey")
    place = F.struct((45 + (k % 97) * 0.01).alias("lat"), (5 + (k % 89) * 0.01).alias("lon"))
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("request"), F.row_number().over(w).alias("leg"), place.alias("a"), F.lead(place).over(w).alias("b"), F.col("l_quantity").cast("long").alias("q"))
    metres = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    legs = rows.filter("b IS NOT NULL").select("request", "leg", F.array("a", "b").alias("points"), F.round(metres).alias("distance"), (F.col("q") * 1000).alias("millis"), F.col("q").cast("double").alias("weight"))
    out = answers.rendered(answers.merged_legs(legs), encoded=False)
    last, side = F.col("instructions")[1], lambda i: F.round(F.get("bbox", F.lit(i)) * 100).cast("long")
    return out.select("request", "distance", "time", "weight", side(0).alias("min_lon"), side(1).alias("min_lat"), side(2).alias("max_lon"), side(3).alias("max_lat"), last["interval"][0].alias("last_point"), last["sign"].alias("sign"), (F.col("points") == F.col("snapped_waypoints")).alias("all_stops"))


def _ring(spark, sf_dir):
    """Edges of a node's own ring: each nation to the next, each fourth of them one-way, and three chords."""
    nodes = fx.lane_nodes(spark, sf_dir)
    n = F.col("node")
    steps = nodes.select(n.alias("edge_id"), n.alias("a"), ((n + 1) % 25).alias("b"), (n % 4 != 0).alias("both"))
    chords = nodes.filter(n % 10 == 0).select((n + 100).alias("edge_id"), n.alias("a"), ((n + 12) % 25).alias("b"), F.lit(True).alias("both"))
    at = lambda k: nodes.select(n.alias(k), F.struct("lat", "lon").alias("at_" + k))
    full = steps.union(chords).join(F.broadcast(at("a")), "a").join(F.broadcast(at("b")), "b")
    ahead = full.select(F.col("a").alias("node"), "edge_id", F.array("at_a", "at_b").alias("points"), F.col("both").alias("enters"), F.lit(True).alias("leaves"))
    return ahead.union(full.select("b", "edge_id", F.array("at_b", "at_a"), F.lit(True), F.col("both")))


def curbsides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-22: for each customer the edges of its nation on the ring by which its place is on the right, or left."""
    k = F.col("c_custkey")
    asked = fx.table(spark, sf_dir, "customer").select(k.cast("long").alias("request"), F.col("c_nationkey").cast("long").alias("node"), (45 + (k % 241) * 0.01).alias("lat"), (5 + (k % 239) * 0.01).alias("lon"))
    return resolvers.sides(_ring(spark, sf_dir), asked)


def heading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-21, U-14: lanes, seen from their first end, that lead more than 100 degrees off the heading 60."""
    e = fx.lane_edges(spark, sf_dir)
    ends = F.array(*[F.struct(F.col("lat_" + x).alias("lat"), F.col("lon_" + x).alias("lon")) for x in "ab"])
    return resolvers.other_headings(e.select(F.col("a").alias("node"), "edge_id", ends.alias("points")), F.lit(60.0)).select("node", "edge_id")


def route_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-18 to C-20, C-23: up to three ways between each nation and the one twelve on."""
    arcs = paths.cut(fx.arcs_of(fx.lane_edges(spark, sf_dir)))
    _, ch_arcs = contraction.prepared(arcs)
    n = F.col("node")
    asked = fx.lane_nodes(spark, sf_dir).select(n.alias("request"), n.alias("source"), ((n + 12) % 25).alias("target"))
    return alternatives.alternative_routes(asked, ch_arcs, arcs)


def oracles(edges: str, ways: str, segments: str, curve: str, nodes: str) -> dict[str, str]:
    """SQL over the CTEs that the catalog shares."""
    at = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    return {
        "barrier_split": f"""WITH {ways}, {segments},
places AS (SELECT way, segment, part, len(nodes) AS n, unnest(nodes) AS node, unnest(generate_series(1, len(nodes))) AS i FROM split),
cuts AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.node ORDER BY way, segment, part, i) AS r FROM places p JOIN types ty ON ty.node = p.node JOIN part ON p_partkey = p.node % 1000000 WHERE node_type <> 'JUNCTION' AND p_size % 25 = 0) WHERE r = 1),
starts AS (SELECT way, segment, part, i AS s, TRUE AS cut FROM cuts UNION ALL SELECT way, segment, part, 0, FALSE FROM split),
spans AS (SELECT *, lead(s) OVER (PARTITION BY way, segment, part ORDER BY s) AS e FROM starts),
named AS (SELECT x.*, nodes, len(nodes) AS n, coalesce(e, len(nodes)) AS z FROM spans x JOIN split y USING (way, segment, part)),
pieces AS (SELECT way, segment, part, 2 * s + 1 AS o, FALSE AS barrier, list_concat(CASE WHEN NOT cut THEN nodes[1:1] WHEN s = n THEN [nodes[s]] ELSE [-1 - nodes[s]] END, nodes[greatest(s, 1) + 1:z - 1], CASE WHEN e IS NULL OR e < n THEN [nodes[z]] ELSE [-1 - nodes[z]] END) AS nodes FROM named WHERE z > greatest(s, 1)
  UNION ALL SELECT way, segment, part, 2 * s, TRUE, CASE WHEN s = n THEN [-1 - nodes[s], nodes[s]] ELSE [nodes[s], -1 - nodes[s]] END FROM named WHERE cut)
SELECT way, segment, part, CAST(row_number() OVER (PARTITION BY way, segment, part ORDER BY o) - 1 AS INT) AS piece, barrier, array_to_string(nodes, ',') AS nodes FROM pieces""",
        "graph_sort": f"""WITH {curve}, {edges}, ends AS (SELECT edge_id, p.new_id AS new_a, q.new_id AS new_b FROM edges JOIN placed_nodes p ON p.node = a JOIN placed_nodes q ON q.node = b)
SELECT edge_id, row_number() OVER (ORDER BY least(new_a, new_b), edge_id DESC) - 1 AS new_edge, new_a, new_b FROM ends""",
        "route_answers": f"""WITH p AS (SELECT CAST(l_orderkey AS BIGINT) AS request, CAST(l_quantity AS BIGINT) AS q, l_partkey % 97 AS y, l_partkey % 89 AS x, row_number() OVER ({at}) AS leg, lead(l_partkey % 97) OVER ({at}) AS y2, lead(l_partkey % 89) OVER ({at}) AS x2 FROM lineitem),
d AS (SELECT *, 45 + y * CAST(0.01 AS DOUBLE) AS lat_a, 45 + y2 * CAST(0.01 AS DOUBLE) AS lat_b, 5 + x * CAST(0.01 AS DOUBLE) AS lon_a, 5 + x2 * CAST(0.01 AS DOUBLE) AS lon_b FROM p WHERE y2 IS NOT NULL),
m AS (SELECT *, round(CAST(12742000 AS DOUBLE) * asin(sqrt(pow(sin(radians(lat_b - lat_a) / 2), 2) + pow(sin(radians(lon_b - lon_a) / 2), 2) * cos(radians(lat_a)) * cos(radians(lat_b))))) AS metres FROM d)
SELECT request, sum(metres) AS distance, CAST(sum(q) * 1000 AS BIGINT) AS time, CAST(sum(q) AS DOUBLE) AS weight, CAST(500 + least(min(x), min(x2)) AS BIGINT) AS min_lon, CAST(4500 + least(min(y), min(y2)) AS BIGINT) AS min_lat,
  CAST(500 + greatest(max(x), max(x2)) AS BIGINT) AS max_lon, CAST(4500 + greatest(max(y), max(y2)) AS BIGINT) AS max_lat, CAST(count(*) AS INT) AS last_point, CAST(4 AS INT) AS sign, TRUE AS all_stops FROM m GROUP BY request""",
        "curbsides": f"""WITH n AS (SELECT node, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({nodes})),
c AS (SELECT CAST(c_custkey AS BIGINT) AS request, CAST(c_nationkey AS BIGINT) AS node, CAST((c_nationkey + 24) % 25 AS BIGINT) AS before, 45 + (c_custkey % 241) * CAST(0.01 AS DOUBLE) AS lat, 5 + (c_custkey % 239) * CAST(0.01 AS DOUBLE) AS lon FROM customer),
s AS (SELECT c.*, (a.lon - h.lon) AS ax, (a.lat - h.lat) AS ay, (b.lon - h.lon) AS bx, (b.lat - h.lat) AS by_, c.lon - h.lon AS qx, c.lat - h.lat AS qy FROM c JOIN n h ON h.node = c.node JOIN n a ON a.node = before JOIN n b ON b.node = (c.node + 1) % 25),
t AS (SELECT *, NOT ((qx - ax) * (by_ - ay) - (qy - ay) * (bx - ax) < 0) AS r, node IN (0, 10, 20, 12, 22, 7) AS crossing, node % 4 <> 0 AND before % 4 <> 0 AS open FROM s)
SELECT request, node, CASE WHEN crossing THEN -2 WHEN r THEN before WHEN open THEN node ELSE -1 END AS in_right, CASE WHEN crossing THEN -2 WHEN r THEN node WHEN open THEN before ELSE -1 END AS out_right,
  CASE WHEN crossing THEN -2 WHEN NOT r THEN before WHEN open THEN node ELSE -1 END AS in_left, CASE WHEN crossing THEN -2 WHEN NOT r THEN node WHEN open THEN before ELSE -1 END AS out_left FROM t""",
        "heading_edges": f"""WITH {edges}, o AS (SELECT a, edge_id, degrees(atan2(lat_b - lat_a, cos(radians((lat_a + lat_b) / 2)) * (lon_b - lon_a))) AS d FROM edges)
SELECT a AS node, edge_id FROM o WHERE abs(CASE WHEN d < -150 THEN d + 360 ELSE d END - 30) > 100""",
    }


QUERIES = {f.__name__: f for f in (barrier_split, graph_sort, route_answers, curbsides, heading_edges, route_alternatives)}
