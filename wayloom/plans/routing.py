"""Registered queries of turn costs, hierarchies, snapped points, requests and filters, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import filters, geo, requests, tags
from wayloom.operators import connectivity, contraction, overlay, paths, turns
from wayloom.plans import fixtures as fx

PART_ROUNDS = 30
DURATIONS = ("10", "1:30", "0:02:30", "PT45M", "P1DT2H", "x", "")


def sssp_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4 by rounds of joins, over the part links, which grow with the tables: costs from part 1."""
    start = spark.createDataFrame([(1,)], "node long")
    return paths.distances_by_rounds(fx.part_arcs(spark, sf_dir), start).select("node", F.col("weight").alias("millis"))


def scc_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-19 by colours, over the part links of open orders (status P), which grow with the tables."""
    open_ = fx.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    ways = paths.cut(fx.order_refs(fx.table(spark, sf_dir, "lineitem").join(open_, "l_orderkey", "left_semi")).select("refs"))
    steps = ways.select(F.explode(F.zip_with("refs", F.slice("refs", 2, F.size("refs")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x")).select("x.a", "x.b").filter("b IS NOT NULL").distinct()
    nodes = ways.select(F.explode("refs").alias("node")).distinct()
    return connectivity.components_by_colours(steps, nodes)


def _turns(arcs: DataFrame) -> DataFrame:
    e = arcs.select(F.shiftright("edge_key", 1).alias("edge"), F.col("adj").alias("node")).union(arcs.select(F.shiftright("edge_key", 1), "base")).distinct()
    pairs = e.select(F.col("edge").alias("from_edge"), F.col("node").alias("via_node")).join(e.select(F.col("edge").alias("to_edge"), F.col("node").alias("via_node")), "via_node")
    f, t = F.col("from_edge"), F.col("to_edge")
    return pairs.filter((f != t) & ((f + t) % 4 == 0)).select(f, "via_node", t, ((f * 3 + t * 5) % 7 * 100000).cast("double").alias("cost"), ((f + 2 * t) % 11 == 0).alias("restricted"))


def turn_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-20, W-5 to W-7, T-3: travel milliseconds from nation 0 with turn costs, restrictions and no turning back."""
    arcs = paths.cut(fx.arcs_of(fx.lane_edges(spark, sf_dir)))
    start = fx.lane_nodes(spark, sf_dir).filter("node = 0")
    return turns.turn_distances(arcs, _turns(arcs), start).select("node", F.col("weight").alias("millis"))


def ch_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-1 to C-7, C-14, C-15: the travel times of many_to_many by a contraction hierarchy."""
    nodes = fx.lane_nodes(spark, sf_dir)
    _, ch_arcs = contraction.prepared(paths.cut(fx.arcs_of(fx.lane_edges(spark, sf_dir))))
    return contraction.ch_distances(ch_arcs, nodes.filter(F.col("node").isin(0, 7, 13)), nodes).select("source", "node", F.col("weight").alias("millis"))


def route_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13 to J-16, U-0: travel milliseconds from nation 0 to the points snapped on each third lane, at a quarter and three quarters of it."""
    edges = fx.lane_edges(spark, sf_dir).select("edge_id", "a", "b", "distance_mm", "speed", "road_class", "oneway")
    snaps = edges.filter("edge_id % 3 = 0").select("edge_id", F.explode(F.array(F.lit(0.25), F.lit(0.75), F.lit(0.25), F.lit(1.0))).alias("share"))
    graph = paths.cut(overlay.query_graph(snaps, edges))
    found = paths.distances(fx.arcs_of(graph), fx.lane_nodes(spark, sf_dir).filter("node = 0"))
    placed = overlay.virtual_nodes(snaps)
    return placed.join(found, "node").select("edge_id", F.round(F.col("share") * 4).cast("int").alias("quarter"), F.col("weight").alias("millis"))


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11, X-2, X-3, X-5, X-8: a request of each customer, and what is wrong with it."""
    k = F.col("c_custkey")
    lat, lon = 44.8 + (k % 29) * 0.1, 5 + (k % 23) * 0.1
    point = F.struct(F.when(k % 31 != 0, lat.cast("double")).alias("lat"), lon.cast("double").alias("lon"))
    points = F.when(k % 13 == 0, F.array().cast("array<struct<lat:double,lon:double>>")).otherwise(F.array(F.struct(F.lit(46.0).alias("lat"), F.lit(6.0).alias("lon")), point))
    headings = F.when(k % 7 == 0, F.array((k % 400).cast("double"))).when(k % 11 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array().cast("array<double>"))
    hints = F.when(k % 17 == 0, F.create_map(F.lit("weighting"), F.lit("fastest"))).when(k % 19 == 0, F.create_map(F.lit("block_area"), F.lit("1"))).otherwise(F.create_map(F.lit("limit"), (k % 5).cast("string")))
    curbsides = F.when(k % 23 == 0, F.array(F.lit("left"))).otherwise(F.array().cast("array<string>"))
    box = F.struct(F.lit(45.0).alias("min_lat"), F.lit(47.4).alias("max_lat"), F.lit(5.0).alias("min_lon"), F.lit(7.4).alias("max_lon"))
    asked = fx.table(spark, sf_dir, "customer").select(k.cast("long").alias("request"), points.alias("points"), headings.alias("headings"), curbsides.alias("curbsides"), hints.alias("hints"))
    none = F.array().cast("array<string>")
    wrong = requests.problem(F.col("points"), F.col("headings"), none, F.col("curbsides"), F.col("hints"), box)
    limit = requests.hint(F.col("hints"), "limit")
    kept = requests.without_legacy(F.col("hints"))
    return asked.select("request", wrong.alias("problem"), F.coalesce(requests.typed(limit), F.lit("none")).alias("limit_type"), requests.float_or(limit, -1.0).alias("limit_value"), F.size(kept).alias("hints_left"))


def edge_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-2 to F-6: which filters accept each lane; a lane of speed 40 or less has no finite weight, every fifth is a subnetwork."""
    e = fx.lane_edges(spark, sf_dir)
    open_ = F.col("speed") > 40
    forward = F.when(open_, 1.0).otherwise(F.lit(float("inf")))
    backward = F.when(open_ & ~F.col("oneway"), 1.0).otherwise(F.lit(float("inf")))
    kinds = F.get(F.array(*map(F.lit, ("motorway", "trunk", "primary", "track"))), F.col("road_class").cast("int"))
    places = F.get(F.array(*map(F.lit, ("road", "tunnel", "bridge", "ford", "ferry"))), (F.col("edge_id") % 5).cast("int"))
    line = tuple(F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b"))
    heading = filters.heading_allowed(F.col("lat_a"), F.col("lon_a"), F.lit(90.0), line, open_, open_ & ~F.col("oneway"))
    return e.select(
        "edge_id", filters.either_edges(open_, open_ & ~F.col("oneway")).alias("either"), filters.in_edges(open_, open_ & ~F.col("oneway")).alias("inward"), filters.finite_weight(forward, backward).alias("finite"),
        filters.default_snap(F.col("edge_id") % 5 == 0, forward, backward).alias("snap"), filters.snap_allowed([" motorway", "tunnel", "", "ferry"], {"road_class": kinds, "road_environment": places}).alias("allowed"), heading.alias("eastward"),
    )


def weight_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-3, W-4, W-6, W-11, W-12: weights by speed, turn costs, beelines to nation 0's place and balanced bounds, in thousandths."""
    e = fx.lane_edges(spark, sf_dir)
    open_ = F.col("speed") > 40
    metres = F.col("distance_mm") / 1000
    least = filters.least_weight_per_metre(140.0, 1.0, 70.0)
    here = (F.col("lat_a"), F.col("lon_a"))
    to_target = filters.beeline(*here, F.lit(45.0), F.lit(5.0), least)
    to_source = filters.beeline(*here, F.lit(46.0), F.lit(6.0), least, planar=True)
    thousandths = lambda x: F.round(x * 1000).cast("long")
    turn = filters.stored_turn_cost(F.col("a"), F.col("b") % 3, (F.col("edge_id") % 6).cast("double"), 4.0)
    return e.select(
        "edge_id", thousandths(F.nullif(filters.speed_weight(metres, F.col("speed").cast("double"), open_), F.lit(float("inf")))).alias("speed_weight"), filters.speed_millis(metres, F.col("speed").cast("double"), open_).alias("speed_millis"),
        thousandths(turn).alias("turn"), thousandths(to_target).alias("to_target"), thousandths(filters.balanced(to_target, to_source)).alias("balanced"),
    )


def way_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-8, I-16, I-17, P-8, P-17, P-18, P-21: tags of an order's way and of a node on it, derived from the order."""
    k = F.col("o_orderkey")
    pick = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    way = F.map_from_arrays(F.array(*map(F.lit, ("name", "ref", "destination", "duration"))), F.array(F.concat(F.lit("Höhe; "), k.cast("string")), pick(3, ("A 1;B 2", "", "C")), pick(4, ("", "Rome;  Paris ", " x", "")), pick(7, DURATIONS)))
    node = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("barrier", "motorcar", "ford", "highway", "note", "name"))), F.array(pick(5, ("bollard", "", "lift_gate", "gate", "")), pick(3, ("", "yes", "no")), pick(11, ("pond",) + ("",) * 10), pick(6, ("motorway_junction",) + ("",) * 5), F.lit("n"), F.lit("Exit"))), lambda _, v: v != "")
    rows = fx.table(spark, sf_dir, "orders").select(k.cast("long").alias("way"), way.alias("way_tags"), node.alias("node_tags"))
    seconds = tags.duration_seconds(tags.tag(F.col("way_tags"), "duration"))
    names = tags.way_names(F.col("way_tags"), F.col("node_tags"))
    stops = tags.is_barrier(F.col("node_tags"))
    forward, _ = tags.without_barriers(F.lit(True), F.lit(True), stops)
    return rows.select(
        tags.checked_way_id(F.col("way")).alias("way"), names["name"].alias("name"), names["ref"].alias("ref"), names["destination"].alias("destination"), names["junction"].alias("junction"),
        seconds.alias("seconds"), geo.rounded(tags.duration_speed(F.lit(12000.0), seconds), 3).alias("kmh"), stops.alias("stops"), forward.alias("passable"), F.size(F.coalesce(tags.kept_node_tags(F.col("node_tags")), F.create_map().cast("map<string,string>"))).alias("kept_tags"),
    )


def oracles(edges: str, arcs: str, relaxed, planar: str) -> dict[str, str]:
    """SQL over the CTEs that the catalog shares."""
    rounds = ",\n".join(f"e{k + 1} AS (SELECT node, min(w) AS w FROM (SELECT * FROM e{k} UNION ALL SELECT adj, w + cost FROM e{k} JOIN links ON base = node) GROUP BY node)" for k in range(PART_ROUNDS))
    after = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    haversine = lambda lat, lon: f"(CAST(12742000 AS DOUBLE) * asin(sqrt(pow(sin(radians({lat} - lat_a) / 2), 2) + pow(sin(radians({lon} - lon_a) / 2), 2) * cos(radians(lat_a)) * cos(radians({lat})))))"
    least = "(3.6 / CAST(140 AS DOUBLE) / 1.0 + CAST(70 AS DOUBLE) / 1000)"
    turned = ",\n".join(f"t{k + 1} AS (SELECT k, min(w) AS w FROM (SELECT * FROM t{k} UNION ALL SELECT k2, w + cost FROM t{k} JOIN turn ON k1 = k) GROUP BY k)" for k in range(24))
    snapped = ",\n".join(f"s{k + 1} AS (SELECT node, min(w) AS w FROM (SELECT * FROM s{k} UNION ALL SELECT adj, w + millis FROM s{k} JOIN varcs ON base = node) GROUP BY node)" for k in range(32))
    first = 1 << 40
    return {
        "sssp_rounds": f"""WITH steps AS (SELECT CAST(l_partkey AS BIGINT) AS base, CAST({after} AS BIGINT) AS adj, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
links AS (SELECT base, adj, min(q * 100 + (base * 7 + adj) % 97) AS cost FROM steps WHERE adj IS NOT NULL AND adj <> base GROUP BY 1, 2),
e0 AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS w), {rounds} SELECT node, w AS millis FROM e{PART_ROUNDS}""",
        "scc_colours": """WITH RECURSIVE refs AS (SELECT l_orderkey AS way, CAST(l_partkey + 1000000 * (l_orderkey % 40) AS BIGINT) AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'),
looped AS (SELECT way, node, pos FROM refs UNION ALL SELECT way, node, n + 1 FROM refs WHERE pos = 1 AND way % 200 = 0),
links AS (SELECT DISTINCT x.node AS a, y.node AS b FROM looped x JOIN looped y ON x.way = y.way AND y.pos = x.pos + 1),
reach(x, y) AS (SELECT DISTINCT node, node FROM looped UNION SELECT x, b FROM reach JOIN links ON y = a)
SELECT r.x AS node, min(r.y) AS component FROM reach r JOIN reach s ON s.x = r.y AND s.y = r.x GROUP BY r.x""",
        "turn_routes": f"""WITH {arcs}, turn AS (SELECT x.edge_key AS k1, y.edge_key AS k2, y.millis + CASE WHEN (x.edge_key // 2 + y.edge_key // 2) % 4 = 0 THEN ((x.edge_key // 2) * 3 + (y.edge_key // 2) * 5) % 7 * 100000 ELSE 0 END AS cost FROM arcs x JOIN arcs y ON x.adj = y.base
  WHERE x.edge_key // 2 <> y.edge_key // 2 AND NOT ((x.edge_key // 2 + y.edge_key // 2) % 4 = 0 AND (x.edge_key // 2 + 2 * (y.edge_key // 2)) % 11 = 0)),
t0 AS (SELECT edge_key AS k, millis AS w FROM arcs WHERE base = 0), {turned}
SELECT node, CAST(min(w) AS BIGINT) AS millis FROM (SELECT adj AS node, w FROM t24 JOIN arcs ON edge_key = k UNION ALL SELECT CAST(0 AS BIGINT), 0) GROUP BY node""",
        "ch_distances": f"WITH {arcs}, {relaxed('node IN (0, 7, 13)')} SELECT source, node, w AS millis FROM d24",
        "route_snapped": f"""WITH {edges}, parts AS (SELECT edge_id, a, b, speed, oneway, x, y, z FROM (SELECT *, CAST(round(distance_mm * CAST(0.25 AS DOUBLE)) AS BIGINT) AS x, CAST(round(distance_mm * CAST(0.75 AS DOUBLE)) AS BIGINT) AS y, distance_mm AS z FROM edges WHERE edge_id % 3 = 0)),
graph AS (SELECT a, b, distance_mm, speed, oneway FROM edges WHERE edge_id % 3 <> 0 UNION ALL SELECT a, {first} + edge_id * 1024 + 1, x, speed, oneway FROM parts
  UNION ALL SELECT {first} + edge_id * 1024 + 1, {first} + edge_id * 1024 + 2, y - x, speed, oneway FROM parts UNION ALL SELECT {first} + edge_id * 1024 + 2, b, z - y, speed, oneway FROM parts),
varcs AS (SELECT a AS base, b AS adj, CAST(round(distance_mm * CAST(3.6 AS DOUBLE) / speed) AS BIGINT) AS millis FROM graph UNION ALL SELECT b, a, CAST(round(distance_mm * CAST(3.6 AS DOUBLE) / speed) AS BIGINT) FROM graph WHERE NOT oneway),
s0 AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS w), {snapped}
SELECT edge_id, CAST(CASE WHEN node % 1024 = ({first} + edge_id * 1024 + 1) % 1024 THEN 1 ELSE 3 END AS INT) AS quarter, w AS millis FROM s32 JOIN parts ON node IN ({first} + edge_id * 1024 + 1, {first} + edge_id * 1024 + 2)""",
        "request_checks": """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(44.8 + (c_custkey % 29) * 0.1 AS DOUBLE) AS lat, CAST(5 + (c_custkey % 23) * 0.1 AS DOUBLE) AS lon FROM customer),
h AS (SELECT *, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE CAST(k % 5 AS VARCHAR) END AS lim FROM c)
SELECT k AS request, CASE WHEN k % 17 = 0 THEN 'the parameter weighting is no longer allowed, use the profile' WHEN k % 13 = 0 THEN 'a request needs a point'
  WHEN k % 11 = 0 AND k % 7 <> 0 THEN 'headings: none, one, or one for each point' WHEN k % 7 = 0 AND k % 400 >= 360 THEN 'a heading must be in [0, 360) or NaN' WHEN k % 23 = 0 THEN 'curbsides: one for each point'
  WHEN k % 19 = 0 THEN 'block_area is no longer allowed' WHEN k % 31 = 0 THEN 'point 1 is null' WHEN k % 29 < 2 THEN 'point 1 is out of bounds' WHEN k % 29 > 26 THEN 'point 1 is out of bounds' END AS problem,
  CASE WHEN lim IS NULL THEN 'none' ELSE 'int' END AS limit_type, coalesce(CAST(lim AS DOUBLE), -1.0) AS limit_value, CAST(CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END AS INT) AS hints_left FROM h""",
        "edge_filters": f"""WITH {edges}, q AS (SELECT *, speed > 40 AS o, pi() / 2 - atan2(lat_b - lat_a, cos(radians((lat_a + lat_b) / 2)) * (lon_b - lon_a)) AS r FROM edges),
z AS (SELECT *, degrees(floor(CASE WHEN r < 0 THEN r + 2 * pi() ELSE r END * 10000 + 0.5) / 10000) % 360 AS d FROM q)
SELECT edge_id, o AS either, o AND NOT oneway AS inward, o AS finite, edge_id % 5 <> 0 AND o AS snap, road_class <> 0 AND edge_id % 5 NOT IN (1, 4) AS allowed, (abs(d - 90) < 30 AND o) OR (abs((d + 180) % 360 - 90) < 30 AND o AND NOT oneway) AS eastward FROM z""",
        "weight_kinds": f"""WITH {edges}, m AS (SELECT *, distance_mm / CAST(1000 AS DOUBLE) AS metres, {haversine('45.0', '5.0')} * {least} AS t, {planar.format(lat1='lat_a', lon1='lon_a', lat2='46.0', lon2='6.0')} * {least} AS s FROM edges)
SELECT edge_id, CASE WHEN speed > 40 THEN CAST(round(metres / speed * 1000) AS BIGINT) END AS speed_weight, CASE WHEN speed > 40 THEN CAST(floor(1000 * metres / speed) AS BIGINT) END AS speed_millis,
  CAST(round(CASE WHEN a = b % 3 THEN greatest(edge_id % 6, 4) ELSE edge_id % 6 END * 1000) AS BIGINT) AS turn, CAST(round(t * 1000) AS BIGINT) AS to_target, CAST(round((t - s) / 2 * 1000) AS BIGINT) AS balanced FROM m""",
        "way_extras": """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % 5 AS b, o_orderkey % 3 AS r FROM orders),
n AS (SELECT *, CASE k % 7 WHEN 0 THEN 600 WHEN 1 THEN 5400 WHEN 2 THEN 150 WHEN 3 THEN 2700 WHEN 4 THEN 93600 END AS seconds, b IN (0, 2, 3) AS barrier, k % 11 = 0 AS ford, k % 6 = 0 AS junction FROM o),
s AS (SELECT *, CASE WHEN NOT barrier THEN ford WHEN r = 1 THEN FALSE WHEN r = 2 THEN TRUE ELSE b = 0 OR ford END AS stops FROM n)
SELECT k AS way, 'Höhe, ' || k AS name, CASE r WHEN 0 THEN 'A 1, B 2' WHEN 1 THEN NULL ELSE 'C' END AS ref, CASE k % 4 WHEN 1 THEN 'Rome, Paris' WHEN 2 THEN 'x' END AS destination, CASE WHEN junction THEN 'Exit' END AS junction,
  CAST(seconds AS BIGINT) AS seconds, CASE WHEN 12.0 / (seconds / CAST(3600 AS DOUBLE)) >= 0.1 THEN floor(CAST(12 AS DOUBLE) / (seconds / CAST(3600 AS DOUBLE)) * 1000 + 0.5) / 1000 END AS kmh, stops, NOT stops AS passable,
  CAST(CASE WHEN barrier OR ford OR junction THEN CAST(barrier AS INT) + CAST(r <> 0 AS INT) + CAST(ford AS INT) + CAST(junction AS INT) + 1 ELSE 0 END AS INT) AS kept_tags FROM s""",
    }


QUERIES = {f.__name__: f for f in (sssp_rounds, scc_colours, turn_routes, ch_distances, route_snapped, request_checks, edge_filters, weight_kinds, way_extras)}
