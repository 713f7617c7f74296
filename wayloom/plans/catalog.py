"""The registered queries of the road-graph engine, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import costs, geo, tags, values
from wayloom.operators import connectivity, importing, paths, spatial
from wayloom.plans import fixtures as fx
from wayloom.plans import replies, routing

ROUNDS = 24  # one less than there are nations: no shortest way is longer
SOURCES = (0, 7, 13)


def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-1, U-4: lane lengths."""
    return fx.lane_edges(spark, sf_dir).select("edge_id", "distance_mm")


def geo_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-2, U-10, U-17: planar lengths in metres to three places."""
    e = fx.lane_edges(spark, sf_dir)
    c = [F.col(x) for x in ("lat_a", "lon_a", "lat_b", "lon_b")]
    return e.select("edge_id", geo.rounded(geo.planar(*c), 2).alias("planar_m"), geo.crosses_boundary(c[1], c[3]).alias("crosses"))


def geo_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-14: direction of each lane and its compass point."""
    e = fx.lane_edges(spark, sf_dir)
    angle = geo.azimuth(*[F.col(x) for x in ("lat_a", "lon_a", "lat_b", "lon_b")])
    return e.select("edge_id", geo.rounded(angle, 3).alias("azimuth"), geo.compass(angle).alias("point"))


def geo_edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-24: directed keys of edges."""
    k = F.col("edge_id")
    return fx.lane_edges(spark, sf_dir).select("edge_id", geo.edge_key(k).alias("forward"), geo.reversed_key(geo.edge_key(k)).alias("backward"), geo.edge_of_key(geo.edge_key(k, True)).alias("edge"))


def graph_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-24, A-2, R-5."""
    return fx.lane_nodes(spark, sf_dir).agg(*[b for b in geo.bounds(F.col("lat"), F.col("lon"))])


def _tags(spark, sf_dir):
    return fx.order_tags(spark, sf_dir)


def tag_road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1 to P-4, X-10."""
    t = F.col("tags")
    return _tags(spark, sf_dir).select("way", tags.road_class(t).alias("road_class"), tags.road_class_link(t).alias("is_link"), tags.roundabout(t).alias("roundabout"), tags.road_environment(t).alias("environment"))


def tag_maxspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5, P-6."""
    return _tags(spark, sf_dir).select("way", geo.rounded(tags.max_speed(F.col("tags")), 3).alias("max_speed"))


def tag_road_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-7, P-23."""
    return _tags(spark, sf_dir).select("way", tags.road_access(F.col("tags")).alias("road_access"))


def tag_car_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11 to P-16."""
    forward, backward = tags.car_directions(F.col("tags"))
    return _tags(spark, sf_dir).select("way", forward.alias("forward"), backward.alias("backward"))


def tag_car_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-19, P-20."""
    return _tags(spark, sf_dir).select("way", tags.car_speed(F.col("tags")).alias("speed"))


def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-17, I-18."""
    return _tags(spark, sf_dir).select("way", tags.street_name(F.col("tags")).alias("name"))


def ev_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV catalogue: values as they read back."""
    size = F.col("p_size").cast("double")
    of = values.CATALOGUE
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part"), of["car_average_speed"].stored(size * 7).alias("speed"), of["max_speed"].stored(size * 3).alias("max_speed"), of["orientation"].stored(size * 8).alias("orientation"))


def way_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-1 to I-3."""
    ways = fx.order_ways(spark, sf_dir)
    return ways.filter(tags.accepted_way(F.col("tags"), F.size("refs"), ["footway"])).select("way", F.size("refs").alias("n_refs"))


def node_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-4, I-5, A-1."""
    return importing.node_types(importing.way_refs(fx.order_ways(spark, sf_dir)))


def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-6, I-7, I-10 to I-12, I-14; the nodes are given as text."""
    found = importing.segments(fx.order_ways(spark, sf_dir), fx.part_nodes(spark, sf_dir))
    return found.select("way", "segment", "part", F.concat_ws(",", F.transform("points", lambda p: p["node"].cast("string"))).alias("nodes"))


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-20, I-21: edges with their lengths; loops are left out."""
    ways = fx.order_ways(spark, sf_dir)
    found = importing.edges_of(importing.segments(ways, fx.part_nodes(spark, sf_dir)), ways)
    return found.filter("from_node <> to_node").select("way", "from_node", "to_node", "distance_mm", "n_points")


def barrier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-9: where barriers split their first way."""
    return importing.barrier_edges(fx.order_ways(spark, sf_dir), fx.part_nodes(spark, sf_dir))


KINDS = {"car_access": "bool", "car_subnetwork": "bool", "car_average_speed": "decimal", "road_class": ["c0", "c1", "c2", "c3"], "distance": "decimal"}


def _priced(spark, sf_dir, model):
    e = fx.lane_edges(spark, sf_dir)
    columns = {"car_access": F.col("speed") > 40, "car_subnetwork": F.lit(False), "car_average_speed": F.col("speed").cast("double"), "road_class": F.concat(F.lit("c"), F.col("road_class").cast("string")), "distance": F.col("distance_mm") / 1000}
    speed = costs.applied(model.speed, costs.TOP_SPEED, columns, KINDS)
    priority = costs.applied(model.priority, costs.TOP_PRIORITY, columns, KINDS)
    return e.select("edge_id", speed.alias("speed"), priority.alias("priority"), F.col("distance_mm"))


def model_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-1 to E-9, W-1, W-2: the standard model."""
    priced = _priced(spark, sf_dir, costs.standard_model())
    w = costs.weight(F.col("distance_mm") / 1000, F.col("speed"), F.col("priority"), 90)
    return priced.select("edge_id", F.when(w == float("inf"), F.lit(None)).otherwise(F.round(w * 1000)).cast("long").alias("weight_millis"), costs.millis(F.col("distance_mm") / 1000, F.col("speed")).alias("millis"))


BRANCHES = {"speed": [{"if": "true", "limit_to": "car_average_speed"}, {"if": "road_class == c1", "multiply_by": "0.5"}, {"else_if": "road_class == c2 || distance > 90000", "limit_to": "50"}, {"else": "", "add": "3"}], "priority": [{"if": "!(car_access && distance < 120000)", "multiply_by": "0.5"}]}


def model_elseif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-3 to E-7: first match in each group."""
    return _priced(spark, sf_dir, costs.Model.parse(BRANCHES)).select("edge_id", F.col("speed").cast("double"), F.col("priority").cast("double"))


def edge_filter_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes that a point may be put on, by speed and class."""
    return fx.lane_edges(spark, sf_dir).filter((F.col("speed") > 30) & ~F.col("road_class").isin(1, 2)).select("edge_id")


def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3, J-4, A-6."""
    return spatial.edge_tiles(fx.lane_edges(spark, sf_dir))


def nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-6 to J-10, J-12, A-4, O-3."""
    return spatial.nearest_edges(fx.query_points(spark, sf_dir), fx.lane_edges(spark, sf_dir)).select("point", "edge_id", "distance_mm")


def bbox_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11, F-10, U-16."""
    return spatial.edges_in_box(fx.lane_edges(spark, sf_dir), 45.5, 46.2, 5.3, 6.1).select("edge_id")


def overlay_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13 to J-15: virtual edges between snapped points."""
    e = fx.lane_edges(spark, sf_dir)
    snaps = e.select("edge_id", F.explode(F.array(F.lit(0.25), F.lit(0.75), F.lit(0.25), F.lit(0.0))).alias("share")).filter("edge_id % 3 = 0")
    return spatial.split_edges(snaps, e).select("edge_id", "part", "length_mm")


def sssp_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1, T-3, T-4, T-15: travel milliseconds from nation 0."""
    nodes = fx.lane_nodes(spark, sf_dir)
    return paths.distances(fx.arcs_of(fx.lane_edges(spark, sf_dir)), nodes.filter("node = 0")).select("node", F.col("weight").alias("millis"))


def many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4 for several sources at once."""
    nodes = fx.lane_nodes(spark, sf_dir)
    return paths.distances(fx.arcs_of(fx.lane_edges(spark, sf_dir)), nodes.filter(F.col("node").isin(*SOURCES))).select("source", "node", F.col("weight").alias("millis"))


def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-16 to T-18, A-3: the travel time summed over each path's edges; it equals the searched one."""
    arcs = paths.cut(fx.arcs_of(fx.lane_edges(spark, sf_dir)))
    nodes = fx.lane_nodes(spark, sf_dir)
    state = paths.distances(arcs, nodes.filter("node = 0"))
    walked = paths.path_edges(state, arcs, state.select("source", "node"))
    steps = walked.select("source", "target", F.explode_outer("edges").alias("edge_key")).join(arcs.select("edge_key", "millis"), "edge_key", "left")
    return steps.groupBy("source", F.col("target").alias("node")).agg(F.coalesce(F.sum("millis"), F.lit(0)).alias("millis"))


def _requests(spark):
    return spark.createDataFrame([(k, [0, 7, 13] if k % 2 else [k, 24 - k]) for k in range(12)], "request long, points array<long>")


def _routed(spark, sf_dir, arcs, algorithm, **more):
    fastest = arcs.agg(F.max(F.col("distance_mm") / F.greatest(F.col("millis"), F.lit(1)))).first()[0] or 0.0
    return paths.routes(_requests(spark), arcs, fx.lane_nodes(spark, sf_dir), algorithm, fastest=fastest, **more)


def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-6, T-7, T-11 to T-13: the four algorithms give one answer for each leg."""
    all_, arcs = None, paths.cut(fx.arcs_of(fx.lane_edges(spark, sf_dir)))
    for name in paths.ALGORITHMS:
        one = _routed(spark, sf_dir, arcs, name).select("request", "leg", "weight")
        all_ = one if all_ is None else all_.union(one)
    return all_.groupBy("request", "leg").agg(F.min("weight").cast("long").alias("millis"), F.max("weight").cast("long").alias("millis_of_all"))


def avoid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-9: edges of class 3 cost five times as much."""
    arcs = fx.arcs_of(fx.lane_edges(spark, sf_dir))
    dear = arcs.withColumn("millis", costs.avoided(F.col("millis"), F.col("road_class") == 3).cast("long"))
    return paths.distances(dear, fx.lane_nodes(spark, sf_dir).filter("node = 0")).select("node", F.col("weight").alias("millis"))


def edge_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-19: strongly connected components of the lanes' nodes when they may be driven upward only, but for every third."""
    e = fx.lane_edges(spark, sf_dir)
    up = e.select("a", "b")
    down = e.filter("edge_id % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return connectivity.strong_components(up.union(down), fx.lane_nodes(spark, sf_dir))


def subnetwork_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-20, A-5."""
    return connectivity.subnetworks(fx.arcs_of(fx.lane_edges(spark, sf_dir)), 4)


def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-22, I-25, U-15, O-1."""
    return importing.hilbert_order(fx.lane_nodes(spark, sf_dir)).select("node", "hilbert", "new_id")


NODES = "SELECT CAST(n_nationkey AS BIGINT) AS node, 45 + 0.1 * ((n_nationkey * 7) % 25) AS lat, 5 + 0.1 * ((n_nationkey * 11) % 25) AS lon FROM nation"
EDGES = f"""nodes AS (SELECT node, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({NODES})),
lanes AS (SELECT DISTINCT CAST(least(s_nationkey, c_nationkey) AS BIGINT) AS a, CAST(greatest(s_nationkey, c_nationkey) AS BIGINT) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey),
placed AS (SELECT a, b, p.lat AS lat_a, p.lon AS lon_a, q.lat AS lat_b, q.lon AS lon_b FROM lanes JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b),
edges AS (SELECT a * 25 + b AS edge_id, a, b, CAST(least(greatest(round(CAST(12742000000 AS DOUBLE) * asin(sqrt(pow(sin(radians(lat_b - lat_a) / 2), 2) + pow(sin(radians(lon_b - lon_a) / 2), 2) * cos(radians(lat_a)) * cos(radians(lat_b))))), 1), 2147483646) AS BIGINT) AS distance_mm,
  20 + abs(a * 7 - b * 11) % 97 AS speed, (a + b) % 4 AS road_class, (a * b) % 9 = 0 AS oneway, lat_a, lon_a, lat_b, lon_b FROM placed)"""
ARCS = EDGES + """,
arcs AS (SELECT edge_id * 2 AS edge_key, a AS base, b AS adj, road_class, CAST(round(distance_mm * CAST(3.6 AS DOUBLE) / speed) AS BIGINT) AS millis FROM edges
  UNION ALL SELECT edge_id * 2 + 1, b, a, road_class, CAST(round(distance_mm * CAST(3.6 AS DOUBLE) / speed) AS BIGINT) FROM edges WHERE NOT oneway)"""


def relaxed(start: str, cost: str = "millis", rounds: int = ROUNDS) -> str:
    """CTEs d0 to d<rounds> of (source, node, w)."""
    out = [f"d0 AS (SELECT node AS source, node, CAST(0 AS BIGINT) AS w FROM nodes WHERE {start})"]
    for k in range(rounds):
        out.append(f"d{k + 1} AS (SELECT source, node, min(w) AS w FROM (SELECT * FROM d{k} UNION ALL SELECT source, adj, w + {cost} FROM d{k} JOIN arcs ON base = node) GROUP BY source, node)")
    return ",\n".join(out)


def case(value: str, table: dict, default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def listed(n: int, words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][CAST(1 + o_orderkey % {n} AS INT)]"


TAGS = f"""t AS (SELECT CAST(o_orderkey AS BIGINT) AS way, {case('o_orderpriority', {k: f"'{v}'" for k, v in fx.HIGHWAY_OF.items()}, "''")} AS highway,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '-1' END AS oneway, {listed(7, fx.SPEED_TAGS)} AS maxspeed, {listed(5, fx.ACCESS_TAGS)} AS motor_vehicle,
  {listed(4, fx.SURFACES)} AS surface, {listed(3, fx.TRACKS)} AS tracktype, {listed(11, fx.JUNCTIONS)} AS junction, {listed(6, fx.BRIDGES)} AS bridge FROM orders),
limits AS (SELECT *, CASE maxspeed WHEN '50' THEN 50.0 WHEN '30 mph' THEN CAST(30 AS DOUBLE) * 1.609344 WHEN 'walk' THEN 6.0 WHEN '10 knots' THEN CAST(10 AS DOUBLE) * 1.852
  WHEN 'none' THEN CASE WHEN highway IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary') THEN 150.0 END END AS kmh FROM t)"""
WAYS = """refs AS (SELECT CAST(l_orderkey AS BIGINT) AS way, CAST(l_partkey + 1000000 * (l_orderkey % 40) AS BIGINT) AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
looped AS (SELECT way, node, pos, n + CASE WHEN way % 200 = 0 THEN 1 ELSE 0 END AS n FROM refs WHERE way IN (SELECT o_orderkey FROM orders) UNION ALL SELECT way, node, n, n + 1 FROM refs WHERE pos = 0 AND way % 200 = 0 AND way IN (SELECT o_orderkey FROM orders)),
seen AS (SELECT node, count(*) AS k, sum(CASE WHEN pos = 0 OR pos = n - 1 THEN 1 ELSE 0 END) AS ends FROM looped GROUP BY node),
types AS (SELECT node, CASE WHEN k = 1 AND ends = 1 THEN 'END' WHEN k = 1 THEN 'INTERMEDIATE' WHEN k = 2 AND ends = 2 THEN 'CONNECTION' ELSE 'JUNCTION' END AS node_type FROM seen)"""
PLANAR = "CAST(6371000 AS DOUBLE) * sqrt(pow(radians({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)), 2) + pow(radians({lat2} - {lat1}), 2))"
_line = dict(lat1="lat_a", lon1="lon_a", lat2="lat_b", lon2="lon_b")
TILES = """tile_rows AS (SELECT *, least(lon_a, lon_b) AS west, greatest(lon_a, lon_b) AS east, unnest(generate_series(CAST(floor((least(lat_a, lat_b) - 1e-9) / 0.1) AS BIGINT), CAST(floor((greatest(lat_a, lat_b) + 1e-9) / 0.1) AS BIGINT))) AS tile_y FROM edges WHERE abs(lon_a - lon_b) <= 300),
tile_ends AS (SELECT *, lon_a + (least(greatest(least(lat_a, lat_b), tile_y * CAST(0.1 AS DOUBLE)), greatest(lat_a, lat_b)) - lat_a) / nullif(lat_b - lat_a, 0) * (lon_b - lon_a) AS x0, lon_a + (greatest(least(greatest(lat_a, lat_b), (tile_y + 1) * CAST(0.1 AS DOUBLE)), least(lat_a, lat_b)) - lat_a) / nullif(lat_b - lat_a, 0) * (lon_b - lon_a) AS x1 FROM tile_rows),
tile_spans AS (SELECT edge_id, tile_y, greatest(coalesce(least(x0, x1), west), west) AS s, least(coalesce(greatest(x0, x1), east), east) AS e FROM tile_ends),
tiles AS (SELECT edge_id, tile_y, unnest(generate_series(CAST(floor((least(s, e) - 1e-9) / 0.1) AS BIGINT), CAST(floor((greatest(s, e) + 1e-9) / 0.1) AS BIGINT))) AS tile_x FROM tile_spans)"""
SEGMENTS = """known AS (SELECT l.way, l.node, l.pos, node_type IN ('JUNCTION', 'CONNECTION') AS tower, 45 + ((l.node % 1000000) % 97) * CAST(0.01 AS DOUBLE) AS lat, 5 + ((l.node % 1000000) % 89) * CAST(0.01 AS DOUBLE) AS lon
  FROM looped l JOIN types USING (node) WHERE l.node % 50 <> 0 AND l.node % 1000000 IN (SELECT p_partkey FROM part)),
listed AS (SELECT *, row_number() OVER w AS i, coalesce(pos - lag(pos) OVER w > 1, FALSE) AS gap FROM known WINDOW w AS (PARTITION BY way ORDER BY pos)),
-- A node starts a segment if it is a tower, the first, or behind a gap that broke the segment; a gap doesn't break one that just started.
reset AS (SELECT *, max(CASE WHEN tower OR i = 1 OR NOT gap THEN i END) OVER w AS r, max(CASE WHEN tower OR i = 1 THEN i END) OVER w AS rt FROM listed WINDOW w AS (PARTITION BY way ORDER BY i)),
started AS (SELECT *, CASE WHEN r = rt THEN (i - r) % 2 = 0 ELSE (i - r) % 2 = 1 END AS starts FROM reset),
pairs AS (SELECT way, i, node, lat, lon, tower, lag(node) OVER w AS prev, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, coalesce(lag(starts) OVER w, FALSE) AS first, gap AND NOT coalesce(lag(starts) OVER w, TRUE) AS broken FROM started WINDOW w AS (PARTITION BY way ORDER BY i)),
steps AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY way ORDER BY i) - 1 AS segment, CAST(12742000 AS DOUBLE) * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + pow(sin(radians(lon - lon0) / 2), 2) * cos(radians(lat0)) * cos(radians(lat)))) AS metres
  FROM pairs WHERE prev IS NOT NULL AND NOT broken),
whole AS (SELECT way, dense_rank() OVER (PARTITION BY way ORDER BY segment) - 1 AS segment, list_prepend(first(prev ORDER BY i), list(node ORDER BY i)) AS nodes, list(metres ORDER BY i) AS metres FROM steps GROUP BY way, segment),
parts AS (SELECT way, segment, 0 AS part, CASE WHEN nodes[1] = nodes[-1] THEN nodes[:-2] ELSE nodes END AS nodes, CASE WHEN nodes[1] = nodes[-1] THEN metres[:-2] ELSE metres END AS metres FROM whole WHERE len(nodes) > 2 OR nodes[1] <> nodes[-1]
  UNION ALL SELECT way, segment, 1, nodes[-2:], metres[-1:] FROM whole WHERE len(nodes) > 2 AND nodes[1] = nodes[-1]),
split AS (SELECT way, CAST(segment AS INT) AS segment, CAST(part AS INT) AS part, nodes, list_reduce(list_prepend(CAST(0 AS DOUBLE), metres), lambda x, y: x + y) AS metres FROM parts)"""
HILBERT = f"""RECURSIVE curve AS (SELECT node, 30 AS k, CAST(0 AS BIGINT) AS d, CAST(floor((lon + 180) / 360 * 2147483648) AS BIGINT) AS x, CAST(floor((90 - lat) / 180 * 2147483648) AS BIGINT) AS y FROM (SELECT node, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({NODES}))
  UNION ALL SELECT node, k - 1, d + s * s * xor(3 * rx, ry), (CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN s - 1 - y ELSE y END) & (2 * s - 1), (CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN s - 1 - x ELSE x END) & (2 * s - 1)
  FROM (SELECT *, CAST(1 AS BIGINT) << k AS s, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry FROM curve WHERE k >= 0)),
placed_nodes AS (SELECT node, d AS hilbert, row_number() OVER (ORDER BY d, node) - 1 AS new_id FROM curve WHERE k = -1)"""

ORACLES = {
    "way_segments": f"WITH {WAYS}, {SEGMENTS} SELECT way, segment, part, array_to_string(nodes, ',') AS nodes FROM split",
    "edge_list": f"WITH {WAYS}, {SEGMENTS} SELECT way, nodes[1] AS from_node, nodes[-1] AS to_node, CAST(least(greatest(round(metres * 1000), 1), 2147483646) AS BIGINT) AS distance_mm, CAST(len(nodes) AS INT) AS n_points FROM split WHERE nodes[1] <> nodes[-1]",
    "hilbert_order": f"WITH {HILBERT} SELECT node, hilbert, new_id FROM placed_nodes",
    "subnetwork_flags": f"""WITH RECURSIVE {ARCS}, reach(x, y) AS (SELECT edge_key, edge_key FROM arcs UNION SELECT x, edge_key FROM reach JOIN (SELECT p.edge_key AS came, q.edge_key FROM arcs p JOIN arcs q ON q.base = p.adj) ON y = came),
found AS (SELECT r.x AS edge_key, min(r.y) AS component FROM reach r JOIN reach s ON s.x = r.y AND s.y = r.x GROUP BY r.x),
sizes AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS r FROM found GROUP BY component)
SELECT edge_key, f.component, size, size < 8 AND r > 1 OR size = 1 AS subnetwork FROM found f JOIN sizes s ON s.component = f.component""",
    "geo_haversine": f"WITH {EDGES} SELECT edge_id, distance_mm FROM edges",
    "geo_planar": f"WITH {EDGES} SELECT edge_id, floor({PLANAR.format(**_line)} * 100 + 0.5) / 100 AS planar_m, abs(lon_a - lon_b) > 300 AS crosses FROM edges",
    "geo_azimuth": f"""WITH {EDGES}, turn AS (SELECT edge_id, pi() / 2 - atan2(lat_b - lat_a, cos(radians((lat_a + lat_b) / 2)) * (lon_b - lon_a)) AS r FROM edges),
angle AS (SELECT edge_id, degrees(floor(CASE WHEN r < 0 THEN r + 2 * pi() ELSE r END * 10000 + 0.5) / 10000) % 360 AS d FROM turn)
SELECT edge_id, floor(d * 1000 + 0.5) / 1000 AS azimuth, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW', 'N'][CAST(least(floor((d + 22.5) / 45), 8) AS INT) + 1] AS point FROM angle""",
    "geo_edge_keys": f"WITH {EDGES} SELECT edge_id, edge_id * 2 AS forward, edge_id * 2 + 1 AS backward, edge_id AS edge FROM edges",
    "graph_bounds": f"SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM (SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({NODES}))",
    "tag_road_class": f"WITH {TAGS} SELECT way, CASE WHEN highway = 'primary_link' THEN 'primary' ELSE highway END AS road_class, highway LIKE '%\\_link' ESCAPE '\\' AS is_link, junction = 'roundabout' AS roundabout, CASE WHEN bridge = 'yes' THEN 'bridge' ELSE 'road' END AS environment FROM t",
    "tag_maxspeed": f"WITH {TAGS} SELECT way, floor(kmh * 1000 + 0.5) / 1000 AS max_speed FROM limits",
    "tag_road_access": f"WITH {TAGS} SELECT way, CASE motor_vehicle WHEN 'no' THEN 'no' WHEN 'private;destination' THEN 'destination' WHEN 'delivery' THEN 'delivery' ELSE 'yes' END AS road_access FROM t",
    "tag_car_access": f"""WITH {TAGS}, open AS (SELECT *, highway IN ('motorway', 'primary_link', 'residential', 'track') AND NOT (highway = 'track' AND tracktype = 'grade5') AND motor_vehicle NOT IN ('no', 'delivery') AS ok FROM t)
SELECT way, ok AND oneway <> '-1' OR ok AND junction = 'roundabout' AND oneway <> '-1' AS forward, ok AND (oneway = 'no' AND junction <> 'roundabout' OR oneway = '-1' AND junction <> 'roundabout') AS backward FROM open""",
    "tag_car_speed": f"""WITH {TAGS}, base AS (SELECT way, kmh, surface, CAST(CASE WHEN highway = 'track' AND tracktype = 'grade1' THEN 20 ELSE {case('highway', {'motorway': 100, 'primary_link': 60, 'residential': 30, 'track': 15}, '10')} END AS DOUBLE) AS v FROM limits)
SELECT way, greatest(round(CASE WHEN kmh IS NOT NULL THEN least(kmh * CAST(0.9 AS DOUBLE), 254.0) WHEN surface IN ('gravel', 'dirt') THEN least(v, 30.0) ELSE v END / 2) * 2, 2.0) AS speed FROM base""",
    "tag_names": "SELECT CAST(o_orderkey AS BIGINT) AS way, 'Way ' || o_orderkey || ', A' AS name FROM orders",
    "ev_quantise": "SELECT CAST(p_partkey AS BIGINT) AS part, CASE WHEN round(p_size * 7.0 / 2) * 2 <= 254 THEN round(p_size * 7 / CAST(2 AS DOUBLE)) * 2 END AS speed, CASE WHEN round(p_size * 3 / CAST(2 AS DOUBLE)) * 2 <= 252 THEN round(p_size * 3 / CAST(2 AS DOUBLE)) * 2 END AS max_speed, CASE WHEN round(p_size * 8 / CAST(12 AS DOUBLE)) * 12 <= 372 THEN round(p_size * 8 / CAST(12 AS DOUBLE)) * 12 END AS orientation FROM part",
    "way_filter": f"WITH {WAYS}, {TAGS} SELECT l.way, CAST(count(*) AS INT) AS n_refs FROM looped l JOIN t ON t.way = l.way WHERE highway <> 'footway' GROUP BY l.way HAVING count(*) >= 2",
    "node_classify": f"WITH {WAYS} SELECT node, node_type FROM types",
    "barrier_edges": f"WITH {WAYS}, one AS (SELECT l.node, l.way, l.pos, row_number() OVER (PARTITION BY l.node ORDER BY l.way, l.pos) AS r FROM looped l JOIN types ty ON ty.node = l.node JOIN part ON p_partkey = l.node % 1000000 WHERE node_type <> 'JUNCTION' AND p_size % 25 = 0 AND l.node % 50 <> 0) SELECT node, way, CAST(pos AS INT) AS pos FROM one WHERE r = 1",
    "model_weight": f"WITH {EDGES}, s AS (SELECT edge_id, distance_mm / CAST(1000 AS DOUBLE) AS m, least(999.0, CAST(speed AS DOUBLE)) AS v, speed > 40 AS open FROM edges) SELECT edge_id, CASE WHEN open THEN CAST(round((m / v * CAST(3.6 AS DOUBLE) + m * CAST(0.09 AS DOUBLE)) * 1000) AS BIGINT) END AS weight_millis, CAST(round(m / v * 3600) AS BIGINT) AS millis FROM s",
    "model_elseif": f"WITH {EDGES} SELECT edge_id, CAST(CASE WHEN road_class = 1 THEN speed * 0.5 WHEN road_class = 2 OR distance_mm > 90000000 THEN least(speed, 50) ELSE speed + 3 END AS DOUBLE) AS speed, CAST(CASE WHEN NOT (speed > 40 AND distance_mm < 120000000) THEN 0.5 ELSE 1 END AS DOUBLE) AS priority FROM edges",
    "edge_filter_snap": f"WITH {EDGES} SELECT edge_id FROM edges WHERE speed > 30 AND road_class NOT IN (1, 2)",
    "tile_assign": f"WITH {EDGES}, {TILES} SELECT tile_x, tile_y, edge_id FROM tiles",
    "nearest_edge": f"""WITH {EDGES}, {TILES}, points AS (SELECT CAST(c_custkey AS BIGINT) AS point, CAST(45 + (c_custkey % 241) * 0.01 AS DOUBLE) AS lat, CAST(5 + (c_custkey % 239) * 0.01 AS DOUBLE) AS lon FROM customer),
met AS (SELECT DISTINCT point, lat, lon, edge_id FROM points JOIN tiles ON abs(tile_x - CAST(floor(lon / 0.1) AS BIGINT)) <= 3 AND abs(tile_y - CAST(floor(lat / 0.1) AS BIGINT)) <= 3),
foot AS (SELECT point, lat, lon, e.*, cos(radians((lat_a + lat_b) / 2)) AS k FROM met JOIN edges e ON e.edge_id = met.edge_id),
share AS (SELECT *, least(greatest(coalesce(((lon - lon_a) * k * ((lon_b - lon_a) * k) + (lat - lat_a) * (lat_b - lat_a)) / nullif(pow((lon_b - lon_a) * k, 2) + pow(lat_b - lat_a, 2), 0), 0), 0), 1) AS s FROM foot),
scored AS (SELECT point, edge_id, CAST(round(1000 * {PLANAR.format(lat1='lat', lon1='lon', lat2='(lat_a + s * (lat_b - lat_a))', lon2='(lon_a + s * (lon_b - lon_a))')}) AS BIGINT) AS distance_mm FROM share),
best AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY distance_mm, edge_id) AS r FROM scored) SELECT point, edge_id, distance_mm FROM best WHERE r = 1""",
    "bbox_edges": f"WITH {EDGES} SELECT edge_id FROM edges WHERE least(lon_a, lon_b) <= 6.1 AND greatest(lon_a, lon_b) >= 5.3 AND least(lat_a, lat_b) <= 46.2 AND greatest(lat_a, lat_b) >= 45.5",
    "overlay_split": f"WITH {EDGES}, half AS (SELECT edge_id, CAST(round(distance_mm * CAST(0.25 AS DOUBLE)) AS BIGINT) AS x, CAST(round(distance_mm * CAST(0.75 AS DOUBLE)) AS BIGINT) AS y, distance_mm AS z FROM edges WHERE edge_id % 3 = 0) SELECT edge_id, CAST(0 AS INT) AS part, x AS length_mm FROM half UNION ALL SELECT edge_id, 1, y - x FROM half UNION ALL SELECT edge_id, 2, z - y FROM half",
    "sssp_nation": f"WITH {ARCS}, {relaxed('node = 0')} SELECT node, w AS millis FROM d{ROUNDS}",
    "many_to_many": f"WITH {ARCS}, {relaxed('node IN (0, 7, 13)')} SELECT source, node, w AS millis FROM d{ROUNDS}",
    "path_lengths": f"WITH {ARCS}, {relaxed('node = 0')} SELECT source, node, w AS millis FROM d{ROUNDS}",
    "route_legs": f"""WITH {ARCS}, {relaxed('TRUE')}, asked AS (SELECT k AS request, 0 AS leg, CASE WHEN k % 2 = 1 THEN 0 ELSE k END AS x, CASE WHEN k % 2 = 1 THEN 7 ELSE 24 - k END AS y FROM range(12) r(k) UNION ALL SELECT k, 1, 7, 13 FROM range(12) r(k) WHERE k % 2 = 1)
SELECT CAST(request AS BIGINT) AS request, CAST(leg AS INT) AS leg, w AS millis, w AS millis_of_all FROM asked LEFT JOIN d{ROUNDS} ON source = x AND node = y""",
    "avoid_edges": f"WITH {ARCS}, {relaxed('node = 0', 'CASE WHEN road_class = 3 THEN millis * 5 ELSE millis END')} SELECT node, w AS millis FROM d{ROUNDS}",
    "edge_scc": f"""WITH RECURSIVE {EDGES}, links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges WHERE edge_id % 3 = 0),
reach(x, y) AS (SELECT node, node FROM nodes UNION SELECT x, b FROM reach JOIN links ON y = a)
SELECT r.x AS node, min(r.y) AS component FROM reach r JOIN reach s ON s.x = r.y AND s.y = r.x GROUP BY r.x""",
}

QUERIES = {f.__name__: f for f in (geo_haversine, geo_planar, geo_azimuth, geo_edge_keys, graph_bounds, tag_road_class, tag_maxspeed, tag_road_access, tag_car_access, tag_car_speed, tag_names, ev_quantise, way_filter, node_classify, way_segments, edge_list, barrier_edges, model_weight, model_elseif, edge_filter_snap, tile_assign, nearest_edge, bbox_edges, overlay_split, sssp_nation, many_to_many, path_lengths, route_legs, avoid_edges, edge_scc, subnetwork_flags, hilbert_order)} | routing.QUERIES | replies.QUERIES
ORACLES |= routing.oracles(EDGES, ARCS, relaxed, PLANAR)
ORACLES |= replies.oracles(EDGES, WAYS, SEGMENTS, HILBERT, NODES)
