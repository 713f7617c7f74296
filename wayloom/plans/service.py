"""From settings to a stored graph, and from a stored graph to the answer of a request."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions import geo, lines, tags
from wayloom.operators import answers, importing, overlay, paths, spatial
from wayloom.sources import graph_store, osm_pbf, osm_xml
from wayloom.sources.settings import Settings


def graph_tables(ways: DataFrame, nodes: DataFrame, ignored: list[str] = ()) -> dict[str, DataFrame]:
    """{nodes, edges} for cars, from read ways (way, refs, tags) and nodes (node, lat, lon, tags)."""
    roads = ways.filter(tags.accepted_way(F.col("tags"), F.size("refs"), ignored))
    stops = nodes.filter(tags.is_barrier(F.col("tags"))).select("node", F.lit(True).alias("barrier"))
    cut = importing.split_at_barriers(importing.segments(roads, nodes), importing.barrier_edges(roads, stops))
    whole = importing.edges_of(cut, roads).filter("from_node <> to_node")
    forward, backward = tags.without_barriers(*tags.car_directions(F.col("tags")), F.col("barrier"))
    priced = whole.select("way", "segment", "part", "piece", F.col("from_node").alias("a"), F.col("to_node").alias("b"), "distance_mm", "geometry", forward.alias("forward"), backward.alias("backward"), tags.car_speed(F.col("tags")).alias("speed"), tags.street_name(F.col("tags")).alias("name"))
    edges = importing.dense_ids(priced.filter("forward OR backward"), "edge_id", "way", "segment", "part", "piece").drop("segment", "part", "piece")
    ends = edges.select(F.col("a").alias("node"), F.element_at("geometry", 1).alias("p")).union(edges.select("b", F.element_at("geometry", -1)))
    return {"nodes": ends.groupBy("node").agg(F.first("p").alias("p")).select("node", "p.lat", "p.lon"), "edges": edges}


def import_graph(spark: SparkSession, settings: Settings) -> str:
    """Reads the file of datareader.file and stores its graph in graph.location, which is returned. A graph without edges is refused."""
    path, place = settings.text("datareader.file"), settings.text("graph.location")
    reader = osm_pbf if path.endswith(".pbf") else osm_xml
    tables = graph_tables(reader.read_elements(spark, path, "way"), reader.read_elements(spark, path, "node"), settings.words("import.osm.ignored_highways"))
    importing.not_empty(tables["edges"])
    graph_store.store(tables, place)
    return place


def arcs_of(edges: DataFrame) -> DataFrame:
    """(edge_key, base, adj, distance_mm, millis) in the directions that are open."""
    millis = F.round(F.col("distance_mm") * 3.6 / F.col("speed")).cast("long")
    one = lambda way, reverse, a, b: edges.filter(way).select(geo.edge_key(F.col("edge_id"), reverse).alias("edge_key"), F.col(a).alias("base"), F.col(b).alias("adj"), "distance_mm", millis.alias("millis"))
    return one("forward", False, "a", "b").union(one("backward", True, "b", "a"))


def snapped(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(point, edge_id, share, lat, lon): the place on the nearest edge's line, as a share of its length; points far from all edges have no row."""
    p, q = F.col("x.p"), F.col("x.q")
    pairs = F.zip_with(F.slice("geometry", 1, F.size("geometry") - 1), F.slice("geometry", 2, F.size("geometry")), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    steps = edges.select("edge_id", F.posexplode(pairs).alias("i", "x")).select("edge_id", "i", p["lat"].alias("lat_a"), p["lon"].alias("lon_a"), q["lat"].alias("lat_b"), q["lon"].alias("lon_b"))
    length = geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    w = Window.partitionBy("edge_id").orderBy("i")
    steps = steps.withColumn("metres", length).withColumn("before", F.sum("metres").over(w) - F.col("metres")).withColumn("whole", F.sum("metres").over(Window.partitionBy("edge_id")))
    named = steps.withColumn("edge_id", F.struct("edge_id", "i"))
    near = spatial.nearest_edges(points, named).join(named, "edge_id")
    done = F.col("before") + geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon"))
    return near.select("point", "edge_id.edge_id", F.coalesce(F.least(done / F.nullif("whole", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("share"), "lat", "lon")


def route(spark: SparkSession, settings: Settings, points: list[tuple[float, float]], profile: str, algorithm: str = "astarbi", encoded: bool = True) -> dict:
    """The answer to one request, with points as (lat, lon): hints and paths, or an error. The path of one request is put together on the driver."""
    settings.profile(profile)
    if len(points) < 2:
        raise ValueError("a route needs two points")
    tables, _ = graph_store.load(spark, settings.text("graph.location"))
    nodes, edges = tables["nodes"], tables["edges"]
    asked = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(points)], "point long, lat double, lon double")
    snaps = {r["point"]: r for r in snapped(asked, edges).collect()}
    for k in range(len(points)):
        if k not in snaps:
            raise ValueError(f"point {k} isn't near any road")
    cuts = spark.createDataFrame([(s["edge_id"], s["share"]) for s in snaps.values()], "edge_id long, share double")
    graph = paths.cut(overlay.query_graph(cuts, edges.drop("geometry")))
    placed = {(r["edge_id"], r["share"]): r["node"] for r in overlay.virtual_nodes(cuts).collect()}
    ends = {r["edge_id"]: (r["a"], r["b"]) for r in edges.filter(F.col("edge_id").isin([s["edge_id"] for s in snaps.values()])).select("edge_id", "a", "b").collect()}
    at = [placed.get((s["edge_id"], s["share"]), ends[s["edge_id"]][s["share"] >= 1]) for s in (snaps[k] for k in range(len(points)))]
    arcs = paths.cut(arcs_of(graph))
    extra = spark.createDataFrame([(at[k], snaps[k]["lat"], snaps[k]["lon"]) for k in range(len(points))], "node long, lat double, lon double")
    known = nodes.unionByName(extra.join(nodes, "node", "left_anti").dropDuplicates(["node"]))
    fastest = arcs.agg(F.max(F.col("distance_mm") / F.greatest("millis", F.lit(1)))).first()[0] or 0.0
    legs = paths.routes(spark.createDataFrame([(1, at)], "request long, points array<long>"), arcs, known, algorithm, fastest=fastest).orderBy("leg").collect()
    if any(not leg["found"] for leg in legs):
        raise ValueError("there is no connection between the points")
    used = sorted({k for leg in legs for k in leg["edges"]})
    length = {r["edge_key"]: (r["distance_mm"], r["millis"]) for r in arcs.filter(F.col("edge_key").isin(used)).select("edge_key", "distance_mm", "millis").collect()} if used else {}
    line = _lines(graph, edges, placed, used)
    rows = []
    for k, leg in enumerate(legs):
        whole = [(snaps[k]["lat"], snaps[k]["lon"])] + [p for key in leg["edges"] for p in line[key][1:]]
        rows.append((1, k, whole, sum(length[e][0] for e in leg["edges"]) / 1000, sum(length[e][1] for e in leg["edges"]), leg["weight"]))
    merged = answers.merged_legs(spark.createDataFrame(rows, f"request long, leg int, points {answers.LINE}, distance double, millis long, weight double"))
    if settings.flag("routing.simplify_response", True):
        merged = answers.simplified(merged, settings.number("routing.way_point_max_distance", 0.5))
    visited = answers.visited(spark.createDataFrame([(1, leg["visited"]) for leg in legs], "request long, visited long")).first()
    path = json.loads(answers.rendered(merged, encoded).drop("request").toJSON().first())
    return {"hints": {"visited_nodes.sum": visited["sum"], "visited_nodes.average": visited["average"]}, "paths": [path]}


def _lines(graph: DataFrame, edges: DataFrame, placed: dict, used: list[int]) -> dict[int, list[tuple]]:
    """The line of each used directed edge; a part of a cut edge has its part of the line."""
    ids = sorted({k >> 1 for k in used})
    if not ids:
        return {}
    share = {node: s for (_, s), node in placed.items()}
    parts = graph.filter(F.col("edge_id").isin(ids)).select("edge_id", "base_edge", "a", "b").join(edges.select(F.col("edge_id").alias("base_edge"), "geometry"), "base_edge").collect()
    whole = {r["edge_id"]: lines.part_of_line([(p["lat"], p["lon"]) for p in r["geometry"]], share.get(r["a"], 0.0), share.get(r["b"], 1.0)) for r in parts}
    return {k: whole[k >> 1][::-1] if k & 1 else whole[k >> 1] for k in used}

