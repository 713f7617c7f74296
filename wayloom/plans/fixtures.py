"""Road graphs derived from the warehouse tables, by arithmetic that any SQL engine repeats exactly.

Lanes: nations, joined where suppliers of one sold to customers of another.
Order ways: an order is a way, its line items' parts are the nodes. The ways fall
into REGIONS regions with nodes of their own, so that not every node is a junction.
Part links: a line item's part leads to the next one's in the order; this graph
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lane_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, lat, lon; whole tenths are divided once, as sums of 0.1 miss the nearest double at some places."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("node"), ((450 + (n * 7) % 25) / 10).alias("lat"), ((50 + (n * 11) % 25) / 10).alias("lon"))


def lane_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, a, b, distance_mm, speed, road_class, oneway."""
    read = lambda name: table(spark, sf_dir, name)
    line, orders = read("lineitem").select("l_orderkey", "l_suppkey"), read("orders").select("o_orderkey", "o_custkey")
    sold = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("l_suppkey", "o_custkey").distinct()
    seller, buyer = read("supplier").select("s_suppkey", "s_nationkey"), read("customer").select("c_custkey", "c_nationkey")
    pairs = sold.join(seller, F.col("l_suppkey") == F.col("s_suppkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    lanes = pairs.select(F.least("s_nationkey", "c_nationkey").cast("long").alias("a"), F.greatest("s_nationkey", "c_nationkey").cast("long").alias("b")).filter("a <> b").distinct()
    nodes = lane_nodes(spark, sf_dir)
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("lat").alias("lat_" + k), F.col("lon").alias("lon_" + k))
    full = lanes.join(F.broadcast(at("a")), "a").join(F.broadcast(at("b")), "b")
    a, b = F.col("a"), F.col("b")
    metres = geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return full.select((a * 25 + b).alias("edge_id"), "a", "b", geo.millimetres(metres).alias("distance_mm"), (20 + F.abs(a * 7 - b * 11) % 97).alias("speed"), ((a + b) % 4).alias("road_class"), ((a * b) % 9 == 0).alias("oneway"), "lat_a", "lon_a", "lat_b", "lon_b")


def arcs_of(edges: DataFrame) -> DataFrame:
    """Directed arcs: edge_key, base, adj and the edge's columns; the weight is whole milliseconds."""
    millis = F.round(F.col("distance_mm") * 3.6 / F.col("speed")).cast("long")
    forward = edges.select(geo.edge_key(F.col("edge_id")).alias("edge_key"), F.col("a").alias("base"), F.col("b").alias("adj"), "edge_id", "distance_mm", "speed", "road_class", millis.alias("millis"))
    backward = edges.filter("NOT oneway").select(geo.edge_key(F.col("edge_id"), True).alias("edge_key"), F.col("b").alias("base"), F.col("a").alias("adj"), "edge_id", "distance_mm", "speed", "road_class", millis.alias("millis"))
    return forward.union(backward)


def order_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, refs (ordered array<long>) and tags."""
    return order_refs(table(spark, sf_dir, "lineitem")).join(order_tags(spark, sf_dir), "way").select(F.col("way").cast("long"), "refs", "tags")


def order_refs(lines: DataFrame) -> DataFrame:
    """way and refs of the orders of given line items."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    refs = lines.groupBy(F.col("l_orderkey").alias("way")).agg(F.array_sort(F.collect_list(order)).alias("refs")).withColumn("refs", F.transform("refs", lambda x: x["l_partkey"].cast("long") + REGION * (F.col("way") % REGIONS)))
    return refs.withColumn("refs", F.when(F.col("way") % 200 == 0, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs")))


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way and tags (map<string, string>) for every order."""
    k = F.col("o_orderkey")
    pick = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    highway = F.create_map(*[F.lit(x) for kv in HIGHWAY_OF.items() for x in kv])
    tags = F.map_from_arrays(F.array(*map(F.lit, ("highway", "oneway", "maxspeed", "motor_vehicle", "surface", "tracktype", "junction", "bridge", "name"))), F.array(F.element_at(highway, F.col("o_orderpriority")), F.element_at(F.create_map(F.lit("F"), F.lit("yes"), F.lit("O"), F.lit("no"), F.lit("P"), F.lit("-1")), F.col("o_orderstatus")), pick(7, SPEED_TAGS), pick(5, ACCESS_TAGS), pick(4, SURFACES), pick(3, TRACKS), pick(11, JUNCTIONS), pick(6, BRIDGES), F.concat(F.lit("Way "), k.cast("string"), F.lit("; A"))))
    return table(spark, sf_dir, "orders").select(k.alias("way"), F.map_filter(tags, lambda _, v: v != "").alias("tags"))


REGION, REGIONS = 1_000_000, 40  # nodes are numbered part + REGION * region
HIGHWAY_OF = {"1-URGENT": "motorway", "2-HIGH": "primary_link", "3-MEDIUM": "residential", "4-NOT SPECIFIED": "track", "5-LOW": "footway"}
SPEED_TAGS = ("50", "30 mph", "none", "walk", "10 knots", "fast", "")
ACCESS_TAGS = ("", "no", "yes", "private;destination", "delivery")
SURFACES = ("asphalt", "gravel", "", "dirt")
TRACKS = ("grade1", "grade5", "")
JUNCTIONS = ("roundabout",) + ("",) * 10
BRIDGES = ("yes",) + ("",) * 5


def part_nodes(spark: SparkSession, sf_dir: str, with_gaps: bool = True) -> DataFrame:
    """node, lat, lon, barrier: a place for each node whose number within its region is a part's; each 50th node is missing, as in an extract.

    Parts numbered REGION or above lie in later regions, so there are as many
    regions as the largest part in a way needs. Sizes are guessed from the file of
    parts, without the regions; the hint keeps the nodes from being broadcast for that.
    """
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").filter(k.between(0, REGION - 1)).groupBy("p_partkey").agg(F.max(F.col("p_size") % 25 == 0).alias("barrier"))
    last = table(spark, sf_dir, "lineitem").agg(F.floor(F.coalesce(F.max("l_partkey"), F.lit(0)) / REGION).alias("later"))
    region = F.explode(F.sequence(F.lit(0), F.lit(REGIONS - 1) + F.col("later"))).alias("region")
    nodes = parts.crossJoin(F.broadcast(last)).select("*", region).select((k.cast("long") + REGION * F.col("region")).alias("node"), (45 + (k % 97) * 0.01).alias("lat"), (5 + (k % 89) * 0.01).alias("lon"), "barrier")
    return (nodes.filter(F.col("node") % 50 != 0) if with_gaps else nodes).hint("merge")


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("long").alias("point"), ((4500 + k % 241) / 100).alias("lat"), ((500 + k % 239) / 100).alias("lon"))


def part_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_key, base, adj, millis): the cheapest link of each pair of parts that follow each other in an order."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    base, adj = F.col("l_partkey").cast("long"), F.lead(F.col("l_partkey").cast("long")).over(order)
    steps = table(spark, sf_dir, "lineitem").select(base.alias("base"), adj.alias("adj"), F.col("l_quantity").cast("long").alias("q")).filter("adj IS NOT NULL AND adj <> base")
    return steps.groupBy("base", "adj").agg(F.min(F.col("q") * 100 + F.pmod(F.col("base") * 7 + F.col("adj"), F.lit(97))).alias("millis")).select((F.col("base") * 2_000_000 + F.col("adj") * 2).alias("edge_key"), "base", "adj", "millis")
