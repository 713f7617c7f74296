"""Tiles and nearest edges: an equi-join on tiles, then exact distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo

TILE = 0.1  # degrees
TOUCH = 1e-9  # a line this near to a border counts on both sides, so that rounding can't lose a tile
RINGS = 3


def tile(x, size: float = TILE):
    return F.floor(x / size).cast("long")


def edge_tiles(segments: DataFrame, size: float = TILE) -> DataFrame:
    """(tile_x, tile_y, edge_id) for segments (edge_id, lat_a, lon_a, lat_b, lon_b): the tiles that each line runs through, each once; lines over the date line have none.

    In each row of tiles the line is cut at the row's borders, so a long slanting
    line gets as many tiles as it crosses, not all of its box.
    """
    low, high = F.least("lat_a", "lat_b"), F.greatest("lat_a", "lat_b")
    west, east = F.least("lon_a", "lon_b"), F.greatest("lon_a", "lon_b")
    inside = segments.filter(~geo.crosses_boundary(F.col("lon_a"), F.col("lon_b")))
    rows = inside.select("edge_id", "lat_a", "lon_a", "lat_b", "lon_b", F.explode(F.sequence(tile(low - TOUCH, size), tile(high + TOUCH, size))).alias("tile_y"))
    bottom, top = F.least(F.greatest(low, F.col("tile_y") * size), high), F.greatest(F.least(high, (F.col("tile_y") + 1) * size), low)
    at = lambda lat: F.col("lon_a") + (lat - F.col("lat_a")) / F.nullif(F.col("lat_b") - F.col("lat_a"), F.lit(0.0)) * (F.col("lon_b") - F.col("lon_a"))
    # A level line has no crossing with the borders, and runs through all columns.
    first = F.greatest(F.coalesce(F.least(at(bottom), at(top)), west), west)
    last = F.least(F.coalesce(F.greatest(at(bottom), at(top)), east), east)
    return rows.select(F.explode(F.sequence(tile(F.least(first, last) - TOUCH, size), tile(F.greatest(first, last) + TOUCH, size))).alias("tile_x"), "tile_y", "edge_id")


def nearest_edges(points: DataFrame, segments: DataFrame, rings: int = RINGS, size: float = TILE) -> DataFrame:
    """(point, edge_id, distance_mm, lat, lon): each point's nearest edge within rings of tiles, ties by edge id.

    Points at one place are answered once, and all places in a tile share one list
    of the edges around it, so that no pair of a place and an edge is a row. Sizes are
    guessed without the tiles around; the hints keep these rows from being broadcast.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = F.sequence(F.lit(-rings), F.lit(rings))
    places = points.select("lat", "lon").distinct().select("lat", "lon", tile(F.col("lon"), size).alias("cell_x"), tile(F.col("lat"), size).alias("cell_y")).repartition(parts, "cell_x", "cell_y")
    asked = places.select("cell_x", "cell_y").distinct().select("*", F.explode(around).alias("dx")).select("*", F.explode(around).alias("dy"))
    asked = asked.select("cell_x", "cell_y", (F.col("cell_x") + F.col("dx")).alias("tile_x"), (F.col("cell_y") + F.col("dy")).alias("tile_y"))
    met = asked.hint("merge").join(edge_tiles(segments, size), ["tile_x", "tile_y"]).select("cell_x", "cell_y", "edge_id").distinct().join(segments.select("edge_id", "lat_a", "lon_a", "lat_b", "lon_b"), "edge_id")
    near = met.repartition(parts, "cell_x", "cell_y").groupBy("cell_x", "cell_y").agg(F.collect_list(F.struct("edge_id", "lat_a", "lon_a", "lat_b", "lon_b")).alias("near"))
    lat, lon = F.col("lat"), F.col("lon")
    share = lambda e: F.least(F.greatest(geo.foot_share(lat, lon, e["lat_a"], e["lon_a"], e["lat_b"], e["lon_b"]), F.lit(0.0)), F.lit(1.0))
    foot = lambda e, s: F.struct(e["edge_id"].alias("edge_id"), (e["lat_a"] + s * (e["lat_b"] - e["lat_a"])).alias("lat"), (e["lon_a"] + s * (e["lon_b"] - e["lon_a"])).alias("lon"))
    feet = F.transform(F.transform("near", lambda e: F.struct(e.alias("e"), share(e).alias("s"))), lambda x: foot(x["e"], x["s"]))
    scored = F.transform(feet, lambda x: F.struct(F.round(geo.planar(lat, lon, x["lat"], x["lon"]) * 1000).cast("long").alias("distance_mm"), x["edge_id"].alias("edge_id"), x["lat"].alias("lat"), x["lon"].alias("lon")))
    best = places.hint("merge").join(near, ["cell_x", "cell_y"]).select("lat", "lon", F.array_min(scored).alias("x"))
    return points.select("point", "lat", "lon").join(best, ["lat", "lon"]).groupBy("point").agg(F.min("x").alias("x")).select("point", "x.edge_id", "x.distance_mm", "x.lat", "x.lon")


def edges_in_box(segments: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Edges whose box meets the given one."""
    box = F.struct(F.least("lon_a", "lon_b").alias("min_lon"), F.greatest("lon_a", "lon_b").alias("max_lon"), F.least("lat_a", "lat_b").alias("min_lat"), F.greatest("lat_a", "lat_b").alias("max_lat"))
    want = F.struct(F.lit(min_lon).alias("min_lon"), F.lit(max_lon).alias("max_lon"), F.lit(min_lat).alias("min_lat"), F.lit(max_lat).alias("max_lat"))
    return segments.filter(geo.boxes_intersect(box, want))


def split_edges(snaps: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, part, share_from, share_to, length_mm): edges cut at snapped shares (edge_id, share); parts sum to the edge.

    Points at the same share are one virtual node; the last part takes the rounding.
    """
    from pyspark.sql import Window

    inner = snaps.filter((F.col("share") > 0) & (F.col("share") < 1)).select("edge_id", "share").distinct()
    cuts = inner.union(inner.select("edge_id", F.lit(1.0)).distinct())
    order = Window.partitionBy("edge_id").orderBy("share")
    at = F.round(F.col("share") * F.col("distance_mm")).cast("long")
    placed = cuts.join(edges.select("edge_id", "distance_mm"), "edge_id").withColumn("at", at)
    return placed.select("edge_id", (F.row_number().over(order) - 1).alias("part"), F.coalesce(F.lag("share").over(order), F.lit(0.0)).alias("share_from"), F.col("share").alias("share_to"), (F.col("at") - F.coalesce(F.lag("at").over(order), F.lit(0))).alias("length_mm"))
