"""Answers to routing requests: legs put together, simplified, and rendered as geometry and instructions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import lines

LINE = "array<struct<lat:double,lon:double>>"


def merged_legs(legs: DataFrame) -> DataFrame:
    """(request, distance, millis, weight, points, stops): the legs of each request in order, as one line.

    legs: (request, leg, points, distance, millis, weight). A leg's first point is
    the last of the leg before it and isn't repeated; stops are the places of the
    request's points on the line. A group is one request, which its points bound.
    """
    line = F.transform("points", lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lon"].cast("double").alias("lon")))
    rows = legs.withColumn("points", F.coalesce(line, F.array().cast(LINE)))
    parts = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("leg", "points", "distance", "millis", "weight"))).alias("legs"))
    points = F.flatten(F.transform("legs", lambda x, i: F.when(i == 0, x["points"]).otherwise(F.slice(x["points"], 2, F.greatest(F.size(x["points"]) - 1, F.lit(0))))))
    ends = F.aggregate("legs", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.greatest(F.size(x["points"]) - 1, F.lit(0)))))
    total = lambda name, kind: F.aggregate("legs", F.lit(0).cast(kind), lambda s, x: s + x[name].cast(kind))
    return parts.select("request", total("distance", "double").alias("distance"), total("millis", "long").alias("millis"), total("weight", "double").alias("weight"), points.alias("points"), ends.alias("stops"))


def simplified(answers: DataFrame, limit: float = 0.5) -> DataFrame:
    """answers with fewer points, none moved by more than limit metres, and none of the stops lost."""

    @F.pandas_udf(f"struct<points:{LINE},stops:array<int>>")
    def run(lines_: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for line, own in zip(lines_, stops, strict=True):
            places = [(p["lat"], p["lon"]) for p in line]
            cuts = sorted({0, *(int(x) for x in own), max(len(places) - 1, 0)})
            kept, at = lines.simplified_parts(places, cuts, limit) if places else ([], [0] * len(cuts))
            where = dict(zip(cuts, at, strict=True))
            out.append(([{"lat": places[i][0], "lon": places[i][1]} for i in kept], [where[int(x)] for x in own]))
        return pd.DataFrame(out, columns=["points", "stops"])

    thin = answers.withColumn("·x", run("points", "stops"))
    return thin.withColumn("points", F.col("·x.points")).withColumn("stops", F.col("·x.stops")).drop("·x")


def geometry(points: Column, encoded: bool = True) -> Column:
    """A polyline string, or a GeoJSON line with longitude first."""
    pairs = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    return lines.polyline(points) if encoded else F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))


def box(points: Column) -> Column:
    """[min lon, min lat, max lon, max lat], null without points."""
    side = lambda f, name: f(F.transform(points, lambda p: p[name]))
    return F.when(F.size(points) > 0, F.array(side(F.array_min, "lon"), side(F.array_min, "lat"), side(F.array_max, "lon"), side(F.array_max, "lat")))


def instructions(distance: Column, millis: Column, points: Column) -> Column:
    """The two fixed instructions: go on for the whole way, then arrive."""
    last = F.greatest(F.size(points) - 1, F.lit(0))
    # Texts and signs.
    row = lambda text, sign, d, t, a: F.struct(F.lit(text).alias("text"), d.alias("distance"), t.alias("time"), F.array(a, last).alias("interval"), F.lit(sign).alias("sign"))
    return F.array(row("Continue", 0, distance, millis, F.lit(0)), row("Arrive at destination", 4, F.lit(0.0), F.lit(0).cast("long"), last))


def rendered(answers: DataFrame, encoded: bool = True) -> DataFrame:
    """(request, distance, time, weight, points_encoded, points, snapped_waypoints, bbox, instructions)."""
    snapped = F.filter(F.transform("stops", lambda i: F.get("points", i)), lambda p: p.isNotNull())
    some = F.size("points") > 0
    # The name points is given anew below, so the stops' places are taken before.
    return answers.withColumn("·stops", snapped).select(
        "request", "distance", F.col("millis").alias("time"), "weight", F.lit(encoded).alias("points_encoded"), F.when(some, geometry(F.col("points"), encoded)).alias("points"),
        F.when(some, geometry(F.col("·stops"), encoded)).alias("snapped_waypoints"), box(F.col("points")).alias("bbox"), instructions(F.col("distance"), F.col("millis"), F.col("points")).alias("instructions"),
    )


def visited(routes: DataFrame) -> DataFrame:
    """(request, sum, average) of the nodes that a request's legs settled; the average is a whole number."""
    legs = F.greatest(F.count("*"), F.lit(1))
    total = F.coalesce(F.sum("visited"), F.lit(0))
    return routes.groupBy("request").agg(total.alias("sum"), F.floor(total / legs).alias("average"))
