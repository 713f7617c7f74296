"""Which edges at a node fit a heading, or a side of the road."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo

# No edge, any edge, and how near two degrees count as equal.
NONE, ANY = -1, -2
NEAR = 1e-6


def other_headings(adjacent: DataFrame, heading: Column, tolerance: float = 100.0) -> DataFrame:
    """Rows of adjacent (node, edge_id, points from the node on) that leave in a direction more than tolerance degrees off heading, which is clockwise from north."""
    wanted = F.radians(F.pmod(90 - heading + 180, F.lit(360.0)) - 180)
    a, b = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    own = geo.aligned(wanted, geo.orientation(a["lat"], a["lon"], b["lat"], b["lon"]))
    return adjacent.filter(F.abs(own - wanted) > math.radians(tolerance))


def _same(p, q) -> Column:
    return (F.abs(p["lat"] - q["lat"]) < NEAR) & (F.abs(p["lon"] - q["lon"]) < NEAR)


def sides(adjacent: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, node, in_right, out_right, in_left, out_left): by which edges a place beside the road is reached and left so that it is on the right, or left.

    adjacent: (node, edge_id, points from the node on, enters, leaves); asked:
    (request, node, lat, lon). Where the place can't be passed all are -1; where
    the side can't be told, at junctions, beside edges of no length or where two
    edges lead to one point, all are -2. A node's edges are collected: its degree
    bounds them.
    """
    p0, p1, p2 = (F.get("points", F.lit(k)) for k in range(3))
    still = _same(p0, p1)
    place = F.struct(F.col("points")[0]["lat"].alias("lat"), F.col("points")[0]["lon"].alias("lon"))
    follows = F.when(still & (F.size("points") > 2), p2).otherwise(p1)
    open_ = adjacent.filter(F.col("enters") | F.col("leaves")).select("node", F.struct((-F.col("edge_id")).alias("order"), "edge_id", "enters", "leaves", follows.alias("next"), (still & (F.size("points") == 2)).alias("flat")).alias("e"), place.alias("here"))
    known = open_.groupBy("node").agg(F.array_sort(F.collect_list("e")).alias("es"), F.first("here").alias("here"))
    known = known.withColumn("nexts", F.aggregate(F.transform("es", lambda e: e["next"]), F.slice(F.transform("es", lambda e: e["next"]), 1, 0), lambda s, p: F.when(F.exists(s, lambda q: _same(p, q)), s).otherwise(F.concat(s, F.array(p)))))
    to = lambda k, way: F.filter("es", lambda e: e[way] & _same(e["next"], F.get("nexts", F.lit(k))))
    known = known.select("*", to(0, "enters").alias("in1"), to(1, "enters").alias("in2"), to(0, "leaves").alias("out1"), to(1, "leaves").alias("out2"))
    many = F.greatest(*[F.size(c) for c in ("in1", "in2", "out1", "out2")]) > 1
    first = lambda c: F.get(c, F.lit(0))
    edge = lambda c: F.coalesce(first(c)["edge_id"].cast("long"), F.lit(NONE).cast("long"))
    rows = asked.select("request", "node", "lat", "lon").join(known, "node", "left")

    def right(came, goes):
        """Whether the place is right of the way that comes from one point and goes to the other."""
        x, y = (lambda p: p["lon"] - F.col("here.lon")), (lambda p: p["lat"] - F.col("here.lat"))
        q = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
        a, b = first(came)["next"], first(goes)["next"]
        return ~geo.clockwise(x(a), y(a), x(b), y(b), x(q), y(q))

    result = lambda *v: F.struct(*[x.cast("long").alias(n) for n, x in zip(("in_right", "out_right", "in_left", "out_left"), v, strict=True)])
    of_all = lambda x: result(*[F.lit(x)] * 4)
    single = lambda came, goes: F.when(right(came, goes), result(edge(came), edge(goes), F.lit(NONE), F.lit(NONE))).otherwise(result(F.lit(NONE), F.lit(NONE), edge(came), edge(goes)))
    both = F.when(right("in1", "out2"), result(edge("in1"), edge("out2"), edge("in2"), edge("out1"))).otherwise(result(edge("in2"), edge("out1"), edge("in1"), edge("out2")))
    two = F.when((F.size("in1") == 0) | (F.size("out2") == 0), single("in2", "out1")).when((F.size("in2") == 0) | (F.size("out1") == 0), single("in1", "out2")).otherwise(both)
    shut = F.col("es").isNull() | F.forall("es", lambda e: e["flat"]) | ~F.exists("es", lambda e: e["enters"]) | ~F.exists("es", lambda e: e["leaves"])
    found = (
        F.when(shut, of_all(NONE))
        .when(F.exists("es", lambda e: e["flat"]) | (F.size("nexts") > 2) | many, of_all(ANY))
        .when(F.size("nexts") == 1, result(edge("in1"), edge("out1"), edge("in1"), edge("out1")))
        .otherwise(two)
    )
    return rows.withColumn("x", found).select("request", "node", "x.in_right", "x.out_right", "x.in_left", "x.out_left")


def edge_of_side(side: Column, right: Column, left: Column) -> Column:
    """The edge for a curbside of right, left, any or none given; other words are an error."""
    word = F.coalesce(F.nullif(F.trim(side), F.lit("")), F.lit("any"))
    return F.when(word == "right", right).when(word == "left", left).when(word == "any", F.lit(ANY).cast("long")).otherwise(F.raise_error(F.concat(F.lit("unknown curbside: "), word)).cast("long"))
