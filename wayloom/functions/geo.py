"""Geometry on Column expressions; latitudes, longitudes and angles in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0
CIRCUMFERENCE = 2 * math.pi * EARTH
_half = lambda a, b: F.sin(F.radians(b - a) / 2)


def normalised(lat1, lon1, lat2, lon2) -> Column:
    """A value that orders pairs of points by great-circle distance without roots."""
    return _half(lat1, lat2) * _half(lat1, lat2) + _half(lon1, lon2) * _half(lon1, lon2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))


def denormalised(value) -> Column:
    return 2 * EARTH * F.asin(F.sqrt(value))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    return denormalised(normalised(lat1, lon1, lat2, lon2))


def planar(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance, good for short lines."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return EARTH * F.sqrt(x * x + y * y)


def with_height(distance, ele1, ele2) -> Column:
    """Three-dimensional length; unknown heights count as level."""
    rise = F.coalesce(F.nanvl(ele2 - ele1, F.lit(0.0)), F.lit(0.0))
    return F.sqrt(distance * distance + rise * rise)


def millimetres(metres) -> Column:
    """Stored lengths: whole millimetres, at least 1; unknown lengths are a metre, too long ones are cut at 2^31 - 2."""
    return F.when(F.isnan(metres), F.lit(1000)).otherwise(F.least(F.greatest(F.round(metres * 1000), F.lit(1.0)), F.lit(2.0**31 - 2))).cast("long")


def orientation(lat1, lon1, lat2, lon2) -> Column:
    """Radians from east, counter-clockwise."""
    return F.atan2(lat2 - lat1, F.cos(F.radians((lat1 + lat2) / 2)) * (lon2 - lon1))


def azimuth(lat1, lon1, lat2, lon2) -> Column:
    """Degrees from north, clockwise, after rounding the angle to four places."""
    turn = math.pi / 2 - orientation(lat1, lon1, lat2, lon2)
    return F.pmod(F.degrees(rounded(F.when(turn < 0, turn + 2 * math.pi).otherwise(turn), 4)), F.lit(360.0))


def compass(degrees) -> Column:
    """One of eight points; slices are a sixteenth of the circle wide, two for each point."""
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW", "N")))
    return F.get(names, F.least(F.floor((degrees + 22.5) / 45), F.lit(8)).cast("int"))


def aligned(base, angle) -> Column:
    """angle, in radians, moved by a turn so that it is within half a turn of base."""
    up = (base >= 0) & (angle < base - math.pi)
    down = (base < 0) & (angle > base + math.pi)
    return F.when(up, angle + 2 * math.pi).when(down, angle - 2 * math.pi).otherwise(angle)


def clockwise(ax, ay, bx, by, cx, cy) -> Column:
    return (cx - ax) * (by - ay) - (cy - ay) * (bx - ax) < 0


def shrink(lat1, lat2) -> Column:
    return F.cos(F.radians((lat1 + lat2) / 2))


def foot_share(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Where the foot of the perpendicular lies on the segment, from 0 at its start to 1 at its end."""
    k = shrink(lat1, lat2)
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    return F.coalesce(((lon - lon1) * k * dx + (lat - lat1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))


def crossing_point(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    s = foot_share(lat, lon, lat1, lon1, lat2, lon2)
    return F.struct((lat1 + s * (lat2 - lat1)).alias("lat"), (lon1 + s * (lon2 - lon1)).alias("lon"))


def foot_inside(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    s = foot_share(lat, lon, lat1, lon1, lat2, lon2)
    return (s > 0) & (s < 1)


def segment_distance(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Planar distance to the nearest point of the segment."""
    s = F.least(F.greatest(foot_share(lat, lon, lat1, lon1, lat2, lon2), F.lit(0.0)), F.lit(1.0))
    return planar(lat, lon, lat1 + s * (lat2 - lat1), lon1 + s * (lon2 - lon1))


def projected(lat, lon, bearing, metres) -> Column:
    """The point metres away in the direction of bearing."""
    d, b, p = metres / EARTH, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.struct(F.degrees(q).alias("lat"), (F.pmod(lon + F.degrees(east) + 180, F.lit(360.0)) - 180).alias("lon"))


def intermediate(f, lat1, lon1, lat2, lon2) -> Column:
    """The point a share f of the way along the great circle."""
    p1, l1, p2, l2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    d = 2 * F.asin(F.sqrt(normalised(lat1, lon1, lat2, lon2)))
    a, b = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
    x, y = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2), a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    return F.when(d == 0, F.struct(lat1.alias("lat"), lon1.alias("lon"))).otherwise(F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon")))


def crosses_boundary(lon1, lon2) -> Column:
    return F.abs(lon1 - lon2) > 300


def polyline_length(points) -> Column:
    """Metres along an array of struct<lat, lon>."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0)))


def circle_circumference(lat) -> Column:
    return F.lit(CIRCUMFERENCE) * F.cos(F.radians(lat))


def box_around(lat, lon, radius) -> Column:
    d_lat = radius * 360 / CIRCUMFERENCE
    d_lon = radius * 360 / circle_circumference(lat)
    return F.struct((lon - d_lon).alias("min_lon"), (lon + d_lon).alias("max_lon"), (lat - d_lat).alias("min_lat"), (lat + d_lat).alias("max_lat"))


def box_contains(box, lat, lon) -> Column:
    return (lat <= box["max_lat"]) & (lat >= box["min_lat"]) & (lon <= box["max_lon"]) & (lon >= box["min_lon"])


def boxes_intersect(a, b) -> Column:
    return (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def box_intersection(a, b) -> Column:
    """Null where the boxes don't meet."""
    both = F.struct(F.greatest(a["min_lon"], b["min_lon"]).alias("min_lon"), F.least(a["max_lon"], b["max_lon"]).alias("max_lon"), F.greatest(a["min_lat"], b["min_lat"]).alias("min_lat"), F.least(a["max_lat"], b["max_lat"]).alias("max_lat"))
    return F.when(boxes_intersect(a, b), both)


def bounds(lat, lon) -> list[Column]:
    """Aggregates of a graph's bounding box."""
    return [F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat")]


def rounded(x, places: int) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 10**places + 0.5) / 10**places


def stored_degree(x) -> Column:
    return F.floor(x * 1e7 + 0.5) / 1e7


def stored_height(x) -> Column:
    return F.floor((x + 1000) * 1000 + 0.5) / 1000 - 1000


def edge_key(edge_id, reverse=False) -> Column:
    return F.shiftleft(edge_id, 1) + (1 if reverse else 0)


def reversed_key(key) -> Column:
    return key.bitwiseXOR(F.lit(1))


def edge_of_key(key) -> Column:
    return F.shiftright(key, 1)


def parsed_point(text) -> Column:
    """'lat,lon' as a struct; null where it is no pair of numbers."""
    parts = F.split(text, ",")
    lat, lon = (F.trim(F.get(parts, k)).try_cast("double") for k in (0, 1))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def hilbert(lat, lon, order: int = 31) -> Column:
    """Place on a Hilbert curve through 2^order by 2^order cells, from the north-west corner, by array functions alone."""
    size = 1 << order
    cell = lambda share: F.least(F.greatest((share * size).cast("long"), F.lit(0)), F.lit(size - 1)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("d"), cell((lon + 180) / 360).alias("x"), cell((90 - lat) / 180).alias("y"))

    def step(state, k):
        s = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = (F.when(state[c].bitwiseAND(s) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for c in ("x", "y"))
        flip = lambda c: F.when((ry == 0) & (rx == 1), s - 1 - state[c]).otherwise(state[c])
        x, y = F.when(ry == 0, flip("y")).otherwise(flip("x")), F.when(ry == 0, flip("x")).otherwise(flip("y"))
        low = s * 2 - 1
        return F.struct((state["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"), x.bitwiseAND(low).alias("x"), y.bitwiseAND(low).alias("y"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda state: state["d"])
