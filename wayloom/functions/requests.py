"""Routing requests: decoding, loose typing and checks, on maps of strings and on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that requests may no longer have, and the order in which they are looked for.
LEGACY = ("vehicle", "weighting", "turn_costs", "edge_based")


def typed(text: Column) -> Column:
    """Which type a value is read as: boolean, integer, number or string."""
    boolean = F.lower(text).isin("true", "false")
    return F.when(text.isNull(), None).when(boolean, "bool").when(text.rlike(r"^[+-]?\d{1,18}$"), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("string")


def bool_or(text: Column, default: bool) -> Column:
    return F.coalesce(F.lower(text).try_cast("boolean"), F.lit(default))


def float_or(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def string_or(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def hint(hints: Column, key: str) -> Column:
    return F.try_element_at(hints, F.lit(key))


def without_legacy(hints: Column) -> Column:
    return F.map_filter(hints, lambda k, _: ~k.isin(*LEGACY))


def decoded_body(body: Column) -> Column:
    """A JSON request: points are pairs of longitude and latitude."""
    return F.from_json(body, "points array<array<double>>, profile string, algorithm string, headings array<double>, point_hints array<string>, curbsides array<string>, snap_preventions array<string>, details array<string>, points_encoded boolean")


def decoded_query(query: Column) -> Column:
    """The parameters of a query string, names in snake case, in an array for each name."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(F.lower(F.regexp_replace(F.url_decode(F.substring_index(x, "=", 1)), "([A-Z])", "_$1")).alias("k"), F.url_decode(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))


def problem(points: Column, headings: Column, point_hints: Column, curbsides: Column, hints: Column, box: Column) -> Column:
    """The first thing wrong with a request, null where it is right; points: array<struct<lat, lon>>."""
    n = F.size(points)
    legacy = F.lit(None).cast("string")
    for name in reversed(LEGACY):
        legacy = F.when(F.map_contains_key(hints, name), F.lit(f"the parameter {name} is no longer allowed, use the profile")).otherwise(legacy)
    place = lambda bad: F.array_min(F.filter(F.transform(points, lambda p, i: F.when(bad(p), i)), lambda i: i.isNotNull()))
    missing = place(lambda p: p.isNull() | p["lat"].isNull() | F.isnan(p["lat"]) | p["lon"].isNull() | F.isnan(p["lon"]))
    outside = place(lambda p: (p["lat"] > box["max_lat"]) | (p["lat"] < box["min_lat"]) | (p["lon"] > box["max_lon"]) | (p["lon"] < box["min_lon"]))
    wrong = F.exists(headings, lambda h: ~(F.isnan(h) | ((h >= 0) & (h < 360))))
    few = lambda values: (F.size(values) > 0) & (F.size(values) != n)
    return (
        F.when(legacy.isNotNull(), legacy)
        .when(n == 0, F.lit("a request needs a point"))
        .when((F.size(headings) > 1) & (F.size(headings) != n), F.lit("headings: none, one, or one for each point"))
        .when(wrong, F.lit("a heading must be in [0, 360) or NaN"))
        .when(few(point_hints), F.lit("point hints: one for each point"))
        .when(few(curbsides), F.lit("curbsides: one for each point"))
        .when(F.map_contains_key(hints, "block_area"), F.lit("block_area is no longer allowed"))
        .when(missing.isNotNull(), F.concat(F.lit("point "), missing.cast("string"), F.lit(" is null")))
        .when(outside.isNotNull(), F.concat(F.lit("point "), outside.cast("string"), F.lit(" is out of bounds")))
    )


def escaped(text: Column) -> Column:
    """text for use in XML."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def gpx(name: Column, points: Column) -> Column:
    """A track of an array<struct<lat, lon>> in the GPX format."""
    steps = F.array_join(F.transform(points, lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('"/>'))), "")
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), escaped(name), F.lit("</name><trkseg>"), steps, F.lit("</trkseg></trk></gpx>"))


def error_body(message: Column, kind: str) -> Column:
    return F.to_json(F.struct(message.alias("message"), F.array(F.struct(message.alias("message"), F.lit(kind).alias("details"))).alias("hints")))
