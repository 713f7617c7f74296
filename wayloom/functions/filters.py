"""Edge predicates and weights as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions import geo

# What a point may be kept from, and the columns that tell.
PREVENTIONS = {"motorway": "road_class", "trunk": "road_class", "tunnel": "road_environment", "bridge": "road_environment", "ferry": "road_environment", "ford": "road_environment"}
HEADING_TOLERANCE, HEADING_METRES = 30.0, 20.0


def out_edges(forward: Column, backward: Column) -> Column:
    return forward


def in_edges(forward: Column, backward: Column) -> Column:
    return backward


def either_edges(forward: Column, backward: Column) -> Column:
    return forward | backward


def finite_weight(weight_forward: Column, weight_backward: Column) -> Column:
    return (weight_forward < float("inf")) | (weight_backward < float("inf"))


def default_snap(subnetwork: Column, weight_forward: Column, weight_backward: Column) -> Column:
    return ~subnetwork & finite_weight(weight_forward, weight_backward)


def snap_allowed(preventions: list[str], columns: dict[str, Column]) -> Column:
    """Whether an edge is of none of the kinds to prevent; unknown kinds are an error."""
    out = F.lit(True)
    for p in normalised_preventions(preventions):
        if p not in PREVENTIONS:
            raise ValueError(f"cannot find a snap prevention for {p!r}")
        out = out & (columns[PREVENTIONS[p]] != p)
    return out


def normalised_preventions(preventions: list[str]) -> list[str]:
    return [p.strip() for p in preventions if p.strip()]


def heading_allowed(lat: Column, lon: Column, heading: Column, line: tuple[Column, Column, Column, Column], forward: Column, backward: Column) -> Column:
    """Whether a straight edge near the point may be driven within 30 degrees of the heading; a line farther than 20 m never."""
    near = geo.segment_distance(lat, lon, *line) <= HEADING_METRES
    along = geo.azimuth(*line)
    against = F.pmod(along + 180, F.lit(360.0))
    return near & (((F.abs(along - heading) < HEADING_TOLERANCE) & forward) | ((F.abs(against - heading) < HEADING_TOLERANCE) & backward))


def speed_weight(distance: Column, speed: Column, access: Column) -> Column:
    """Metres over stored speed; infinite without access or speed."""
    return F.when(access & (speed > 0), distance / F.nullif(speed, F.lit(0.0))).otherwise(F.lit(float("inf")))


def speed_millis(distance: Column, speed: Column, access: Column) -> Column:
    return F.when(access & (speed > 0), F.floor(1000 * distance / F.nullif(speed, F.lit(0.0)))).cast("long")


def least_weight_per_metre(top_speed: float, top_priority: float, distance_influence: float = 0.0) -> float:
    """A lower bound of the weight of a metre, for goal-directed search."""
    return 3.6 / top_speed / top_priority + distance_influence / 1000


def stored_turn_cost(from_edge: Column, to_edge: Column, cost: Column, u_turn: float) -> Column:
    """A decimal turn cost; a turn back costs u_turn at least, or is forbidden where that is negative."""
    own = F.coalesce(cost, F.lit(0.0))
    back = F.lit(float("inf")) if u_turn < 0 else F.greatest(own, F.lit(u_turn))
    return F.when(from_edge == to_edge, back).otherwise(own)


def beeline(lat: Column, lon: Column, to_lat: Column, to_lon: Column, per_metre: float, epsilon: float = 1.0, planar: bool = False) -> Column:
    """The least weight that is left to a target."""
    return (geo.planar if planar else geo.haversine)(lat, lon, to_lat, to_lon) * (per_metre * epsilon)


def balanced(to_target: Column, to_source: Column, reverse: bool = False, offset: float = 0.0) -> Column:
    """Half the difference of two beelines: a goal bound that suits a search from both ends."""
    half = (to_target - to_source) / 2
    return -half + offset if reverse else half + offset


def checked_weighting_name(name: str) -> str:
    if not re.fullmatch(r"[a-z_|]+", name):
        raise ValueError(f"{name!r} is no name of a weighting")
    return name
