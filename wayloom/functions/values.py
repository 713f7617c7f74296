"""Encoded values: typed edge attributes with their ranges, as a registry and as quantising expressions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final float for goto if implements import int interface long native new package private public return short static super switch this throw try void volatile while".split()


@dataclass(frozen=True)
class EncodedValue:
    name: str
    kind: str  # bool, int, decimal, enum, string
    bits: int = 1
    low: float = 0.0
    factor: float = 1.0
    negate_reverse: bool = False
    two_way: bool = False
    max_is_infinity: bool = False
    values: tuple = ()

    def __post_init__(self):
        if not re.fullmatch("[a-z][a-z0-9_]+", self.name) or "__" in self.name or self.name in RESERVED or self.name.startswith(("in_", "backward_")):
            raise ValueError(f"{self.name!r} is no name for an encoded value")

    @property
    def high(self) -> float:
        """The greatest value that can be stored."""
        return self.low + ((1 << self.bits) - 1 - self.max_is_infinity) * self.factor

    def stored(self, value: Column) -> Column:
        """value as it reads back; null where it is out of range."""
        if self.kind == "bool":
            return value
        if self.kind == "enum":
            return F.when(F.lower(value).isin(*self.values), F.lower(value)).otherwise(self.values[0])
        step = F.round((value - self.low) / self.factor) * self.factor + self.low
        inside = F.when((value >= self.low) & (step <= self.high), step)
        return F.when(value == float("inf"), float("inf")).otherwise(inside) if self.max_is_infinity else inside


# Bits, least value, step and flags of each attribute.
CATALOGUE = {
    e.name: e
    for e in (
        EncodedValue("car_access", "bool", two_way=True),
        EncodedValue("car_average_speed", "decimal", 7, 0, 2, two_way=True),
        EncodedValue("car_turn_cost", "decimal", 1, 0, 1, max_is_infinity=True),
        EncodedValue("car_subnetwork", "bool"),
        EncodedValue("max_speed", "decimal", 7, 0, 2, two_way=True, max_is_infinity=True),
        EncodedValue("ferry_speed", "decimal", 5, 0, 2),
        EncodedValue("average_slope", "decimal", 5, 0, 1, negate_reverse=True),
        EncodedValue("max_slope", "decimal", 5, 0, 1, negate_reverse=True),
        EncodedValue("curvature", "decimal", 4, 0.25, 0.05),
        EncodedValue("orientation", "decimal", 5, 0, 12, two_way=True),
        EncodedValue("max_height", "decimal", 7, 0, 0.1, max_is_infinity=True),
        EncodedValue("max_length", "decimal", 7, 0, 0.1, max_is_infinity=True),
        EncodedValue("max_width", "decimal", 7, 0, 0.1, max_is_infinity=True),
        EncodedValue("max_weight", "decimal", 9, 0, 0.1, max_is_infinity=True),
        EncodedValue("max_axle_load", "decimal", 7, 0, 0.5, max_is_infinity=True),
        EncodedValue("osm_way_id", "int", 31),
        EncodedValue("lanes", "int", 3),
        EncodedValue("hike_rating", "int", 3),
        EncodedValue("horse_rating", "int", 3),
        EncodedValue("mtb_rating", "int", 3),
        EncodedValue("lit", "bool"),
        EncodedValue("roundabout", "bool"),
        EncodedValue("road_class_link", "bool"),
        EncodedValue("max_speed_estimated", "bool"),
        EncodedValue("get_off_bike", "bool", two_way=True),
        EncodedValue("road_environment", "enum", 3, values=("other", "road", "ferry", "tunnel", "bridge", "ford")),
    )
}


class Registry:
    """The attributes of a graph, kept as JSON beside its tables."""

    def __init__(self, values: list[EncodedValue]):
        self.values: dict[str, EncodedValue] = {}
        for v in values:
            if v.name in self.values:
                raise ValueError(f"{v.name} is there already")
            self.values[v.name] = v

    def to_json(self) -> str:
        return json.dumps({"version": 1, "values": [asdict(v) for v in self.values.values()]})

    @classmethod
    def from_json(cls, text: str) -> Registry:
        read = json.loads(text)
        if read["version"] != 1:
            raise ValueError("another version")
        return cls([EncodedValue(**{**v, "values": tuple(v["values"])}) for v in read["values"]])
