"""Line simplification and polyline strings: Arrow batches, as recursion has no native form."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def simplified_points(points: list, limit: float) -> list[int]:
    """Indexes that stay when points closer than limit metres to their chord go; ends stay."""
    if len(points) < 3:
        return list(range(len(points)))
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (lat1, lon1), (lat2, lon2) = points[a], points[b]
        far, at = limit, None
        for i in range(a + 1, b):
            d = chord_distance(*points[i], lat1, lon1, lat2, lon2)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def chord_distance(lat, lon, lat1, lon1, lat2, lon2) -> float:
    k = math.cos(math.radians((lat1 + lat2) / 2))
    dx, dy, px, py = (lon2 - lon1) * k, lat2 - lat1, (lon - lon1) * k, lat - lat1
    n = dx * dx + dy * dy
    s = min(1.0, max(0.0, (px * dx + py * dy) / n)) if n else 0.0
    return math.radians(math.hypot(px - s * dx, py - s * dy)) * EARTH


def simplify(limit: float = 0.5):
    """A function of an array<struct<lat, lon>> column."""

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            pts = [(p["lat"], p["lon"]) for p in line] if line is not None else []
            out.append([{"lat": pts[i][0], "lon": pts[i][1]} for i in simplified_points(pts, limit)])
        return pd.Series(out)

    return run


def simplified_parts(points: list, cuts: list[int], limit: float) -> tuple[list[int], list[int]]:
    """Simplify between the given indexes, which stay: the indexes kept, and where the cuts are among them."""
    cuts = sorted({0, *cuts, len(points) - 1})
    kept = [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        kept += [a + i for i in simplified_points(points[a : b + 1], limit)[1:]]
    return kept, [kept.index(c) for c in cuts]


def part_of_line(points: list, start: float, end: float) -> list[tuple]:
    """The part of a line between two shares of its length, which are places on it."""
    step = lambda p, q: 2 * EARTH * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.sin(math.radians(q[1] - p[1]) / 2) ** 2 * math.cos(math.radians(p[0])) * math.cos(math.radians(q[0]))))
    at = [0.0]
    for p, q in zip(points, points[1:], strict=False):
        at.append(at[-1] + step(p, q))

    def place(share):
        x = share * at[-1]
        k = next((i for i in range(1, len(at)) if at[i] >= x), len(at) - 1)
        f = (x - at[k - 1]) / (at[k] - at[k - 1]) if at[k] > at[k - 1] else 0.0
        return tuple(a + f * (b - a) for a, b in zip(points[k - 1], points[k], strict=True))

    head = tuple(points[0]) if start <= 0 else place(start)
    tail = tuple(points[-1]) if end >= 1 else place(end)
    return [head, *(tuple(p) for p, x in zip(points[1:-1], at[1:-1], strict=True) if start * at[-1] < x < end * at[-1]), tail]


def encode_polyline(points: list, factor: float = 1e5, dims: int = 2) -> str:
    """Zig-zag differences in groups of five bits; a third number, a height, is stored in centimetres."""
    out, last = [], [0] * dims
    for p in points:
        for k in range(dims):
            value = math.floor(p[k] * (factor if k < 2 else 100) + 0.5)
            n, last[k] = value - last[k], value
            n = ~(n << 1) if n < 0 else n << 1
            while n >= 32:
                out.append(chr((32 | n & 31) + 63))
                n >>= 5
            out.append(chr(n + 63))
    return "".join(out)


def decode_polyline(text: str, factor: float = 1e5, dims: int = 2) -> list[tuple]:
    numbers, value, shift = [], 0, 0
    for c in text:
        n = ord(c) - 63
        value |= (n & 31) << shift
        shift += 5
        if n < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    out, last = [], [0] * dims
    for i in range(0, len(numbers) - dims + 1, dims):
        last = [a + b for a, b in zip(last, numbers[i : i + dims], strict=True)]
        out.append(tuple(v / (factor if k < 2 else 100) for k, v in enumerate(last)))
    return out


def polyline(points):
    """The encoded polyline of an array of (lat, lon); the UDF is made on use, as making it needs a session."""

    @F.pandas_udf("string")
    def encoded(lines: pd.Series) -> pd.Series:
        return pd.Series([encode_polyline([(p["lat"], p["lon"]) for p in line]) if line is not None else None for line in lines])

    return encoded(points)
