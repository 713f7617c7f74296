"""Cropped and edited copies of images, by local descriptors.

Images are binary columns: portable grey and colour maps (P2, P3, P5, P6, 8 bits)
and PNG (8 bits, not interlaced). Images of equal bytes are one node from the start,
named by a 64-bit hash. For each distinct image:

1. All corners (Harris) at several scales; each has an orientation (intensity
   centroid) and a descriptor of 256 intensity tests at point pairs turned by it. A
   test holds where the second point is brighter by MARGIN, so that noise on a flat
   ground doesn't flip bits.
2. Each of TABLES Hamming tables reads WORD of the descriptor's bits. Its keys are
   constellations: a corner's word and, for each OTHERS of its NEIGHBOURS nearest
   corners at the same scale, their words and places, seen from the corner and turned
   by it, in cells of CELL pixels. So a key holds geometry as well as bits, and
   images that merely have similar corners hardly ever share one. Images that share
   a key are compared (see 3): all with the key's first image, then, where a key's
   images aren't in one class yet, with others chosen by hash, then the images of
   the keys that are left block by block, in tasks of bounded size, without listing
   their pairs. So each pair that shares a key is compared or in one class already,
   and a large group of copies costs its size.
3. Comparison takes all features: mutual matches within NEAR bits each propose a
   similarity transform (scale, turn, shift), and the images are copies if LEAST
   matches and SHARE of the smaller image's features agree on one. Classes are the
   connected components.

Cases: null, empty and unreadable images have no features; a null is a class of its
own row, others are copies of equal bytes only, as flat images without corners are.
Ids may be null or repeated: classes belong to pictures, and a class is named by its
smallest id that isn't null. An empty table gives an empty result. Other columns
aren't read.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, shuffle_parts, written
from .components import components

RADIUS, TURNS, LEAST = 6, 32, 5
MARGIN = 8.0  # grey levels
NEAR, SHARE = 48, 0.2  # differing bits of a match; share of the features that must agree
TABLES, WORD = 1, 24  # Hamming tables, and the bits of the descriptor that each one reads
NEIGHBOURS, OTHERS, REACH, CELL = 5, 3, 40, 6  # nearest corners, those of a constellation beside its centre, and pixels
ROUNDS, BLOCK = 3, 256  # rounds with first images; images of a block in the last step
ROWS = 512  # features whose distances to all others are held at once
SCALES = (1.0, 0.7)
HEADER = re.compile(rb"P([2356])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")
GREY = np.array([0.299, 0.587, 0.114], dtype=np.float32)


def decoded(data: bytes | None) -> np.ndarray | None:
    """The image in grey levels from 0 to 255; None where it can't be read."""
    try:
        return png(data) if data and data[:8] == b"\x89PNG\r\n\x1a\n" else portable(data or b"")
    except (ValueError, IndexError, zlib.error):
        return None


def portable(data: bytes) -> np.ndarray | None:
    found = HEADER.match(data)
    if not found:
        return None
    kind, (w, h, top) = found[1], map(int, found.groups()[1:])
    depth = 3 if kind in b"36" else 1
    if not (0 < top < 256 and w * h > 0):
        return None
    n = w * h * depth
    pixels = np.array(data[found.end() :].split()[:n], dtype=np.float32) if kind in b"23" else np.frombuffer(data, dtype=np.uint8, offset=found.end())[:n].astype(np.float32)
    if len(pixels) < n:
        return None
    return grey(pixels.reshape(h, w, depth)) * np.float32(255 / top)


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel of an array (height, width, channels): the last of two or four is opacity and is left out."""
    return pixels[:, :, :3] @ GREY if pixels.shape[2] >= 3 else pixels[:, :, 0]


def png(data: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:13]
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 3, 4, 6):
        return None
    w, h, depth = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)[: h * (w * depth + 1)].reshape(h, w * depth + 1)
    out = np.zeros((h, w * depth), dtype=np.uint8)
    above = np.zeros(w * depth, dtype=np.uint8)
    for y in range(h):
        above = out[y] = unfiltered(int(rows[y, 0]), rows[y, 1:], above, depth)
    pixels = out.reshape(h, w, depth)
    return grey((palette[pixels[:, :, 0]] if head[3] == 3 else pixels).astype(np.float32))


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    """A PNG row with its prediction added again: 0 none, 1 left, 2 above, 3 their mean, 4 the one of three nearest to left + above - corner."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.add.accumulate(row.reshape(-1, depth), axis=0, dtype=np.uint8).reshape(-1)
    line, up = [0] * depth + row.tolist(), [0] * depth + above.tolist()
    for i in range(depth, len(line)):
        a, b, c = line[i - depth], up[i], up[i - depth]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        line[i] = (line[i] + guess) & 255
    return np.array(line[depth:], dtype=np.uint8)


def encoded(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.clip(image, 0, 255).astype(np.uint8).tobytes()


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    h, w = max(1, int(a.shape[0] * scale)), max(1, int(a.shape[1] * scale))
    y, x = np.minimum(np.arange(h) / scale, a.shape[0] - 1), np.minimum(np.arange(w) / scale, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return a[y0][:, x0] * (1 - fy) * (1 - fx) + a[y1][:, x0] * fy * (1 - fx) + a[y0][:, x1] * (1 - fy) * fx + a[y1][:, x1] * fy * fx


def patterns() -> np.ndarray:
    """The test pairs for each turn: (TURNS, 256, 4) of integer offsets within RADIUS."""
    rng = np.random.default_rng(41)
    p = np.clip(rng.normal(0, RADIUS / 2, (256, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(a), -np.sin(a)], 1), np.stack([np.sin(a), np.cos(a)], 1)], 1)
    return np.rint(np.einsum("tij,pqj->tpqi", turn, p)).astype(int).reshape(TURNS, 256, 4)


PATTERNS = patterns()
DISC = [(dx, dy) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dx * dx + dy * dy <= RADIUS * RADIUS]
#: A table's word is the sum of odd numbers, one for each of its bits that is set: (256, TABLES), 0 where a table doesn't read.
WEIGHTS = np.zeros((256, TABLES), dtype=np.uint64)
for _k in range(TABLES):
    WEIGHTS[np.random.default_rng([43, _k]).permutation(256)[:WORD], _k] = np.random.default_rng([44, _k]).integers(0, 1 << 63, WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = np.random.default_rng(45).uniform(0, CELL, (TABLES, 2))  # of each table's cells
PLACE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "u1"), ("turn", "u1")])


def features(image: np.ndarray) -> tuple[bytes, bytes]:
    """The places, as items of PLACE in the image's own coordinates, and the bits of all features."""
    places, packed = [np.zeros(0, dtype=PLACE)], []
    for level, scale in enumerate(SCALES):
        a = resized(image, scale) if scale != 1 else image
        m = RADIUS + 1
        if min(a.shape) < 2 * m + 2:
            continue
        smooth = box(a, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = np.ones_like(r[1:-1, 1:-1], dtype=bool)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    peak &= r[1:-1, 1:-1] >= r[dy : dy + peak.shape[0], dx : dx + peak.shape[1]]
        ys, xs = np.nonzero(peak & (r[1:-1, 1:-1] > 1.0))
        ys, xs = ys + 1, xs + 1
        inside = (ys >= m) & (ys < a.shape[0] - m) & (xs >= m) & (xs < a.shape[1] - m)
        ys, xs = ys[inside], xs[inside]
        for start in range(0, len(ys), ROWS):
            y, x = ys[start : start + ROWS], xs[start : start + ROWS]
            dx, dy = np.array([d[0] for d in DISC]), np.array([d[1] for d in DISC])
            patch = smooth[y[:, None] + dy, x[:, None] + dx]
            patch = patch - patch.mean(1, keepdims=True)
            turn = np.rint(np.arctan2((patch * dy).sum(1), (patch * dx).sum(1)) / (2 * np.pi) * TURNS).astype(int) % TURNS
            p = PATTERNS[turn]
            bits = smooth[y[:, None] + p[:, :, 1], x[:, None] + p[:, :, 0]] + MARGIN < smooth[y[:, None] + p[:, :, 3], x[:, None] + p[:, :, 2]]
            packed.append(np.packbits(bits, axis=1).tobytes())
            place = np.zeros(len(x), dtype=PLACE)
            place["x"], place["y"], place["scale"], place["turn"] = x / scale, y / scale, level, turn
            places.append(place)
    return np.concatenate(places).tobytes(), b"".join(packed)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def constellations(places: bytes, bits: bytes) -> np.ndarray:
    """The keys of an image, in order."""
    place = np.frombuffer(places, dtype=PLACE)
    words = np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(-1, 32), axis=1).astype(np.uint64) @ WEIGHTS
    turn = np.exp(-2j * np.pi / TURNS * place["turn"])
    choices = np.array(list(combinations(range(NEIGHBOURS), OTHERS)))
    out = [np.zeros(0, dtype=np.uint64)]
    for level, scale in enumerate(SCALES):
        own = np.nonzero(place["scale"] == level)[0]
        z = (place["x"][own] + 1j * place["y"][own]) * scale
        for start in range(0, len(own) if len(own) > OTHERS else 0, ROWS):
            a = np.arange(start, min(len(own), start + ROWS))
            away = z[None, :] - z[a][:, None]
            far = np.abs(away)
            far[np.arange(len(a)), a] = np.inf
            near = np.argsort(far, axis=1, kind="stable")[:, :NEIGHBOURS]
            some = choices[(choices < near.shape[1]).all(1)]
            reached = np.take_along_axis(far, near, 1) <= REACH
            seen = np.take_along_axis(away, near, 1) * turn[own[a]][:, None]
            for t in range(TABLES):
                cx, cy = (np.floor((v + o) / CELL).astype(np.int64).astype(np.uint64) for v, o in ((seen.real, SHIFTS[t, 0]), (seen.imag, SHIFTS[t, 1])))
                beside = mixed(words[own[near], t] + mixed(cx * np.uint64(0xC2B2AE3D27D4EB4F) + cy + np.uint64(t)))
                together = mixed(mixed(words[own[a], t])[:, None] + beside[:, some].sum(2, dtype=np.uint64))
                out.append(together[reached[:, some].all(2)])
    return np.unique(np.concatenate(out))


def described(images: DataFrame) -> DataFrame:
    """(node, places, bits, keys) of each image of images (node, image)."""

    def run(frames):
        for frame in frames:
            rows = []
            for data in frame.column(1).to_pylist():
                image = decoded(data)
                places, bits = features(image) if image is not None else (b"", b"")
                rows.append((places, bits, constellations(places, bits).view(np.int64)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([frame.column(0), *columns], names=["node", "places", "bits", "keys"])

    return images.mapInArrow(run, "node long, places binary, bits binary, keys array<long>")


def agreeing(places_a: bytes, bits_a: bytes, places_b: bytes, bits_b: bytes, least: float = LEAST) -> int:
    """The most mutual matches that agree on one similarity transform, each match being tried as the transform; 0 where there are fewer than least matches."""
    a, b = (np.frombuffer(x, dtype=np.uint64).reshape(-1, 4) for x in (bits_a, bits_b))
    if not len(a) or not len(b):
        return 0
    best, least_far = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.uint16)
    back, back_far = np.zeros(len(b), dtype=np.int64), np.full(len(b), 999, dtype=np.uint16)
    for start in range(0, len(a), ROWS):
        far = np.zeros((len(a[start : start + ROWS]), len(b)), dtype=np.uint16)
        for w in range(4):
            far += np.bitwise_count(a[start : start + ROWS, None, w] ^ b[None, :, w])
        best[start : start + ROWS], least_far[start : start + ROWS] = far.argmin(1), far.min(1)
        better = far.min(0) < back_far
        back[better], back_far[better] = far.argmin(0)[better] + start, far.min(0)[better]
    k = np.nonzero((back[best] == np.arange(len(a))) & (least_far <= NEAR))[0]
    if len(k) < least:
        return 0
    pa_, pb = np.frombuffer(places_a, dtype=PLACE)[k], np.frombuffer(places_b, dtype=PLACE)[best[k]]
    scales = np.array(SCALES)
    scale, turn = scales[pa_["scale"]] / scales[pb["scale"]], (pb["turn"].astype(float) - pa_["turn"]) * (2 * np.pi / TURNS)
    za, zb = pa_["x"].astype(float) + 1j * pa_["y"], pb["x"].astype(float) + 1j * pb["y"]
    move, most = scale * np.exp(1j * turn), 0
    for start in range(0, len(k), ROWS):
        s = slice(start, start + ROWS)
        off = np.abs(zb[None, :] - zb[s, None] - move[s, None] * (za[None, :] - za[s, None]))
        same_turn = np.abs((turn[None, :] - turn[s, None] + np.pi) % (2 * np.pi) - np.pi) < 0.45
        most = max(most, int((same_turn & (off < 4)).sum(1).max()))
    return most


def are_copies(places_a: bytes, bits_a: bytes, places_b: bytes, bits_b: bytes) -> bool:
    least = max(LEAST, SHARE * min(len(bits_a), len(bits_b)) / 32)
    return agreeing(places_a, bits_a, places_b, bits_b, least) >= least


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are copies."""
    side = lambda k: found.select(F.col("node").alias(k), F.col("places").alias("p" + k), F.col("bits").alias("b" + k))

    def run(frames):
        for frame in frames:
            a, b, *shown = (frame.column(k).to_pylist() for k in range(6))
            good = pa.array([are_copies(*x) for x in zip(*shown, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1)], names=["a", "b"]).filter(good)

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "ba", "pb", "bb")
    return both.mapInArrow(run, "a long, b long")


def in_several(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the keys of three images or more that lie in several classes: of two both were compared."""
    placed = entries.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi AND n > 2").select("key", "n")
    return looked_up(placed, apart, ["key"])


def links_of(found: DataFrame) -> DataFrame:
    """(a, b) that join the classes of all pairs of copies that share a key."""
    every = found.select("node", F.explode("keys").alias("key"))
    first = written(every.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    entries = written(looked_up(every, first, ["key"]))  # of keys that several images share
    dropped(first)
    pairs = written(entries.filter("node != a").select("a", F.col("node").alias("b")).distinct())
    links = written(verified(pairs, found))
    roots = components(links)
    left = written(in_several(entries.select("node", "key"), roots))
    for turn in range(1, ROUNDS):
        if not left.limit(1).count():
            return links
        leader = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("x"), F.count("*").alias("n"))
        met = looked_up(left, leader, ["key"]).filter(F.col("root") != F.col("x.root")).select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()
        met = written(met.join(pairs, ["a", "b"], "left_anti"))
        links, pairs = links.union(written(verified(met, found))), pairs.union(met)
        roots = components(links)
        left = written(in_several(left.select("node", "key"), roots))
    return links.union(compared(left, found))


def compared(left: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between classes, from the comparison of all images of a key that lie in different ones.

    A key's images are cut by hash into blocks of about BLOCK, and each two blocks are
    compared in a task of their own, which gives one link for each two classes it joins.
    """
    size = left.groupBy("key").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = looked_up(left, size, ["key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root").join(found.select("node", "places", "bits"), "node")

    def run(table: pa.Table) -> pa.Table:
        own, node, root, places, bits = (table.column(c).to_pylist() for c in ("own", "node", "root", "places", "bits"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        links = {}
        for i in range(len(node)):
            for j in range(i) if lo == hi else (j for j in range(len(node)) if own[i] < own[j]):
                classes = min(root[i], root[j]), max(root[i], root[j])
                if root[i] != root[j] and classes not in links and are_copies(places[i], bits[i], places[j], bits[j]):
                    links[classes] = node[i], node[j]
        return pa.table({"a": pa.array([x[0] for x in links.values()], pa.int64()), "b": pa.array([x[1] for x in links.values()], pa.int64())})

    return sides.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


def image_classes(images: DataFrame, img: str = "img", image: str = "image") -> DataFrame:
    """(img, n_features, class_id) of each row; class_id: the smallest id of all rows whose picture is in its class."""
    data = F.col(f"`{image}`")
    rows = images.select(F.col(f"`{img}`").cast("long").alias("img"), F.when(data.isNotNull(), F.xxhash64(data)).alias("node"), data.alias("image"))
    ids = written(rows.select("img", "node"))
    distinct = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("image").alias("image"))
    found = written(described(distinct.repartition(shuffle_parts(images.sparkSession), "node")))
    roots = components(links_of(found))
    heads = ids.filter("node IS NOT NULL").groupBy("node").agg(F.min("img").alias("head"), F.count("*").alias("n"))
    placed = heads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("head").alias("class_id"))
    shown = found.select("node", (F.octet_length("bits") / 32).cast("long").alias("n_features"))
    classes = written(placed.join(least, "root").join(shown, "node").select("node", "n", "n_features", "class_id"))
    nulls = ids.filter("node IS NULL").select("img", F.lit(0).cast("long").alias("n_features"), F.col("img").alias("class_id"))
    return looked_up(ids, classes, ["node"]).select("img", "n_features", "class_id").union(nulls)


def scene(seed: int, size: int = 64) -> np.ndarray:
    """A drawn picture: rectangles and discs of seeded places and greys."""
    rng = np.random.default_rng(seed % (1 << 63))
    image = np.full((size, size), float(rng.integers(90, 160)), dtype=np.float32)
    yy, xx = np.mgrid[:size, :size]
    for _ in range(16):
        x, y, grey = rng.integers(0, size, 2), rng.integers(0, size, 2), float(rng.integers(0, 256))
        if rng.random() < 0.7:
            image[min(y) : max(y) + 2, min(x) : max(x) + 2] = grey
        else:
            image[(yy - y[0]) ** 2 + (xx - x[0]) ** 2 < rng.integers(9, 160)] = grey
    return image


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A crop of at least 3/4 of each side, brighter or darker, with a little noise."""
    rng = np.random.default_rng(seed % (1 << 63))
    top, left = rng.integers(0, image.shape[0] // 8, 2)
    cut = image[top : image.shape[0] - rng.integers(0, 8), left : image.shape[1] - rng.integers(0, 8)]
    return np.clip(cut * rng.uniform(0.8, 1.1) + rng.uniform(-12, 12) + rng.normal(0, 1.5, cut.shape), 0, 255)


def pictures(vectors: DataFrame, every: int = 10) -> DataFrame:
    """(img, image): a picture for each vector, seeded by its content. Each every-th row shows an edited copy of the picture before it.

    The tables hold no media; this gives the operator a column to work on with known copies.
    """
    hashed = vectors.select(F.col("vec_id").alias("img"), F.xxhash64("embedding").alias("seed"))
    before = hashed.select((F.col("img") + 1).alias("after"), F.col("seed").alias("earlier"))
    odd = F.pmod("img", F.lit(every)) == every - 1
    both = hashed.join(before, hashed["img"] == before["after"], "left").select("img", F.when(odd, F.coalesce("earlier", "seed")).otherwise(F.col("seed")).alias("seed"), (odd & F.col("earlier").isNotNull()).alias("edit"))

    def run(frames):
        for frame in frames:
            ids, seeds, edits = (frame.column(k).to_pylist() for k in range(3))
            out = [encoded(edited(scene(s), i or 0) if e else scene(s)) for i, s, e in zip(ids, seeds, edits, strict=True)]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(out, pa.binary())], names=["img", "image"])

    # The join is small and may have become one partition; drawing is the work.
    return both.repartition(4 * shuffle_parts(vectors.sparkSession), "img").mapInArrow(run, "img long, image binary")
