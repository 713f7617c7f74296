"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a seeded hash. A source that shall give
r times its words gives all of its blocks floor(r) times, and once more its
first blocks in a permuted order until the rest of its words is reached; of the
block in which that happens those documents that fit are taken. So a source's
words are met to about one small document.

The block draws of all sources are dealt out to the output shards by a tree: a
node splits its shards in two halves, and its draws by one multivariate-
hypergeometric draw with the left half's exact share. Each leaf then has exact
quotas by source and takes the next permuted blocks: no draw is in two shards.
Each epoch goes through a source's blocks in a permutation of its own. Inside a
shard the documents are put into a seeded random order.

On the driver: one row a source (words, blocks), never one a document or block;
that is for up to some 100,000 sources, so a column of hosts or addresses should
be grouped first. Tables of sources and blocks are joined without a broadcast
hint, so that they are only broadcast where their size allows it.

Cases: a null source is a source of its own, ordered last; null and blank texts
have size 0 and go with their block; sources without words have target 0 and
give nothing. Repeated rows share a block and are drawn alike. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of, written

MOST_COPIES = 3
WEIGHTS = (5, 2, 1)


def targets(sizes: dict, weights=WEIGHTS, most: int = MOST_COPIES) -> dict:
    """Words wanted of each source: shares of all words by weight, none above most times the source's own words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        each = left / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if each * weight[s] > most * sizes[s]]
        if not over:
            return {s: float(capped[s]) if s in capped else each * weight[s] for s in names}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas dealt out to shards: one row a shard, whose sums are at most one apart; columns sum to quotas."""
    total = int(quotas.sum())
    room = np.array([total // shards + (i < total % shards) for i in range(shards)])
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def deal(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left, want = np.zeros_like(have), int(room[lo:mid].sum())
        rest = int(have.sum())
        for i, n in enumerate(have):  # source by source: the marginals of the multivariate draw
            rest -= int(n)
            left[i] = rng.hypergeometric(int(n), rest, want) if n and want and rest else min(int(n), want)
            want -= int(left[i])
        deal(lo, mid, left)
        deal(mid, hi, have - left)

    deal(0, shards, quotas.astype(np.int64))
    return out


def chosen(block):
    """The documents of a source's last block that fit into what is left, in hash order; one more where that is nearer."""
    block = block.sort_values("·h")
    room, taken, left = int(block["room"].iloc[0]), [], []
    for h, size in zip(block["·h"], block["size"], strict=True):
        if size <= room:
            taken.append(h)
            room -= size
        else:
            left.append((size, h))
    if left and min(left)[0] - room < room:
        taken.append(min(left)[1])
    out = block[["·s", "·b"]].head(1).copy()
    out["cut"] = [taken]
    return out


def drawn(docs: DataFrame, source: str = "source", text: str = "text", shards: int = 8, seed: int = 23, rows_a_block: int = 256) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_shards: the output shard of each copy of the document."""
    spark = docs.sparkSession
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_shards")
    size = F.size(words_of(F.col(f"`{text}`"))).cast("long")
    content = [F.col(f"`{f.name}`") for f in docs.schema.fields]
    mixed: Column = F.xxhash64(F.lit(seed), *content)
    hashed = docs.select("*", size.alias("mix_size"), mixed.alias("·h"))
    rows = docs.count()
    bits = min(16, max(1, math.ceil(math.log2(max(1, rows / rows_a_block)))))
    block = F.shiftrightunsigned("·h", 64 - bits)
    light = written(hashed.select(F.col(f"`{source}`").alias("·s"), "mix_size", "·h", block.alias("·b")))
    blocks = light.groupBy("·s", "·b").agg(F.sum("mix_size").alias("w"))
    found = {r[0]: (r[1], r[2]) for r in blocks.groupBy("·s").agg(F.sum("w"), F.count("*")).collect()}
    want = targets({s: w for s, (w, _) in found.items()})
    plan = []
    for s, (w, n) in sorted(found.items(), key=lambda x: (x[0] is None, x[0] or "")):  # the tree's draws depend on this order
        ratio = want[s] / w if w else 0.0
        epochs = min(MOST_COPIES, int(ratio + 1e-12))
        plan.append((s, w, want[s], n, epochs, int(round(want[s] - epochs * w)) if w else 0))
    schema = f"`·s` {docs.schema[source].dataType.simpleString()}, w_all long, want double, n long, epochs int, rest long"
    by_source = spark.createDataFrame(plan, schema)
    permuted = lambda e: Window.partitionBy("·s").orderBy(F.xxhash64(F.lit(seed + 1), F.lit(e), "·b"), "·b")
    ordered = permuted(MOST_COPIES)  # of the last, partial epoch
    cum = F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    ranked = blocks.withColumn("before", F.coalesce(cum, F.lit(0))).withColumn("rank", F.row_number().over(ordered) - 1)
    ranked = ranked.withColumn("places", F.array(*[F.row_number().over(permuted(e)) - 1 for e in range(MOST_COPIES)]))
    null_safe = lambda a, b: a["·s"].eqNullSafe(b["·s"])
    known = ranked.join(by_source, null_safe(ranked, by_source)).select(ranked["·s"], "·b", "w", "before", "rank", "places", "w_all", "want", "n", "epochs", "rest")
    known = written(known)
    edge = known.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("w") > F.col("rest"))).select("·s", "·b", "before", "rest")
    inner = light.join(edge, light["·s"].eqNullSafe(edge["·s"]) & (light["·b"] == edge["·b"])).groupBy(edge["·s"], edge["·b"], "·h").agg(F.sum("mix_size").alias("size"), F.first(F.col("rest") - F.col("before")).alias("room"))
    kind = docs.schema[source].dataType.simpleString()
    cuts = inner.groupBy("·s", "·b").applyInPandas(chosen, f"`·s` {kind}, `·b` long, cut array<long>")  # one block a source
    state = known.join(cuts, known["·s"].eqNullSafe(cuts["·s"]) & (known["·b"] == cuts["·b"]), "left").select(known["*"], F.col("cut").alias("·cut"))
    inside = F.col("before") + F.col("w") <= F.col("rest")
    split_here = (F.col("before") < F.col("rest")) & ~inside
    state = state.withColumn("full", inside & (F.col("rest") > 0)).withColumn("part", F.col("full") | split_here)
    partial = {r[0]: r[1] for r in state.groupBy("·s").agg(F.sum(F.col("part").cast("long"))).collect()}
    quotas = np.array([n * epochs + (partial.get(s) or 0) for s, _, _, n, epochs, _ in plan], dtype=np.int64)
    ends = np.cumsum(split(quotas, shards, seed), axis=0).T if len(plan) else np.zeros((0, shards), dtype=np.int64)
    dealt = spark.createDataFrame([(p[0], [int(x) for x in e]) for p, e in zip(plan, ends, strict=True)], schema.split(",")[0] + ", ends array<long>")
    # Draw number e * n + place: epoch e goes through the blocks in its own order; the last, partial one in the order of rank.
    state = state.join(dealt, state["·s"].eqNullSafe(dealt["·s"])).select(state["*"], "ends")
    shard_of = lambda d: F.size(F.filter(F.col("ends"), lambda e: e <= d))
    draws = F.concat(
        F.transform(F.filter(F.array(*[F.lit(e) for e in range(MOST_COPIES)]), lambda e: e < F.col("epochs")), lambda e: shard_of(e * F.col("n") + F.get("places", e))),
        F.when(F.col("part"), F.array(shard_of(F.col("epochs") * F.col("n") + F.col("rank")))).otherwise(F.array().cast("array<int>")),
    )
    table = state.select(F.col("·s").alias("·s2"), F.col("·b").alias("·b2"), "w_all", "want", "full", "·cut", "epochs", draws.alias("·d"))
    joined = hashed.withColumn("·b", block).join(table, F.col(f"`{source}`").eqNullSafe(F.col("·s2")) & (F.col("·b") == F.col("·b2")))
    taken = F.when(F.col("full") | F.coalesce(F.array_contains("·cut", F.col("·h")), F.lit(False)), F.col("·d")).otherwise(F.slice("·d", 1, F.col("epochs")))
    return joined.select(*content, "mix_size", F.col("w_all").alias("mix_source_size"), F.col("want").alias("mix_target"), taken.alias("mix_shards"), F.col("·h").alias("mix_key"))


def mixture(docs: DataFrame, seed: int = 23, **options) -> DataFrame:
    """The mixed corpus: each document once for each of its copies, with mix_shard and the seeded random mix_place in it."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    copies = drawn(docs, seed=seed, **options).select(*names, F.posexplode("mix_shards").alias("mix_copy", "mix_shard"), "mix_key")
    return copies.withColumn("mix_place", F.xxhash64(F.lit(seed + 2), "mix_key", "mix_copy")).drop("mix_key", "mix_copy")
