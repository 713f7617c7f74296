"""Connected components of a link table, by min labels and pointer jumping.

A table of up to at_once links is solved by one task, larger ones in rounds of joins,
each of which is several jobs that the driver plans and remembers.

Cases: repeated links, links from a node to itself and links in both directions
count once; an empty table gives an empty result; nulls aren't nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, sorted, and the smallest node that each one reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        for side in (x, y):
            np.minimum.at(root, root[side], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def solved(links: DataFrame) -> DataFrame:
    """components() of links of long nodes, in one task that holds them all."""

    def run(table: pa.Table) -> pa.Table:
        nodes, root = roots_of(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64())})

    return links.coalesce(1).groupBy().applyInArrow(run, "node long, root long")


def components(links: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) for each node in links (a, b): root is the smallest node reachable.

    at_once needs nodes of type long, and links, which are then read twice, from a table.

    A round takes the smallest label among a node and its neighbours, then that
    label's own label, so the rounds are logarithmic in the diameter. Hubs only
    meet aggregations with a map-side part and joins that Spark may split.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    if at_once and links.count() <= at_once:
        return written(solved(links.select("a", "b")))
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        best = labels.union(near).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("·n"), F.col("root").alias("·r"))
        new = written(best.join(up, best["root"] == up["·n"]).select("node", F.least("root", "·r").alias("root")))
        old = labels.withColumnRenamed("root", "·old")
        changed = new.join(old, "node").filter(F.col("root") != F.col("·old")).limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            dropped(edges)
            return labels
