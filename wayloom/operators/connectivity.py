"""Strongly connected components and subnetwork marks, by joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.paths import cut


def _reached(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label that reaches each node along links (a to b)."""
    while True:
        moved = links.join(labels, links["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        new = cut(labels.union(moved).groupBy("node").agg(F.min("label").alias("label")))
        # A node that is reached for the first time has no old label.
        if not new.join(labels.withColumnRenamed("label", "old"), "node", "left").filter("old IS NULL OR label <> old").limit(1).count():
            return new
        labels = new


def strong_components(links: DataFrame, nodes: DataFrame, kernel_links: int = 500_000) -> DataFrame:
    """(node, component): component is its smallest node. Small graphs are solved in memory, after a check of their size."""
    few = links.select("a", "b").limit(kernel_links + 1).collect()
    if len(few) > kernel_links or nodes.limit(kernel_links + 1).count() > kernel_links:
        return components_by_colours(links, nodes)
    return nodes.sparkSession.createDataFrame(_tarjan([tuple(r) for r in few], [r[0] for r in nodes.select("node").collect()]), "node long, component long")


def _tarjan(links: list, nodes: list) -> list:
    out: dict = {n: [] for n in nodes}
    for a, b in links:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, on, stack, found = {}, {}, set(), [], []
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, left = work[-1]
            for nxt in left:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = []
                    while True:
                        own.append(stack.pop())
                        on.discard(own[-1])
                        if own[-1] == node:
                            break
                    found += [(n, min(own)) for n in own]
    return found


def _solved(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of links, in one task."""

    def run(frames):
        found = _tarjan([pair for f in frames for pair in zip(f["a"].tolist(), f["b"].tolist(), strict=True)], [])
        yield pd.DataFrame(found, columns=["node", "component"], dtype="int64")

    return links.coalesce(1).mapInPandas(run, "node long, component long")


def components_by_colours(links: DataFrame, nodes: DataFrame, kernel_links: int = 500_000) -> DataFrame:
    """strong_components for graphs of any size: colouring from front and back.

    A link whose start has no link in or whose end has none out lies in no circle;
    such links are trimmed first, as often as that finds any. At most kernel_links
    that are left are solved in one task. Of more, each round gives every open node
    the smallest node that reaches it, and closes those that reach their label again;
    what is left goes on. Nodes in no circle are components of their own.
    """
    nodes = cut(nodes.select(F.col("node").cast("long")))
    links = cut(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    before, left = -1, links.count()
    while left > kernel_links and left != before:
        entered, quit_ = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
        links = cut(links.join(entered, "a", "left_semi").join(quit_, "b", "left_semi"))
        before, left = left, links.count()
    links = cut(links.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi"))
    done = _solved(links) if left <= kernel_links else _coloured(links)
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _coloured(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of links, by rounds of joins."""
    open_, done = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct()), None
    while open_.limit(1).count():
        colour = _reached(links, open_.select("node", F.col("node").alias("label")))
        ca, cb = colour.select(F.col("node").alias("a"), F.col("label").alias("la")), colour.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        inside = cut(links.join(ca, "a").join(cb, "b").filter("la = lb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = colour.filter("node = label")
        back = _reached(inside, roots).join(colour.select("node", F.col("label").alias("own")), "node").filter("label = own").select("node", F.col("label").alias("component"))
        back = cut(back)
        done = back if done is None else done.union(back)
        open_ = cut(open_.join(back, "node", "left_anti"))
        links = cut(links.join(open_.withColumnRenamed("node", "a"), "a", "left_semi").join(open_.withColumnRenamed("node", "b"), "b", "left_semi"))
    return done if done is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def arc_links(arcs: DataFrame, u_turns: bool = True) -> DataFrame:
    """(a, b): which arc may follow which, as edge keys."""
    x, y = arcs.select(F.col("edge_key").alias("a"), F.col("adj").alias("via")), arcs.select(F.col("edge_key").alias("b"), F.col("base").alias("via"))
    out = x.join(y, "via").select("a", "b")
    return out if u_turns else out.filter("shiftright(a, 1) <> shiftright(b, 1)")


def subnetworks(arcs: DataFrame, least: int = 200, blocked: DataFrame | None = None, most: float = 0.5) -> DataFrame:
    """(edge_key, component, size, subnetwork): arcs in components of fewer than twice least arcs are flagged, the largest component never.

    Arcs of blocked (edge_key) take no part and have no row. More than the share most of all arcs flagged is an error.
    """
    if blocked is not None:
        arcs = arcs.join(blocked.select("edge_key"), "edge_key", "left_anti")
    arcs = cut(arcs)
    found = strong_components(arc_links(arcs), arcs.select(F.col("edge_key").alias("node"))).withColumnRenamed("node", "edge_key")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("x")).select((-F.col("x.c")).alias("largest"))
    marked = cut(found.join(sizes, "component").crossJoin(F.broadcast(largest)).select("edge_key", "component", "size", ((F.col("size") < 2 * least) & (F.col("component") != F.col("largest")) | (F.col("size") == 1)).alias("subnetwork")))
    flagged, every = marked.agg(F.coalesce(F.sum(F.col("subnetwork").cast("int")), F.lit(0)), F.count("*")).first()
    if flagged > most * every:
        raise ValueError(f"{flagged} of {every} arcs would be subnetworks")
    return marked
