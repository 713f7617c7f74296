"""Contraction hierarchies: shortcuts that let searches climb only, as tables.

Nodes are contracted one after the other; where the shortest way between two
neighbours leads through the contracted node, a shortcut replaces it. A way then
exists that first climbs in rank and then descends, so a query joins what climbs
from the source with what climbs, backwards, from the target.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.paths import cut, distances



class Contraction:
    """A graph in memory that is contracted node by node; the cheapest arc of each pair of nodes counts."""

    def __init__(self, rows):
        self.out: dict = {}
        self.into: dict = {}
        self.arcs: dict = {}  # (base, adj) -> (weight, via node or None, edge key)
        self.shortcuts: dict = {}  # (base, adj) -> (weight, via node, the edges it stands for)
        self.edge: dict = {}  # (base, adj) -> what edge or shortcut the arc belongs to
        self.level: dict = {}
        for key, base, adj, weight in sorted(rows):
            if base != adj:
                self.add(base, adj, weight, None, key)
            for n in (base, adj):
                self.out.setdefault(n, set())
                self.into.setdefault(n, set())

    def add(self, base, adj, weight, via, key=-1):
        if (base, adj) not in self.arcs or weight < self.arcs[base, adj][0]:
            self.arcs[base, adj] = (weight, via, key)
            self.edge[base, adj] = key >> 1
            self.out.setdefault(base, set()).add(adj)
            self.into.setdefault(adj, set()).add(base)

    def witness(self, start, without, limit) -> dict:
        """Weights up to limit from start to uncontracted nodes, not through the node left out."""
        heap, known = [(0, start)], {}
        while heap:
            g, node = heapq.heappop(heap)
            if node in known:
                continue
            known[node] = g
            for adj in self.out[node]:
                w = g + self.arcs[node, adj][0]
                if adj != without and adj not in known and adj not in self.level and w <= limit:
                    heapq.heappush(heap, (w, adj))
        return known

    def needed(self, node) -> list:
        """(base, adj, weight) of the shortcuts that contracting the node needs."""
        sources = [a for a in self.into[node] if a not in self.level]
        targets = [c for c in self.out[node] if c not in self.level]
        found = []
        for a in sources:
            ways = {c: self.arcs[a, node][0] + self.arcs[node, c][0] for c in targets if c != a}
            if ways:
                other = self.witness(a, node, max(ways.values()))
                found += [(a, c, w) for c, w in ways.items() if other.get(c, math.inf) > w]
        return found

    def contract(self, node):
        for a, c, w in self.needed(node):
            parts = self.edge[a, node], self.edge[node, c]
            self.add(a, c, w, node)
            twin = self.shortcuts.get((c, a))
            # The way back over the same edges is the same shortcut.
            self.edge[a, c] = self.edge[c, a] if twin == (w, node, parts[::-1]) else ("shortcut", len(self.shortcuts), a, c)
            self.shortcuts[a, c] = (w, node, parts)
        self.level[node] = len(self.level)

    def priority(self, node) -> int:
        found = self.needed(node)
        degree = sum(x not in self.level for x in self.out[node]) + sum(x not in self.level for x in self.into[node])
        return 10 * (len(found) - degree) + len(found)

    def contract_all(self, order=None):
        if order is not None:
            for node in order:
                self.contract(node)
        heap = [(self.priority(n), n) for n in sorted(self.out) if n not in self.level]
        heapq.heapify(heap)
        while heap:  # a node whose priority has grown is put back
            _, node = heapq.heappop(heap)
            now = self.priority(node)
            if heap and now > heap[0][0]:
                heapq.heappush(heap, (now, node))
            else:
                self.contract(node)

    def count(self) -> int:
        """Shortcuts; one that stands for the same edges in both directions counts once."""
        return len({self.edge[k] for k in self.shortcuts})

    def unpacked(self, base, adj) -> list:
        """The nodes of the way that an arc stands for, without its last."""
        via = self.arcs[base, adj][1]
        return [base] if via is None else self.unpacked(base, via) + self.unpacked(via, adj)


def prepared(arcs: DataFrame, weight: str = "millis", order: list | None = None, most_arcs: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(levels, ch_arcs) of a graph (edge_key, base, adj, weight). One task contracts it in memory; larger graphs are refused."""
    light = arcs.select("edge_key", "base", "adj", F.col(weight).cast("long").alias("w"))
    if light.count() > most_arcs:
        raise ValueError("the graph is too large to be contracted in one task")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = Contraction(rows.drop(columns="one").itertuples(index=False, name=None))
        graph.contract_all(order)
        out = [("arc", a, c, w, via, key, graph.level[a], graph.level[c]) for (a, c), (w, via, key) in graph.arcs.items()]
        out += [("node", n, None, None, None, None, x, None) for n, x in graph.level.items()]
        return pd.DataFrame(out, columns=["kind", "base", "adj", "weight", "via", "edge_key", "level", "level_adj"]).astype({c: "Int64" for c in ("base", "adj", "weight", "via", "edge_key", "level", "level_adj")})

    schema = "kind string, base long, adj long, weight long, via long, edge_key long, level long, level_adj long"
    both = cut(light.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, schema))
    return both.filter("kind = 'node'").select(F.col("base").alias("node"), "level"), both.filter("kind = 'arc'").select("base", "adj", "weight", "via", "edge_key", "level", "level_adj")


def ch_distances(ch_arcs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, node, weight) for sources and targets (node): both climb, and the best meeting node counts."""
    up = ch_arcs.filter("level < level_adj").select("edge_key", "base", "adj", F.col("weight").alias("millis"))
    down = ch_arcs.filter("level > level_adj").select("edge_key", F.col("adj").alias("base"), F.col("base").alias("adj"), F.col("weight").alias("millis"))
    ahead = distances(up, sources).select("source", F.col("node").alias("meet"), F.col("weight").alias("w1"))
    back = distances(down, targets).select(F.col("source").alias("node"), F.col("node").alias("meet"), F.col("weight").alias("w2"))
    return ahead.join(back, "meet").groupBy("source", "node").agg(F.min(F.col("w1") + F.col("w2")).alias("weight"))
