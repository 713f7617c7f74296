"""Alternative routes over a contraction hierarchy: via nodes that both climbs meet, judged by length, overlap and local optimality."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How much longer an alternative may be, how much it may share, how far it must be a shortest way, how many there are.
MOST_LONGER, MOST_SHARED, OPTIMAL, MOST_PATHS = 1.25, 0.8, 0.25, 3
SCHEMA = "request long, rank int, weight double, distance_mm long, share double, nodes array<long>"


class Hierarchy:
    """Arcs (base, adj, weight, via, level, level_adj) in memory, with the length of each arc that is no shortcut."""

    def __init__(self, rows, lengths: dict):
        self.arcs, self.up, self.down = {}, {}, {}
        for base, adj, weight, via, level, level_adj in sorted(rows, key=lambda r: r[:3]):
            self.arcs[base, adj] = (weight, via)
            if level < level_adj:
                self.up.setdefault(base, []).append((adj, weight))
            else:
                self.down.setdefault(adj, []).append((base, weight))
        self.lengths = lengths

    def climb(self, lists: dict, start, limit: float = math.inf) -> dict:
        """node -> (weight, the node before) for what is reached by climbing alone."""
        heap, done = [(0, start, None)], {}
        while heap:
            w, node, before = heapq.heappop(heap)
            if node not in done and w <= limit:
                done[node] = (w, before)
                for adj, more in lists.get(node, ()):
                    if adj not in done:
                        heapq.heappush(heap, (w + more, adj, node))
        return done

    def unpacked(self, base, adj) -> list:
        """The nodes an arc stands for, without its last. A stack, as arcs nest deeply."""
        out, todo = [], [(base, adj)]
        while todo:
            a, b = todo.pop()
            via = self.arcs[a, b][1]
            if via is None:
                out.append(a)
            else:
                todo += [(via, b), (a, via)]
        return out

    def through(self, ahead: dict, back: dict, meet) -> list:
        """The nodes of the way that both climbs make through a node."""
        chain, at = [meet], meet
        while ahead[at][1] is not None:
            at = ahead[at][1]
            chain.append(at)
        chain.reverse()
        at = meet
        while back[at][1] is not None:
            at = back[at][1]
            chain.append(at)
        return [n for a, b in pairwise(chain) for n in self.unpacked(a, b)] + [chain[-1]]

    def route(self, s, t) -> tuple:
        ahead, back = self.climb(self.up, s), self.climb(self.down, t)
        w, meet = min(((ahead[n][0] + back[n][0], n) for n in ahead if n in back), default=(math.inf, None))
        return (w, self.through(ahead, back, meet)) if meet is not None else (w, [])

    def steps(self, nodes: list) -> list:
        return [self.lengths[a, b] for a, b in pairwise(nodes)]

    def shared(self, nodes: list, of: set) -> int:
        """The length of the steps that have both ends in a set of nodes."""
        return sum(d for (a, b), d in zip(pairwise(nodes), self.steps(nodes), strict=True) if a in of and b in of)

    def alternatives(self, s, t, most_longer=MOST_LONGER, most_shared=MOST_SHARED, optimal=OPTIMAL, most_paths=MOST_PATHS) -> list:
        """(weight, nodes, share) of up to most_paths ways, the shortest first; none where t can't be reached. Ties of candidates go to the smaller via node."""
        best, shortest = self.route(s, t)
        if not shortest:
            return []
        found, seen, first = [(best, shortest, 0.0)], set(shortest), set(shortest)
        whole = sum(self.steps(shortest))
        limit = best * most_longer
        ahead, back = self.climb(self.up, s, limit), self.climb(self.down, t, limit)
        share = lambda nodes: self.shared(nodes, seen) / (sum(self.steps(nodes)) or math.inf)
        candidates = []
        for v in ahead:
            if v in back and (w := ahead[v][0] + back[v][0]) <= limit:
                overlap = share(self.through(ahead, back, v))
                if overlap <= most_shared:
                    candidates.append((2 * w + overlap, v))
        for _, v in sorted(candidates):
            if len(found) >= most_paths:
                break
            (w1, head), (w2, tail) = self.route(s, v), self.route(v, t)
            nodes = head + tail[1:]
            same = self.shared(nodes, first)
            detour = sum(self.steps(nodes)) - same
            overlap = share(nodes)
            if detour <= (whole - same) * most_longer and overlap <= most_shared and self.locally_shortest(nodes, len(head) - 1, optimal * detour / 2):
                found.append((w1 + w2, nodes, overlap))
                seen |= set(nodes)
        return found

    def locally_shortest(self, nodes: list, v: int, reach: float) -> bool:
        """Whether the shortest way from reach before a way's node v to reach behind it leads through v."""
        if len(nodes) < 2:
            return True
        at = list(accumulate(self.steps(nodes), initial=0))
        start = max(bisect_right(at, at[v] - reach) - 1, 0)
        # The last node is never the end of the tested part, unless it is v.
        end = max(min(bisect_left(at, at[v] + reach), len(nodes) - 2), v)
        return nodes[v] in self.route(nodes[start], nodes[end])[1]


def alternative_routes(requests: DataFrame, ch_arcs: DataFrame, arcs: DataFrame, weight: str = "millis", most_arcs: int = 2_000_000, **limits) -> DataFrame:
    """(request, rank, weight, distance_mm, share, nodes) for requests (request, source, target), over the hierarchy of a graph (edge_key, base, adj, weight, distance_mm). Its size is checked before it is sent to the tasks."""
    if ch_arcs.count() > most_arcs:
        raise ValueError("the hierarchy is too large to be sent to the tasks")
    rows = [tuple(r) for r in ch_arcs.select("base", "adj", "weight", "via", "level", "level_adj").collect()]
    cheapest = arcs.groupBy("base", "adj").agg(F.min(F.struct(F.col(weight), "edge_key", "distance_mm")).alias("x"))
    lengths = {(r[0], r[1]): r[2] for r in cheapest.select("base", "adj", "x.distance_mm").collect()}
    sent = requests.sparkSession.sparkContext.broadcast((rows, lengths))

    def run(frames):
        graph = Hierarchy(*sent.value)
        for frame in frames:
            out = []
            for request, s, t in zip(frame["request"], frame["source"], frame["target"], strict=True):
                for rank, (w, nodes, share) in enumerate(graph.alternatives(s, t, **limits)):
                    out.append((request, rank, float(w), sum(graph.steps(nodes)), share, nodes))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return requests.select("request", F.col("source").cast("long"), F.col("target").cast("long")).mapInPandas(run, SCHEMA)
