"""Shortest paths: relational rounds for many sources, and Arrow-batched kernels for single requests.

Ties are broken alike in both: the smaller weight, then the smaller edge key.
"""

from __future__ import annotations

import heapq
import math
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names. Only a local master, as in tests, may go without one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="wayloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def distances(arcs: DataFrame, sources: DataFrame, most_rounds: int = 10_000, weight: str = "millis", kernel_arcs: int = 1_000_000) -> DataFrame:
    """(source, node, weight, hops, edge_key): the shortest way from each source to each node it reaches.

    A graph of at most kernel_arcs arcs is sent to the tasks, which search from
    their sources in memory. A larger one is searched in rounds of joins: a round
    relaxes only what the last one improved, and the last one improves nothing.
    """
    light = arcs.select("edge_key", "base", "adj", F.col(weight).cast("long"))
    few = [tuple(r) for r in light.limit(kernel_arcs + 1).collect()]
    if len(few) <= kernel_arcs:
        shipped = arcs.sparkSession.sparkContext.broadcast(few)

        def run(frames):
            net = Network(shipped.value)
            for frame in frames:
                for s in frame["node"]:  # one tree at a time
                    rows = [(s, n, *x) for n, x in net.tree(s).items()]
                    yield pd.DataFrame(rows, columns=["source", "node", "weight", "hops", "edge_key"])

        return sources.select(F.col("node").cast("long")).mapInPandas(run, "source long, node long, weight long, hops int, edge_key long")
    return distances_by_rounds(arcs, sources, most_rounds, weight)


def distances_by_rounds(arcs: DataFrame, sources: DataFrame, most_rounds: int = 10_000, weight: str = "millis") -> DataFrame:
    """distances() by rounds of joins. A tie goes to the smaller edge key, but to an arc of weight 0 only where no other arc gives the weight: no way may run in a circle.

    The arcs are dealt out and sorted by base once and persisted, which a checkpoint
    would forget, so that a round moves its frontier and what it found, not the arcs.
    """
    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("weight"), F.lit(0).alias("hops"), F.lit(-1).cast("long").alias("edge_key"), F.lit(False).alias("still")))
    frontier = state
    steps = arcs.select(F.col("base"), F.col("adj"), F.col("edge_key").alias("key"), F.col(weight).cast("long").alias("w")).repartition(parts, "base").sortWithinPartitions("base").persist()
    steps.count()  # only a filled cache tells how it is dealt out
    try:
        for _ in range(most_rounds):
            found = frontier.hint("merge").join(steps, frontier["node"] == steps["base"]).select("source", F.col("adj").alias("node"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("w") == 0).alias("still"), F.col("key").alias("edge_key"), (F.col("hops") + 1).alias("hops"))
            best = found.groupBy("source", "node").agg(F.min(F.struct("weight", "still", "edge_key", "hops")).alias("x")).select("source", "node", F.col("x.weight").alias("w2"), F.col("x.still").alias("s2"), F.col("x.edge_key").alias("e2"), F.col("x.hops").alias("h2"))
            both = state.join(best, ["source", "node"], "full_outer")
            # A row that this round doesn't reach has nulls on the right, one it reaches first has them on the left.
            tie = (F.col("w2") == F.col("weight")) & (~F.col("s2") & (F.col("still") | (F.col("e2") < F.col("edge_key"))) | (F.col("e2") == F.col("edge_key")) & (F.col("h2") != F.col("hops")))
            better = F.coalesce(F.col("w2").isNotNull() & (F.col("weight").isNull() | (F.col("edge_key") >= 0) & ((F.col("w2") < F.col("weight")) | tie)), F.lit(False))
            merged = cut(both.select("source", "node", *[F.when(better, F.col(n)).otherwise(F.col(o)).alias(o) for n, o in (("w2", "weight"), ("h2", "hops"), ("e2", "edge_key"), ("s2", "still"))], better.alias("new")))
            frontier = merged.filter("new").drop("new")
            state = merged.drop("new")
            if not frontier.limit(1).count():
                return state.drop("still")
        raise ValueError(f"ways were still getting shorter after {most_rounds} rounds")
    finally:
        steps.unpersist()


def path_edges(state: DataFrame, arcs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, edges): the edge keys of the shortest ways to targets (source, node), first edge first."""
    back = state.select("source", F.col("node").alias("at"), F.col("edge_key").alias("key"))
    tails = cut(arcs.select(F.col("edge_key").alias("key"), "base"))
    walk = targets.join(state.select("source", "node"), ["source", "node"]).select("source", F.col("node").alias("target"), F.col("node").alias("at"), F.array().cast("array<bigint>").alias("edges"))
    done = None
    while True:
        step = walk.join(back, ["source", "at"])
        ended = step.filter("key < 0").select("source", "target", "edges")
        done = ended if done is None else done.union(ended)
        walk = cut(step.filter("key >= 0").join(tails, "key").select("source", "target", F.col("base").alias("at"), F.concat(F.array("key"), "edges").alias("edges")))
        if not walk.limit(1).count():
            return done


class Network:
    """Arcs in memory for kernels: adjacency lists by base node. The graph must fit into an executor's memory."""

    def __init__(self, rows):
        self.out: dict = {}
        self.into: dict = {}
        for key, base, adj, weight in sorted(rows):
            self.out.setdefault(base, []).append((key, adj, weight))
            self.into.setdefault(adj, []).append((key, base, weight))

    def tree(self, source) -> dict:
        """node -> (weight, hops, edge key) of the shortest ways from source."""
        heap, out = [(0, -1, 0, source)], {}
        while heap:
            g, key, hops, node = heapq.heappop(heap)
            if node not in out:
                out[node] = (g, hops, key)
                for k, adj, w in self.out.get(node, ()):
                    if adj not in out:
                        heapq.heappush(heap, (g + w, k, hops + 1, adj))
        return out

    def search(self, source, target, bound=None, turn=None, most_visited=math.inf, until=math.inf):
        """(weight, edge keys, visited). bound(node): least weight left to the target (A*); turn(edge_in, edge_out): added weight, then states are arcs.

        A search that has settled most_visited states, or runs on the monotonic
        clock's time until, ends without a way.
        """
        bound = bound or (lambda _: 0)
        start = ("node", source)
        heap, best, visited = [(bound(source), 0, -1, start, source)], {start: (0, None, -1)}, 0
        settled = set()
        while heap:
            _, g, key, state, node = heapq.heappop(heap)
            if state in settled:
                continue
            settled.add(state)
            visited += 1
            if node == target:
                edges, at = [], state
                while best[at][1] is not None:
                    edges.append(best[at][2])
                    at = best[at][1]
                return g, edges[::-1], visited
            if visited >= most_visited or time.monotonic() >= until:
                break
            for k, adj, w in self.out.get(node, ()):
                if key >= 0 and k >> 1 == key >> 1 and turn is None:
                    continue
                extra = turn(key, k) if turn and key >= 0 else 0
                if extra == math.inf:
                    continue
                new, s = g + w + extra, ("arc", k) if turn else ("node", adj)
                if s not in settled and (s not in best or (new, k) < (best[s][0], best[s][2])):
                    best[s] = (new, state, k)
                    heapq.heappush(heap, (new + bound(adj), new, k, s, adj))
        return math.inf, [], visited

    def search_both(self, source, target, potential=None, most_visited=math.inf, until=math.inf):
        """Searches from both ends; stops when the two fronts together can't improve the best meeting.

        potential(node): half the bound to the target less half the bound from
        the source. One side adds it, the other subtracts it, so both search the
        same reduced weights and the sum of the fronts' keys stays comparable
        with the best meeting. Without one this is Dijkstra's algorithm.
        """
        if source == target:
            return 0, [], 1
        ahead = potential or (lambda _: 0)
        keys = (ahead, lambda n: -ahead(n))
        fronts = [({source: (0, None, -1)}, [(ahead(source), source)], set(), self.out), ({target: (0, None, -1)}, [(-ahead(target), target)], set(), self.into)]
        best, meet, visited, side = math.inf, None, 0, 0
        while fronts[0][1] and fronts[1][1] and fronts[0][1][0][0] + fronts[1][1][0][0] < best:
            if visited >= most_visited or time.monotonic() >= until:
                return math.inf, [], visited
            seen, heap, settled, lists = fronts[side]
            _, node = heapq.heappop(heap)
            if node not in settled:
                settled.add(node)
                visited += 1
                g = seen[node][0]
                for k, adj, w in lists.get(node, ()):
                    if adj not in seen or g + w < seen[adj][0]:
                        seen[adj] = (g + w, node, k)
                        heapq.heappush(heap, (g + w + keys[side](adj), adj))
                    other = fronts[1 - side][0].get(adj)
                    if other and seen[adj][0] + other[0] < best:
                        best, meet = seen[adj][0] + other[0], adj
            side = 1 - side
        if meet is None:
            return math.inf, [], visited
        edges, at = [], meet
        while fronts[0][0][at][1] is not None:
            edges.append(fronts[0][0][at][2])
            at = fronts[0][0][at][1]
        edges.reverse()
        at = meet
        while fronts[1][0][at][1] is not None:
            edges.append(fronts[1][0][at][2])
            at = fronts[1][0][at][1]
        return best, edges, visited


ALGORITHMS = ("dijkstra", "dijkstrabi", "astar", "astarbi")
ROUTES = "request long, leg int, found boolean, weight double, edges array<long>, visited long"


def routes(
    requests: DataFrame, arcs: DataFrame, nodes: DataFrame, algorithm: str = "astarbi", weight: str = "millis", fastest: float = 0.0, turns: dict | None = None, u_turn: float = math.inf,
    most_visited: float = math.inf, most_millis: float = math.inf, most_arcs: int = 20_000_000,
) -> DataFrame:
    """Legs between neighbouring points of each request (request, points array<long>), by a kernel on a broadcast graph.

    fastest: the greatest mm a millisecond of any arc, for the goal bound of A*.
    turns: {(from_edge, to_edge): weight}; with them states are arcs, and the
    search is from one end. A leg that settles most_visited states or takes
    most_millis isn't found. The graph's size is checked before it is sent;
    beyond most_arcs use distances(). A* needs the places of all nodes of the
    arcs; where some are unknown, its bounds are 0.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if arcs.count() > most_arcs:
        raise ValueError("the graph is too large for kernels; use distances()")
    context = requests.sparkSession.sparkContext
    rows = context.broadcast([tuple(r) for r in arcs.select("edge_key", "base", "adj", F.col(weight)).collect()])
    ends = arcs.select(F.col("base").alias("node")).union(arcs.select("adj")).distinct()  # at most two for each arc
    goal = algorithm.startswith("astar") and fastest > 0
    places = context.broadcast({r[0]: (r[1], r[2]) for r in nodes.join(ends, "node", "left_semi").select("node", "lat", "lon").collect()}) if goal else None

    def run(frames):
        net = Network(rows.value)
        turn = (lambda i, o: turns.get((i >> 1, o >> 1), 0) if i >> 1 != o >> 1 else u_turn) if turns is not None else None
        at = places.value if goal and all(n in places.value for n in (*net.out, *net.into)) else None
        for frame in frames:
            out = []
            for request, points in zip(frame["request"], frame["points"], strict=True):
                for leg, (a, b) in enumerate(zip(points, points[1:], strict=False)):
                    until = time.monotonic() + most_millis / 1000
                    known = at is not None and a in at and b in at
                    left = (lambda n, to: 0.999 * 1000 * _beeline(*at[n], *at[to]) / fastest) if known else (lambda n, to: 0)
                    if algorithm.endswith("bi") and turn is None:
                        half = (lambda n, a=a, b=b: (left(n, b) - left(n, a)) / 2) if known else None
                        w, edges, visited = net.search_both(a, b, half, most_visited, until)
                    else:
                        w, edges, visited = net.search(a, b, lambda n, b=b: left(n, b), turn, most_visited, until)
                    out.append((request, leg, w < math.inf, None if w == math.inf else float(w), edges, visited))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROUTES.split(", ")])

    return requests.select("request", "points").mapInPandas(run, ROUTES)


def _beeline(lat1, lon1, lat2, lon2) -> float:
    a, b = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    return 12_742_000 * math.asin(math.sqrt(math.sin(a) ** 2 + math.sin(b) ** 2 * math.cos(math.radians(lat1)) * math.cos(math.radians(lat2))))
