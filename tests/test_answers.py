"""Answers, sides of roads, alternatives and hierarchies of arcs on small graphs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import lines
from wayloom.operators import alternatives, answers, contraction, paths, resolvers, turns

LEGS = "request long, leg int, points array<struct<lat:double,lon:double>>, distance double, millis long, weight double"


def test_legs_are_merged_and_rendered(spark):
    legs = spark.createDataFrame([(1, 1, [(1.0, 1.0), (1.0, 2.0)], 20.0, 7, 2.0), (1, 0, [(0.0, 0.0), (0.0, 0.5), (1.0, 1.0)], 10.0, 5, 1.0), (2, 0, [(3.0, 4.0)], 0.0, 0, 0.0), (3, 0, [], 0.0, 0, 0.0)], LEGS)
    merged = answers.merged_legs(legs)
    rows = {r.request: r for r in merged.collect()}
    assert [tuple(p) for p in rows[1].points] == [(0.0, 0.0), (0.0, 0.5), (1.0, 1.0), (1.0, 2.0)] and rows[1].stops == [0, 2, 3]
    assert (rows[1].distance, rows[1].millis, rows[1].weight) == (30.0, 12, 3.0)
    assert rows[2].stops == [0, 0]
    plain = {r.request: r for r in answers.rendered(merged, encoded=False).collect()}
    assert json.loads(plain[1].points) == {"type": "LineString", "coordinates": [[0.0, 0.0], [0.5, 0.0], [1.0, 1.0], [2.0, 1.0]]}
    assert json.loads(plain[1].snapped_waypoints)["coordinates"] == [[0.0, 0.0], [1.0, 1.0], [2.0, 1.0]]
    assert plain[1].bbox == [0.0, 0.0, 2.0, 1.0] and plain[3].bbox is None and plain[3].points is None
    assert [(i.text, i.sign, i.distance, i.time, i.interval) for i in plain[1].instructions] == [("Continue", 0, 30.0, 12, [0, 3]), ("Arrive at destination", 4, 0.0, 0, [3, 3])]
    coded = {r.request: r.points for r in answers.rendered(merged).collect()}
    assert lines.decode_polyline(coded[1]) == [(0.0, 0.0), (0.0, 0.5), (1.0, 1.0), (1.0, 2.0)]


def test_simplification_keeps_stops(spark):
    straight = [(0.0, 0.1 * k) for k in range(7)]
    legs = spark.createDataFrame([(1, 0, straight[:4], 1.0, 1, 1.0), (1, 1, straight[3:], 1.0, 1, 1.0), (2, 0, [], 0.0, 0, 0.0)], LEGS)
    rows = {r.request: r for r in answers.simplified(answers.merged_legs(legs)).collect()}
    assert [tuple(p) for p in rows[1].points] == [straight[0], straight[3], straight[6]] and rows[1].stops == [0, 1, 2]
    assert rows[2].points == [] and rows[2].stops == [0, 0]


def test_visited_nodes(spark):
    routes = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, None)], "request long, leg int, visited long")
    assert {tuple(r) for r in answers.visited(routes).collect()} == {(1, 11, 5), (2, 0, 0)}


ADJACENT = "node long, edge_id long, points array<struct<lat:double,lon:double>>, enters boolean, leaves boolean"


def side(spark, rows, lat, lon):
    df = spark.createDataFrame([(0, e, points, a, b) for e, points, a, b in rows], ADJACENT)
    asked = spark.createDataFrame([(1, 0, lat, lon)], "request long, node long, lat double, lon double")
    return tuple(resolvers.sides(df, asked).first())[2:]


def test_sides_of_a_road(spark):
    here, west, east, north = (0.0, 0.0), (0.0, -1.0), (0.0, 1.0), (1.0, 0.0)
    road = [(0, [here, west], True, True), (1, [here, east], True, True)]
    assert side(spark, road, -0.1, 0.0) == (0, 1, 1, 0)  # south: right of the way from west to east
    assert side(spark, road, 0.1, 0.0) == (1, 0, 0, 1)
    oneway = [(0, [here, west], True, False), (1, [here, east], False, True)]
    assert side(spark, oneway, -0.1, 0.0) == (0, 1, -1, -1)
    assert side(spark, oneway, 0.1, 0.0) == (-1, -1, 0, 1)
    assert side(spark, road[:1], 0.1, 0.0) == (0, 0, 0, 0)
    assert side(spark, [(0, [here, west], True, False)], 0.1, 0.0) == (-1,) * 4
    assert side(spark, [(0, [here, west], False, False)], 0.1, 0.0) == (-1,) * 4
    assert side(spark, [*road, (2, [here, north], True, True)], 0.1, 0.0) == (-2,) * 4
    assert side(spark, [*road, (2, [here, west], True, True)], 0.1, 0.0) == (-2,) * 4
    assert side(spark, [*road, (2, [here, here], True, True)], 0.1, 0.0) == (-2,) * 4
    assert side(spark, [(0, [here, here, west], True, True), road[1]], -0.1, 0.0) == (0, 1, 1, 0)
    asked = spark.createDataFrame([(" right ",), ("left",), ("",), (None,)], "s string").select(resolvers.edge_of_side(F.col("s"), F.lit(5).cast("long"), F.lit(6).cast("long")))
    assert [r[0] for r in asked.collect()] == [5, 6, -2, -2]
    with pytest.raises(Exception, match="unknown curbside"):
        spark.createDataFrame([("up",)], "s string").select(resolvers.edge_of_side(F.col("s"), F.lit(5).cast("long"), F.lit(6).cast("long"))).collect()


def test_other_headings(spark):
    here = (0.0, 0.0)
    rows = [(0, k, [here, p], True, True) for k, p in enumerate([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)])]
    df = spark.createDataFrame(rows, ADJACENT)
    found = lambda h, **more: sorted(r.edge_id for r in resolvers.other_headings(df, F.lit(h), **more).collect())
    assert found(0.0) == [2] and found(90.0) == [3] and found(180.0) == [0] and found(270.0, tolerance=80.0) == [0, 1, 2]


def hierarchy(arcs, order=None):
    graph = contraction.Contraction([(k, a, b, w) for k, a, b, w, _ in arcs])
    graph.contract_all(order)
    lengths = {}
    for _, a, b, _, d in sorted(arcs, key=lambda x: (x[3], x[0])):
        lengths.setdefault((a, b), d)
    rows = [(a, c, w, via, graph.level[a], graph.level[c]) for (a, c), (w, via, _) in graph.arcs.items()]
    return alternatives.Hierarchy(rows, lengths)


def test_alternatives_over_a_second_bridge():
    # Two ways of five steps each from 0 to 9, the second a little longer, and a third that is far too long.
    ways = [[0, 1, 2, 3, 4, 9], [0, 11, 12, 13, 14, 9], [0, 21, 22, 23, 24, 9]]
    cost = [100, 110, 300]
    pairs = [(a, b, c) for way, c in zip(ways, cost, strict=True) for a, b in zip(way, way[1:], strict=False)]
    arcs = [(2 * k + r, *((a, b) if not r else (b, a)), c, c) for k, (a, b, c) in enumerate(pairs) for r in (0, 1)]
    # Only nodes that both climbs meet are candidates: the middles of the ways are contracted last.
    order = [0, 9, 21, 24, 22, 23, 1, 11, 4, 14, 3, 13, 2, 12]
    found = hierarchy(arcs, order).alternatives(0, 9)
    assert [(w, nodes) for w, nodes, _ in found] == [(500, ways[0]), (550, ways[1])]
    assert hierarchy(arcs).alternatives(0, 9, most_paths=1)[0][1] == ways[0]
    assert hierarchy([(0, 1, 2, 3, 3), (2, 3, 4, 3, 3)]).alternatives(1, 4) == []


def test_alternatives_on_random_graphs():
    for seed in range(40):
        r = random.Random(seed)
        n = r.randint(4, 30)
        arcs = [(2 * k, *r.sample(range(n), 2), r.randint(1, 30), r.randint(1, 30)) for k in range(r.randint(3, 120))]
        graph, net = hierarchy(arcs), paths.Network([a[:4] for a in arcs])
        cheapest = {}
        for _, a, b, w, _ in arcs:
            cheapest[a, b] = min(w, cheapest.get((a, b), math.inf))
        for s in range(min(n, 6)):
            t = n - 1 - s
            if s == t or s not in net.out or t not in net.into:
                continue
            found = graph.alternatives(s, t)
            best = net.search(s, t)[0]
            assert (best == math.inf) == (not found)
            for rank, (w, nodes, share) in enumerate(found):
                assert nodes[0] == s and nodes[-1] == t
                assert w == sum(cheapest[x] for x in zip(nodes, nodes[1:], strict=False))
                assert w == best if rank == 0 else (w <= 1.25 * best and share <= 0.8)
            assert len({tuple(x[1]) for x in found}) == len(found) <= 3


def test_hierarchy_of_arcs_equals_search(spark):
    r = random.Random(5)
    ends = [tuple(r.sample(range(12), 2)) for _ in range(26)]
    arcs = spark.createDataFrame([(2 * k + x, *((a, b) if not x else (b, a)), r.randint(1, 40)) for k, (a, b) in enumerate(ends) for x in (0, 1)], "edge_key long, base long, adj long, millis long")
    costs = [(i, v, j, float(r.randint(0, 30)), r.random() < 0.2) for v in range(12) for i, e in enumerate(ends) if v in e for j, f in enumerate(ends) if v in f and i != j and r.random() < 0.5]
    table = spark.createDataFrame(costs, "from_edge long, via_node long, to_edge long, cost double, restricted boolean")
    start = spark.createDataFrame([(0,), (7,)], "node long")
    want = {tuple(x) for x in turns.turn_distances(arcs, table, start).collect()}
    assert {tuple(x) for x in turns.turn_distances(arcs, table, start, search=turns.by_hierarchy).collect()} == want


@pytest.mark.parametrize("key", [22451, 26520, 29724, 84119])
def test_curbsides_beside_a_line_equal_sql(spark, tmp_path, key):
    import duckdb

    from wayloom.plans import catalog

    con = duckdb.connect()
    con.execute("create view nation as select * from '/root/testdata/sf0.001/nation.parquet'")
    con.execute(f"create table customer as select CAST({key} AS BIGINT) AS c_custkey, CAST(k AS INT) AS c_nationkey from range(25) r(k)")
    for t in ("nation", "customer"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    found = catalog.QUERIES["curbsides"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(found.columns)} from ({catalog.ORACLES['curbsides']})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
