"""The road-graph engine against SQL, brute force and known values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wayloom.functions import costs, lines, tags
from wayloom.operators import connectivity, contraction, importing, paths, spatial
from wayloom.plans import catalog, fixtures, routing

SF = "/root/testdata/sf0.001"
QUICK = [q for q in catalog.ORACLES if q not in ("route_legs",)]
NEW = list(routing.QUERIES)


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, base, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)
    found = base.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert rows == sorted([tuple(dict(zip(names, x, strict=True))[c] for c in columns) for x in found.fetchall()], key=str)


def test_polyline_round_trip():
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert lines.encode_polyline(points) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert lines.decode_polyline(lines.encode_polyline(points)) == points


def test_simplification_keeps_ends_and_corners():
    flat = [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (1.0, 1.0)]
    assert lines.simplified_points(flat, 0.5) == [0, 2, 3]
    assert lines.simplified_parts(flat, [1], 0.5) == ([0, 1, 2, 3], [0, 1, 3])


def test_gap_and_junction_segments(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4], {"highway": "road"}), (2, [5, 3, 6], {"highway": "road"}), (3, [7, 99, 8], {"highway": "road"})], "way long, refs array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in (1, 2, 3, 4, 5, 6, 7, 8)], "node long, lat double, lon double")
    found = {(r.way, tuple(p.node for p in r.points)) for r in importing.segments(ways, nodes).collect()}
    assert found == {(1, (1, 2, 3)), (1, (3, 4)), (2, (5, 3)), (2, (3, 6)), (3, (7, 8))}


def test_rounds_equal_kernel(spark):
    arcs = spark.createDataFrame([(2 * k, a, b, w) for k, (a, b, w) in enumerate([(0, 1, 5), (1, 2, 5), (0, 2, 11), (2, 3, 1), (3, 0, 1), (4, 0, 1)])], "edge_key long, base long, adj long, millis long")
    start = spark.createDataFrame([(0,), (4,)], "node long")
    few, many = paths.distances(arcs, start), paths.distances_by_rounds(arcs, start)
    assert sorted(few.collect()) == sorted(many.select(few.columns).collect())


def test_rounds_equal_sql_and_kernel_on_lanes(spark, base):
    arcs, nodes = fixtures.arcs_of(fixtures.lane_edges(spark, SF)), fixtures.lane_nodes(spark, SF)
    start = nodes.filter(F.col("node").isin(*catalog.SOURCES))
    many = paths.distances(arcs, start, kernel_arcs=0).cache()
    assert sorted(many.select("source", "node", "weight").collect()) == sorted(base.execute(catalog.ORACLES["many_to_many"]).fetchall())
    few = paths.distances(arcs, start)
    assert sorted(few.collect()) == sorted(many.select(few.columns).collect())


def test_rounds_keep_ways_over_arcs_without_weight(spark):
    arcs = spark.createDataFrame([(10, 0, 1, 5), (3, 1, 2, 0), (2, 2, 1, 0), (4, 2, 3, 1), (1, 0, 4, 6), (0, 4, 3, 0)], "edge_key long, base long, adj long, millis long")
    state = paths.distances(arcs, spark.createDataFrame([(0,)], "node long"), kernel_arcs=0)
    assert {r.node: (r.weight, r.hops, r.edge_key) for r in state.collect()} == {0: (0, 0, -1), 1: (5, 1, 10), 2: (5, 2, 3), 3: (6, 3, 4), 4: (6, 1, 1)}
    with pytest.raises(ValueError):
        paths.distances(arcs, spark.createDataFrame([(0,)], "node long"), most_rounds=2, kernel_arcs=0)


def test_components_by_colours_equal_kernel(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5)], "a long, b long")
    nodes = spark.range(6).select(F.col("id").alias("node"))
    want = {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)}
    assert {tuple(r) for r in connectivity.strong_components(links, nodes).collect()} == want
    assert {tuple(r) for r in connectivity.components_by_colours(links, nodes).collect()} == want


def test_model_errors_and_range():
    with pytest.raises(ValueError):
        costs.groups([costs.Statement("else", "", "add", "1")])
    with pytest.raises(ValueError):
        costs.Condition("speed ~ 3", {}, {})
    model = costs.Model.parse({"speed": [{"if": "true", "limit_to": "v"}, {"if": "x", "multiply_by": "0.5"}]})
    assert costs.value_range(model.speed, 999.0, {"v": 120.0}) == (0.0, 120.0)


def test_durations_and_speeds(spark):
    texts = ["10", "01:30", "00:01:10", "PT1H", "P1D", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tags.duration_seconds(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [600, 5400, 70, 3600, 86400, None]


def ch(edges, order=None):
    """A contraction of edges (a, b, weight, both ways)."""
    rows = [(2 * k, a, b, w) for k, (a, b, w, _) in enumerate(edges)] + [(2 * k + 1, b, a, w) for k, (a, b, w, both) in enumerate(edges) if both]
    graph = contraction.Contraction(rows)
    graph.contract_all(order)
    return graph


def test_shortcut_counts():
    line = [(k, k + 1, 1, True) for k in range(10)] + [(10, 11, 1, False), (11, 12, 1, True), (11, 9, 3, False)] + [(k, k + 1, 1, True) for k in range(12, 17)] + [(17, 0, 1, True)]
    directed = ch(line, [10, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 17, 11, 12, 13, 14, 15, 16])
    assert directed.count() == 9
    assert ch([(0, 1, 10, True), (0, 1, 4, True), (0, 2, 10, True), (0, 3, 10, True)]).count() == 0
    two = [(1, 2, 1, False), (2, 1, 1, False), (5, 0, 1, True), (5, 6, 1, True), (0, 1, 1, True), (2, 3, 1, True), (3, 4, 1, True), (6, 3, 1, True)]
    assert ch(two, [4, 1, 2, 0, 5, 6, 3]).count() == 2
    assert ch([(5, 4, 3, False), (4, 5, 10, False), (2, 4, 1, False), (5, 2, 1, False), (3, 5, 1, False), (4, 3, 1, False)]).count() == 2


def test_hierarchies_keep_distances_of_random_graphs():
    import random

    for seed in range(40):
        r = random.Random(seed)
        n = r.randint(2, 25)
        edges = [(r.randrange(n), r.randrange(n), r.randint(0, 30), r.random() < 0.6) for _ in range(r.randint(1, 60))]
        graph = ch(edges)
        net = paths.Network([(2 * k, a, b, w) for k, (a, b, w, _) in enumerate(edges)] + [(2 * k + 1, b, a, w) for k, (a, b, w, both) in enumerate(edges) if both])
        up = paths.Network([(k, a, c, w) for k, ((a, c), (w, _, _)) in enumerate(graph.arcs.items()) if graph.level[a] < graph.level[c]])
        down = paths.Network([(k, c, a, w) for k, ((a, c), (w, _, _)) in enumerate(graph.arcs.items()) if graph.level[a] > graph.level[c]])
        for s in graph.level:
            want = {t: x[0] for t, x in net.tree(s).items()}
            ahead = {m: x[0] for m, x in up.tree(s).items()}
            for t in graph.level:
                back = {m: x[0] for m, x in down.tree(t).items()}
                assert min((ahead[m] + back[m] for m in ahead if m in back), default=None) == want.get(t)
        for a, c in graph.shortcuts:
            nodes = [*graph.unpacked(a, c), c]
            assert sum(graph.arcs[x, y][0] for x, y in zip(nodes, nodes[1:], strict=False)) == graph.arcs[a, c][0]


def test_colours_equal_kernel_on_random_graphs(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        links = [(r.randrange(30), r.randrange(30)) for _ in range(45)]
        nodes = spark.range(30).select(F.col("id").alias("node"))
        df = spark.createDataFrame(links, "a long, b long")
        assert set(connectivity.components_by_colours(df, nodes).collect()) == set(connectivity.strong_components(df, nodes).collect())


def test_barrier_nodes(spark):
    rows = [({"barrier": "bollard"}, True), ({"barrier": "gate"}, False), ({"barrier": "bollard", "access": "yes"}, False), ({"access": "no"}, False), ({"ford": "pond"}, True), ({"barrier": "gate", "motorcar": "no"}, True), ({}, False)]
    df = spark.createDataFrame([(t, w) for t, w in rows], "tags map<string,string>, want boolean")
    assert df.filter(tags.is_barrier(F.col("tags")) != F.col("want")).count() == 0
    name = spark.createDataFrame([({"name": "é" * 200},)], "tags map<string,string>").select(tags.street_name(F.col("tags"))).first()[0]
    assert name == "é" * 128


def test_barriers_split_segments(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4], {"highway": "road"}), (2, [4, 5], {"highway": "road"}), (3, [6, 7], {"highway": "road"}), (4, [8, 9, 8], {"highway": "road"})], "way long, refs array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 10)], "node long, lat double, lon double")
    stops = spark.createDataFrame([(2,), (3,), (4,), (6,), (9,), (77,)], "node long")
    parts = importing.segments(ways, nodes)
    cut = importing.split_at_barriers(parts, stops)
    found = {(r.way, r.part, r.piece, r.barrier, tuple(p.node for p in r.points)) for r in cut.collect()}
    assert {x for x in found if x[0] == 1} == {(1, 0, 0, False, (1, 2)), (1, 0, 1, True, (2, -3)), (1, 0, 2, False, (-3, 3)), (1, 0, 3, True, (3, -4)), (1, 0, 4, False, (-4, -5)), (1, 0, 5, True, (-5, 4))}
    assert {x for x in found if x[0] == 2} == {(2, 0, 0, False, (4, 5))}
    assert {x for x in found if x[0] == 3} == {(3, 0, 0, True, (6, -7)), (3, 0, 1, False, (-7, 7))}
    assert {x[4] for x in found if x[0] == 4} == {(8, -10), (-10, 9), (9, 8)}
    edges = importing.edges_of(cut, ways)
    assert edges.filter("barrier").agg(F.max("distance_mm")).first()[0] == 1
    assert importing.split_at_barriers(parts, stops.limit(0)).filter("piece > 0 OR barrier").count() == 0


def test_import_refusals(spark):
    loop = spark.createDataFrame([(1, 5, 5)], "way long, from_node long, to_node long")
    with pytest.raises(Exception, match="itself"):
        importing.without_loops(loop).collect()
    with pytest.raises(ValueError, match="empty"):
        importing.not_empty(loop.limit(0))


def test_searches_agree_on_random_graphs():
    import random

    for seed in range(60):
        r = random.Random(seed)
        n = r.randint(2, 40)
        places = {k: (45 + r.random(), 5 + r.random()) for k in range(n)}
        ends = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 120))]
        arcs = [(2 * k, a, b, int(paths._beeline(*places[a], *places[b]) * r.uniform(1, 3)) + 1) for k, (a, b) in enumerate(ends)]
        net = paths.Network(arcs)
        weights = {k: w for k, _, _, w in arcs}
        for _ in range(10):
            s, t = r.randrange(n), r.randrange(n)
            left = lambda x, to: 0.999 * paths._beeline(*places[x], *places[to])
            want = net.search(s, t)[0]
            plain, balanced = net.search_both(s, t), net.search_both(s, t, lambda x, s=s, t=t: (left(x, t) - left(x, s)) / 2)
            assert plain[0] == balanced[0] == want
            assert want == float("inf") or sum(weights[k] for k in balanced[1]) == want
    line = paths.Network([(2 * k, k, k + 1, 1) for k in range(50)])
    assert line.search_both(0, 50, most_visited=10)[0] == line.search(0, 50, until=0)[0] == line.search_both(0, 50, until=0)[0] == float("inf")


def test_sorted_graph(spark):
    nodes = spark.createDataFrame([(k, 10.0 * k, -20.0 * k) for k in range(4)], "node long, lat double, lon double")
    edges = spark.createDataFrame([(7, 0, 1), (8, 1, 2), (9, 2, 3), (10, 1, 2)], "edge_id long, a long, b long")
    turns = spark.createDataFrame([(7, 1, 8)], "from_edge long, via_node long, to_edge long")
    placed, numbered, moved = importing.sorted_graph(nodes, edges, turns)
    new = {r.node: r.new_id for r in placed.collect()}
    order = [r.edge_id for r in numbered.orderBy("new_edge").collect()]
    assert order == sorted((7, 8, 9, 10), key=lambda e: (min(new[a] for a in {7: (0, 1), 8: (1, 2), 9: (2, 3), 10: (1, 2)}[e]), -e))
    assert sorted(r.new_edge for r in numbered.collect()) == [0, 1, 2, 3]
    (turn,) = moved.collect()
    assert (turn.new_from, turn.new_via, turn.new_to) == (order.index(7), new[1], order.index(8))


def test_tiles_are_those_a_line_crosses(spark):
    lines_ = [(1, 0.05, 0.05, 2.05, 2.05), (2, 0.05, 0.05, 0.05, 1.05), (3, 1.05, 0.05, 0.05, 0.05), (4, 0.0, 179.0, 0.0, -179.0), (5, 0.31, 0.92, 1.87, 0.13)]
    df = spark.createDataFrame(lines_, "edge_id long, lat_a double, lon_a double, lat_b double, lon_b double")
    rows = [tuple(r) for r in spatial.edge_tiles(df).collect()]
    assert len(rows) == len(set(rows))
    got = {k: {(x, y) for x, y, e in rows if e == k} for k in range(1, 6)}
    assert len(got[1]) <= 3 * 21 and {(k, k) for k in range(21)} <= got[1]
    assert got[2] == {(k, 0) for k in range(11)} and got[3] == {(0, k) for k in range(11)} and got[4] == set()
    walked = {(int((0.92 + s * (0.13 - 0.92)) / 0.1), int((0.31 + s * (1.87 - 0.31)) / 0.1)) for s in (k / 20000 for k in range(20001))}
    assert walked <= got[5] and len(got[5] - walked) <= 2


def test_lane_nodes_equal_sql_exactly(spark, base):
    found = sorted(tuple(r) for r in fixtures.lane_nodes(spark, SF).collect())
    assert found == sorted(base.execute(f"SELECT node, CAST(lat AS DOUBLE), CAST(lon AS DOUBLE) FROM ({catalog.NODES})").fetchall())


@pytest.fixture(scope="module")
def late_parts(tmp_path_factory):
    """The small tables with parts numbered on both sides of 1,000,000, where regions meet; (folder, connection)."""
    folder, con = tmp_path_factory.mktemp("late"), duckdb.connect()
    for t, keys in {"part": "p_partkey + i * 999900 AS p_partkey", "orders": "o_orderkey + i * 1500 AS o_orderkey", "lineitem": "l_orderkey + i * 1500 AS l_orderkey, l_partkey + i * 999900 AS l_partkey"}.items():
        con.execute(f"copy (select * exclude (i) replace ({keys}) from '{SF}/{t}.parquet', range(2) r(i)) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["barrier_edges", "way_segments", "edge_list", "barrier_split"])
def test_parts_beyond_a_region_equal_sql(spark, late_parts, name):
    folder, con = late_parts
    df = catalog.QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_nodes_of_all_regions_are_not_broadcast(spark):
    plan = catalog.way_segments(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]


def test_tiles_around_points_are_not_broadcast(spark):
    plan = catalog.nearest_edge(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("tile_x" in x or "cell_x" in x)]


def test_points_at_one_place_and_equal_edges(spark):
    points = spark.createDataFrame([(1, 45.05, 5.05), (2, 45.05, 5.05), (3, 45.01, 5.0), (3, 45.01, 5.0), (4, 48.0, 5.0)], "point long, lat double, lon double")
    edges = spark.createDataFrame([(8, 45.0, 5.0, 45.0, 5.1), (7, 45.1, 5.0, 45.1, 5.1), (6, 45.0, 5.0, 45.0, 5.1)], "edge_id long, lat_a double, lon_a double, lat_b double, lon_b double")
    found = {r.point: (r.edge_id, r.lat, r.lon) for r in spatial.nearest_edges(points, edges).collect()}
    assert found == {1: (6, 45.0, 5.05), 2: (6, 45.0, 5.05), 3: (6, 45.0, 5.0)} and spatial.nearest_edges(points, edges).count() == 3


def test_rounds_deal_out_the_arcs_once(spark, monkeypatch):
    plans, kept, held = [], paths.cut, spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(paths, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    arcs = spark.createDataFrame([(2 * k, k, k + 1, 1) for k in range(3)], "edge_key long, base long, adj long, millis long")
    state = paths.distances(arcs, spark.createDataFrame([(0,)], "node long"), kernel_arcs=0)
    assert sorted((r.node, r.weight) for r in state.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    rounds = [p for p in plans if "Join" in p]
    assert len(rounds) == 4
    assert not [x for p in rounds for x in p.splitlines() if "Broadcast" in x or "hashpartitioning(base" in x and "ENSURE_REQUIREMENTS" in x]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_colours_rounds_and_one_task_equal_kernel(spark):
    import random

    for seed in range(2):
        r = random.Random(seed)
        links = [(r.randrange(30), r.randrange(30)) for _ in range(45)] + [(40, 41), (41, 42), (42, 40), (50, 51), (51, 52), (52, 53)]
        nodes = spark.range(60).select(F.col("id").alias("node"))
        df = spark.createDataFrame(links, "a long, b long")
        want = set(connectivity.strong_components(df, nodes).collect())
        assert set(connectivity.components_by_colours(df, nodes, 0).collect()) == want == set(connectivity.components_by_colours(df, nodes, 20).collect())


def test_colours_of_a_chain_take_few_jobs(spark):
    """Five links that trimming takes away one by one from both ends, and a circle; no links; ends that aren't nodes."""
    tracker, group = spark.sparkContext.statusTracker(), "chain"
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (7, 6), (6, 7), (8, 9), (9, 8)], "a long, b long")
    spark.sparkContext.setJobGroup(group, group)
    found = connectivity.components_by_colours(links, spark.range(9).select(F.col("id").alias("node"))).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in found) == [(k, k) for k in range(6)] + [(6, 6), (7, 6), (8, 8)]
    assert len(tracker.getJobIdsForGroup(group)) < 30
    none = connectivity.components_by_colours(links.filter("a < 0"), spark.range(2).select(F.col("id").alias("node")))
    assert sorted(tuple(r) for r in none.collect()) == [(0, 0), (1, 1)]
