import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayloom.sources import graph_store, osm_pbf, osm_xml


def number(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n >= 128:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else ~(n << 1)


def field(k: int, value) -> bytes:
    return number(k << 3) + number(value) if isinstance(value, int) else number(k << 3 | 2) + number(len(value)) + value


def steps(values) -> bytes:
    return b"".join(number(zigzag(b - a)) for a, b in zip([0, *values], values, strict=False))


def blob(kind: str, content: bytes, squeeze: bool = True) -> bytes:
    body = field(2, len(content)) + field(3, zlib.compress(content)) if squeeze else field(1, content)
    header = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(header)) + header + body


def strings(*words) -> bytes:
    return field(1, b"".join(field(1, w.encode()) for w in ("", *words)))


NODES = strings("barrier", "gate") + field(2, field(2, field(1, steps([5, 9, 7])) + field(8, steps([450000000, 451000000, -10])) + field(9, steps([50000000, 60000000, -20])) + field(10, bytes([0, 1, 2, 0, 0]))))
PLAIN_NODE = strings("a", "b") + field(2, field(1, field(1, zigzag(1 << 40)) + field(2, b"\1") + field(3, b"\2") + field(8, zigzag(-450000000)) + field(9, zigzag(0))))
WAYS = strings("highway", "Straße") + field(2, field(3, field(1, 300) + field(2, b"\1") + field(3, b"\2") + field(8, steps([5, 9, 5]))) + field(3, field(1, 301)))
RELATIONS = strings("type", "outer") + field(2, field(4, field(1, 7) + field(2, b"\1") + field(3, b"\2") + field(8, b"\2\0") + field(9, steps([300, 5])) + field(10, b"\1\0")))
HEADER = blob("OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes"))


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    path = tmp_path_factory.mktemp("pbf") / "a.pbf"
    path.write_bytes(HEADER + blob("OSMData", NODES) + blob("OSMData", PLAIN_NODE, False) + blob("OSMData", WAYS) + blob("OSMData", RELATIONS))
    return str(path)


def test_blocks_give_elements(spark, extract):
    nodes = {r["node"]: (round(r["lat"], 7), round(r["lon"], 7), r["tags"]) for r in osm_pbf.read_elements(spark, extract, "node").collect()}
    assert nodes == {5: (45.0, 5.0, {}), 9: (45.1, 6.0, {"barrier": "gate"}), 7: (-0.000001, -0.000002, {}), 1 << 40: (-45.0, 0.0, {"a": "b"})}
    ways = {r["way"]: (r["refs"], r["tags"]) for r in osm_pbf.read_elements(spark, "file:" + extract, "way").collect()}
    assert ways == {300: ([5, 9, 5], {"highway": "Straße"}), 301: ([], {})}
    (relation,) = osm_pbf.read_elements(spark, extract, "relation").collect()
    assert relation["relation"] == 7 and [tuple(m) for m in relation["members"]] == [("way", 300, "outer"), ("node", 5, "")]


def test_only_the_asked_kind_is_decoded():
    assert osm_pbf.elements(WAYS, "node") == {"node": [], "lat": [], "lon": [], "tags": []}
    broken = strings("a") + field(2, field(3, b"\xff\xff")) + field(2, field(4, field(1, 1)))
    assert osm_pbf.elements(broken, "relation")["relation"] == [1]


def test_refused_files(spark, tmp_path):
    (tmp_path / "new.pbf").write_bytes(blob("OSMHeader", field(4, b"FutureThing")))
    with pytest.raises(Exception, match="FutureThing"):
        osm_pbf.read_elements(spark, str(tmp_path / "new.pbf"), "way").collect()
    with pytest.raises(ValueError, match="negative"):
        osm_pbf.elements(strings() + field(2, field(3, field(1, -4))), "way")
    (tmp_path / "none.pbf").write_bytes(HEADER)
    assert osm_pbf.read_elements(spark, str(tmp_path / "none.pbf"), "way").count() == 0


def test_xml_and_blocks_agree(spark, extract, tmp_path):
    text = '<osm><node id="5" lat="45.0" lon="5.0"/><way id="300"><nd ref="5"/><nd ref="9"/><nd ref="5"/><tag k="highway" v="Straße"/></way><way id="301"/></osm>'
    (tmp_path / "a.osm").write_text(text)
    xml, pbf = (sorted((r["way"], r["refs"], r["tags"]) for r in read.read_elements(spark, path, "way").collect()) for read, path in ((osm_xml, str(tmp_path / "a.osm")), (osm_pbf, extract)))
    assert xml == pbf


def test_graph_store_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    graph_store.store({"edges": edges}, str(tmp_path / "g"))
    tables, registry = graph_store.load(spark, str(tmp_path / "g"))
    assert sorted(tables["edges"].collect()) == sorted(edges.collect()) and registry is None


def test_hierarchy_round_trip(spark, tmp_path):
    from wayloom.operators import contraction

    ends = [(0, 1, 4), (1, 2, 3), (2, 3, 9), (3, 0, 1), (1, 3, 2)]
    arcs = spark.createDataFrame([(2 * k + r, *((a, b) if not r else (b, a)), w) for k, (a, b, w) in enumerate(ends) for r in (0, 1)], "edge_key long, base long, adj long, millis long")
    levels, ch_arcs = contraction.prepared(arcs)
    assert graph_store.load_hierarchy(spark, str(tmp_path), "car") is None
    graph_store.store_hierarchy(levels, ch_arcs, str(tmp_path), "car")
    again, arcs_again = graph_store.load_hierarchy(spark, str(tmp_path), "car")
    assert sorted(again.collect()) == sorted(levels.collect()) and sorted(arcs_again.collect(), key=str) == sorted(ch_arcs.collect(), key=str)
    with pytest.raises(Exception, match="order of levels"):
        graph_store.store_hierarchy(levels, ch_arcs.withColumn("level_adj", F.col("level")), str(tmp_path), "bad")


def test_stored_weights(spark):
    rows = spark.createDataFrame([(0.0,), (1.23449,), (3e6,), (float("inf"),)], "w double").select(graph_store.stored_weight(F.col("w"))).collect()
    assert [r[0] for r in rows] == [0.001, 1.234, float("inf"), float("inf")]
