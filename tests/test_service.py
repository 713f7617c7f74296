import json

import pytest

from wayloom import __main__ as command
from wayloom.functions import lines
from wayloom.sources import settings

NODES = {1: (45.0, 5.0), 2: (45.0, 5.01), 3: (45.0, 5.02), 4: (45.01, 5.02), 5: (45.01, 5.0), 6: (45.005, 5.03), 7: (45.005, 5.0)}


def document():
    gate = {7: '<tag k="barrier" v="bollard"/>'}
    nodes = "".join(f'<node id="{k}" lat="{a}" lon="{b}">{gate.get(k, "")}</node>' for k, (a, b) in NODES.items())
    way = lambda k, refs, kind, more="": f'<way id="{k}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + f'<tag k="highway" v="{kind}"/>{more}</way>'
    return f'<osm>{nodes}{way(1, (1, 2, 3), "primary", "<tag k=\'name\' v=\'Main\'/>")}{way(2, (3, 6, 4), "primary")}{way(3, (4, 5), "residential", "<tag k=\'oneway\' v=\'yes\'/>")}{way(4, (5, 7, 1), "primary")}{way(5, (1, 4), "footway")}</osm>'


def test_import_and_route(spark, tmp_path, capsys):
    (tmp_path / "a.osm").write_text(document())
    place = tmp_path / "s.json"
    place.write_text(json.dumps({"datareader.file": str(tmp_path / "a.osm"), "graph.location": str(tmp_path / "g"), "profiles": [{"name": "car"}], "import.osm.ignored_highways": "footway, path"}))
    assert command.main(["import", str(place)]) == 0
    edges = spark.read.parquet(str(tmp_path / "g" / "edges"))
    assert {(r.a, r.b) for r in edges.collect()} == {(1, 3), (3, 4), (4, 5), (5, 7), (-8, 1)}
    capsys.readouterr()
    assert command.main(["route", "--config", str(place), "--profile", "car", "--point", "45.0001,5.005", "--point", "45.0101,5.01"]) == 0
    out = json.loads(capsys.readouterr().out)
    (path,) = out["paths"]
    points = lines.decode_polyline(path["points"])
    assert points[0] == (45.0, 5.005) and points[-1] == (45.01, 5.01)
    assert {(45.0, 5.02), (45.005, 5.03), (45.01, 5.02)} < set(points)
    assert len(lines.decode_polyline(path["snapped_waypoints"])) == 2
    walked = 1000 * sum(command_length(a, b) for a, b in zip(points, points[1:], strict=False)) / 1000
    assert path["distance"] == pytest.approx(walked, rel=1e-3) and path["time"] > 0
    assert [i["sign"] for i in path["instructions"]] == [0, 4] and out["hints"]["visited_nodes.sum"] > 0
    # The bollard closes the way on, and the one-way street the way back.
    assert command.main(["route", "--config", str(place), "--profile", "car", "--point", "45.0101,5.01", "--point", "45.0001,5.005"]) == 1
    assert "no connection" in capsys.readouterr().err
    assert command.main(["route", "--config", str(place), "--profile", "bike", "--point", "45,5", "--point", "45,5"]) == 1
    assert command.main(["route", "--config", str(place), "--profile", "car", "--point", "10,5", "--point", "45,5"]) == 1


def command_length(a, b):
    from wayloom.operators.paths import _beeline

    return _beeline(*a, *b)


def test_empty_import_is_refused(spark, tmp_path, capsys):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1" lon="1"/></osm>')
    place = tmp_path / "s.json"
    place.write_text(json.dumps({"datareader.file": str(tmp_path / "a.osm"), "graph.location": str(tmp_path / "g")}))
    assert command.main(["import", str(place)]) == 1
    assert "empty" in capsys.readouterr().err


def test_settings():
    s = settings.Settings.of({"graph": {"profiles": [{"name": "car", "speed": 3}], "profiles_ch": [{"profile": "car"}], "x": "a, b,,c", "n": "5", "f": "true"}, "server": {"port": 1}})
    assert s.profiles[0].weighting == "custom" and s.profiles[0].hints == {"speed": 3} and s.prepared == ["car"]
    assert s.words("x") == ["a", "b", "c"] and s.number("n", 1) == 5 and s.flag("f") and s.text("graph.location") == "graph-cache"
    assert settings.Settings.of({"server": {}}).profiles == [] and settings.parse("").properties["graph.location"] == "graph-cache"
    pytest.importorskip("yaml")
    assert settings.parse("profiles:\n  - name: car\ngraph.location: here\n").text("graph.location") == "here"


@pytest.mark.parametrize("raw", [
    {"profiles": [{"name": ""}]}, {"profiles": [{"name": "Car"}]}, {"profiles": [{"name": "a"}, {"name": "a"}]}, {"profiles": [{"name": "a", "weighting": "fastest"}]}, {"profiles_ch": [{"profile": "b"}]}, {"profiles_ch": [{}]},
    {"profiles": [{"name": "a"}], "profiles_ch": [{"profile": "a"}, {"profile": "a"}]}, {"profiles": [{"name": "a"}, {"name": "b"}], "profiles_lm": [{"profile": "a", "preparation_profile": "b"}]},
    {"profiles": [{"name": "a"}, {"name": "b"}, {"name": "c"}], "profiles_lm": [{"profile": "a", "preparation_profile": "b"}, {"profile": "b", "preparation_profile": "c"}, {"profile": "c"}]},
])
def test_refused_settings(raw):
    with pytest.raises(ValueError):
        settings.Settings.of(raw)


def test_parts_of_lines():
    line = [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)]
    assert lines.part_of_line(line, 0, 1) == line
    assert [tuple(round(x, 9) for x in p) for p in lines.part_of_line(line, 0.25, 0.75)] == [(0.0, 0.5), (0.0, 1.0), (0.0, 1.5)]
    assert lines.part_of_line([(1.0, 1.0), (1.0, 1.0)], 0.5, 1) == [(1.0, 1.0), (1.0, 1.0)]
