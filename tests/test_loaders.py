"""GeoJSON loaders on hand-made files (lines: 5 features, stations: 6)."""

import json

import pytest

from covgrid.sources import geojson as GJ

LINES = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"code_ligne": "001000", "libelle": "Exploitée"},
     "geometry": {"type": "LineString", "coordinates": [[2.35, 48.85], [2.45, 48.95]]}},
    {"type": "Feature", "properties": {"code_ligne": "002000", "libelle": "Exploitée"},
     "geometry": {"type": "MultiLineString", "coordinates": [[[1.0, 47.0], [1.1, 47.0]], [[1.2, 47.0], [1.3, 47.0]]]}},
    {"type": "Feature", "properties": {"code_ligne": "003000", "libelle": "Neutralisée"},
     "geometry": {"type": "LineString", "coordinates": [[3.0, 45.0], [3.1, 45.1]]}},
    {"type": "Feature", "properties": {"code_ligne": "004000", "libelle": "Exploitée"}, "geometry": None},
    {"type": "Feature", "properties": {"libelle": "Exploitée"},
     "geometry": {"type": "LineString", "coordinates": [[4.0, 44.0], [4.0, 44.1]]}},
]}
STATIONS = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"code_uic": "87271007", "libelle": "Paris Nord", "code_ligne": "001000",
                                       "commune": "Paris", "departemen": "Paris", "voyageurs": "O"},
     "geometry": {"type": "Point", "coordinates": [2.355, 48.880]}},
    {"type": "Feature", "properties": {"code_uic": "1", "libelle": "Fret", "code_ligne": "001000", "voyageurs": "N"},
     "geometry": {"type": "Point", "coordinates": [2.4, 48.9]}},
    {"type": "Feature", "properties": {"code_uic": "2", "libelle": "Zone", "voyageurs": "O"},
     "geometry": {"type": "Polygon", "coordinates": [[[2, 48], [3, 48], [3, 49], [2, 48]]]}},
    {"type": "Feature", "properties": {"code_uic": "3", "libelle": "Nulle", "voyageurs": "O"}, "geometry": None},
    {"type": "Feature", "properties": {"code_uic": "4", "libelle": "Outre-mer", "voyageurs": "O"},
     "geometry": {"type": "Point", "coordinates": [-61.0, 14.6]}},
    {"type": "Feature", "properties": {"code_uic": "5", "libelle": "Saint-Denis", "code_ligne": "001000",
                                       "departemen": "Seine-Saint-Denis", "voyageurs": "O"},
     "geometry": {"type": "Point", "coordinates": [2.44, 48.93]}},
]}


@pytest.fixture
def files(tmp_path):
    lp, sp = tmp_path / "lines.geojson", tmp_path / "stations.geojson"
    lp.write_text(json.dumps(LINES), encoding="utf-8")
    sp.write_text(json.dumps(STATIONS), encoding="utf-8")
    return str(lp), str(sp)


def test_line_loader(spark, files):
    lines, vertices = GJ.line_features(GJ.read_features(spark, files[0]))
    got = {r["line_id"]: r for r in lines.collect()}
    assert set(got) == {"001000", "002000", ""}
    assert all(r["line_name"] == "" for r in got.values())
    assert vertices.filter("line_id = '002000'").select("part").distinct().count() == 2
    # ~0.1 degree of longitude at 47 N in two parts: about 7.6 km each
    assert got["002000"]["length_km"] == pytest.approx(2 * 7.6, rel=0.02)


def test_station_loader_and_names(spark, files):
    st = GJ.station_features(GJ.read_features(spark, files[1]))
    rows = {r["station_id"]: r for r in st.collect()}
    assert set(rows) == {"87271007", "5"}
    assert rows["5"]["commune"] == ""
    lines, _ = GJ.line_features(GJ.read_features(spark, files[0]))
    for loaded in (st, lines, GJ.named_lines(lines, st)):
        assert loaded.schema["ingested_at"].dataType.typeName() == "timestamp"
    named = {r["line_id"]: r["line_name"] for r in GJ.named_lines(lines, st).collect()}
    assert named["001000"] == "Paris Nord — Saint-Denis"
    assert named["002000"] == ""


def test_equal_lines_of_a_sequence_are_all_kept(spark, tmp_path):
    one = {"type": "Feature", "properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1.0, 45.0]}}
    two = {**one, "properties": {"a": "2"}}
    path = tmp_path / "rows.geojsonl"
    path.write_text("".join(json.dumps(f) + "\n" for f in (one, two, one, one)))
    rows = [sorted((r["feature"], r["properties"]["a"]) for r in GJ.read_features(spark, str(path), seq=True).collect())
            for _ in range(2)]
    assert rows[0] == rows[1] and len({f for f, _ in rows[0]}) == 4
    assert sorted(a for _, a in rows[0]) == ["1", "1", "1", "2"]
