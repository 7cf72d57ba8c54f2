"""Coverage files: naming, GeoPackage parsing and the idempotent load."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from covgrid.sources import coverage_files as CF


def wkb_polygon(rings, order="<"):
    b = struct.pack(order + "BI", 1 if order == "<" else 0, 3) + struct.pack(order + "I", len(rings))
    for ring in rings:
        b += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "dd", x, y) for x, y in ring)
    return b


def gpkg_blob(wkb, envelope=None):
    flags = 1 | ((1 if envelope else 0) << 1)
    head = b"GP" + bytes([0, flags]) + struct.pack("<i", 2154)
    if envelope:
        head += struct.pack("<4d", *envelope)
    return head + wkb


def sq(cx, cy, h):
    return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)]


def make_gpkg(path, geoms):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT,"
                " srs_id INTEGER, z INTEGER, m INTEGER)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('couv', 'geom', 'MULTIPOLYGON', 2154, 0, 0)")
    con.execute("CREATE TABLE couv (fid INTEGER PRIMARY KEY, geom BLOB)")
    con.executemany("INSERT INTO couv (geom) VALUES (?)", [(g,) for g in geoms])
    con.commit()
    con.close()


def test_file_names(spark):
    df = CF.source_files(spark, ["2025_T3"], ["4G"], "/data")
    got = {r["operator_code"]: r["source_file"] for r in df.collect()}
    assert got["BYT"] == "2025_T3_couv_Metropole_BOUY_4G_data.gpkg.7z"
    assert got["SFR"] == "2025_T3_couv_Metropole_SFR0_4G_data.gpkg.7z"
    assert len(got) == 4


def test_gpkg_blob_parsing():
    multi = struct.pack("<BII", 1, 6, 2) + wkb_polygon([sq(0, 0, 2), sq(0, 0, 1)]) + wkb_polygon([sq(10, 0, 1)], ">")
    rings = CF.gpkg_rings(gpkg_blob(multi, envelope=(-2, 11, -2, 2)))
    assert [(p, r, len(x)) for p, r, x, _ in rings] == [(0, 0, 5), (0, 1, 5), (1, 0, 5)]
    assert rings[2][2][0] == 9.0


def test_read_and_load(spark, tmp_path):
    f = tmp_path / "a.gpkg"
    make_gpkg(str(f), [gpkg_blob(wkb_polygon([sq(i * 10.0, 0, 2)])) for i in range(150)])
    files = spark.createDataFrame([(str(f), "2025_T3", "OF", "4G", "a.gpkg")],
                                  "path string, quarter string, operator_code string, technology string, "
                                  "source_file string")
    cov = CF.read_geopackages(files)
    rows = cov.orderBy(F.col("rings")[0]["pts"][0]["x"]).collect()
    assert len(rows) == 150
    assert rows[3]["rings"][0]["pts"][0]["x"] == pytest.approx(28.0)
    table = str(tmp_path / "raw_coverage")
    (r1,) = CF.load_coverage(cov, table).collect()
    (r2,) = CF.load_coverage(cov, table).collect()  # reload: same count, no duplicates
    assert r1["geometry_count"] == r2["geometry_count"] == 150


def test_second_file_of_a_partition_keeps_the_first(spark, tmp_path):
    rows = [(1, "2025_T3", "OF", "4G", "data", [], "a.gpkg"), (2, "2025_T3", "OF", "4G", "data", [], "b.gpkg")]
    kind = ("id long, quarter string, operator_code string, technology string, usage string, "
            "rings array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>, source_file string")
    table = str(tmp_path / "coverage")
    for r in (rows[0], rows[1], rows[1]):
        CF.load_coverage(spark.createDataFrame([r], kind), table)
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [1, 2]


def test_line_lengths_of_several_files(spark, tmp_path):
    import json

    from covgrid.sources import geojson as GJ

    for i in range(2):
        feature = {"type": "Feature", "properties": {"code_ligne": f"00{i}", "libelle": GJ.OPERATED_STATUS},
                   "geometry": {"type": "LineString", "coordinates": [[2.0 + i, 48.0], [2.1 + i, 48.0]]}}
        (tmp_path / f"{i}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))

    def lengths(path):
        return {r["line_id"]: round(r["length_km"], 6) for r in GJ.line_features(GJ.read_features(spark, path))[0].collect()}

    both = lengths(str(tmp_path))
    assert both == lengths(str(tmp_path / "0.json")) | lengths(str(tmp_path / "1.json")) and len(both) == 2


def test_means_do_not_overflow(spark):
    from covgrid.functions import expr as E

    got = spark.range(200_000_000).selectExpr("51.0D AS lat").agg(E.mean_exact("lat").alias("m")).first()["m"]
    assert got == 51.0


def test_a_file_of_several_layers_is_refused(tmp_path):
    path = str(tmp_path / "two.gpkg")
    make_gpkg(path, [gpkg_blob(wkb_polygon([sq(0, 0, 2)]))])
    con = sqlite3.connect(path)
    assert CF._feature_table(con, path)
    con.execute("INSERT INTO gpkg_geometry_columns (table_name, column_name) VALUES ('other', 'geom')")
    with pytest.raises(ValueError, match="2 layers"):
        CF._feature_table(con, path)
    con.close()
