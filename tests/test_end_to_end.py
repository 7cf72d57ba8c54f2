"""GeoPackage files -> partitioned load -> simplified coverage -> route
coverage, checked against closed-form lengths."""

import pytest
from pyspark.sql import functions as F

from covgrid import schema
from covgrid.operators import geometry as G
from covgrid.plans import coverage as C
from covgrid.plans import report as RP
from covgrid.sources import coverage_files as CF
from test_sources import gpkg_blob, make_gpkg, sq, wkb_polygon


def test_geopackage_to_route_coverage(spark, tmp_path):
    # two 40 km squares for Orange (one with a 20 km hole), one for an
    # operator code missing from the dimension
    make_gpkg(str(tmp_path / "of.gpkg"), [gpkg_blob(wkb_polygon([sq(700000, 6600000, 20000),
                                                                  sq(700000, 6600000, 10000)])),
                                          gpkg_blob(wkb_polygon([sq(760000, 6600000, 20000)]))])
    make_gpkg(str(tmp_path / "xx.gpkg"), [gpkg_blob(wkb_polygon([sq(700000, 6600000, 20000)]))])
    files = spark.createDataFrame(
        [(str(tmp_path / "of.gpkg"), "2025_T3", "OF", "4G", "of.gpkg"),
         (str(tmp_path / "xx.gpkg"), "2025_T3", "XX", "4G", "xx.gpkg")],
        "path string, quarter string, operator_code string, technology string, source_file string")
    table = str(tmp_path / "raw_coverage")
    counts = {r["source_file"]: r["geometry_count"] for r in CF.load_coverage(CF.read_geopackages(files), table).collect()}
    assert counts == {"of.gpkg": 2, "xx.gpkg": 1}
    coverage = spark.read.parquet(table)

    # a straight east-west line from x=650 km to x=800 km at the squares' centre height, 1 km steps
    rows = [("L1", 1, 0, i, 650000.0 + 1000.0 * i, 6600000.0 + 0.5) for i in range(151)]
    v = spark.createDataFrame(rows, "line_id string, feature long, part int, seq int, x double, y double")
    lines = G.lines_table(v, spark.createDataFrame([], schema.STATIONS_SCHEMA))
    stg = C.simplified_coverage(coverage)
    got = {r["operator"]: r for r in C.route_coverage(v, lines, stg, schema.ref_operators(spark)).collect()}
    # Orange: 40 km minus the 20 km hole, plus 40 km = 60 km of 150 km
    assert got["OF"]["covered_length_km"] == 60.0
    assert got["OF"]["coverage_pct"] == 40.0
    assert got["OF"]["total_length_km"] == pytest.approx(150.0)
    # unknown operator code is kept, without a name
    assert got["XX"]["covered_length_km"] == 40.0 and got["XX"]["operator_name"] is None

    stats = {r["operator"]: r for r in RP.coverage_stats(coverage, schema.ref_operators(spark), "4G").collect()}
    assert stats["OF"]["geometry_count"] == 2 and stats["OF"]["operator_name"] == "Orange"
    assert stats["XX"]["geometry_count"] == 1 and stats["XX"]["operator_name"] is None
