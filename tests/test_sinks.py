"""Exports: partitioned GeoJSON feature files, prepared-feature reads, CSV."""

import json
import os

from covgrid import schema
from covgrid.plans import antennas as A
from covgrid.plans import coverage as C
from covgrid.sources import fixtures as FX
from covgrid.sources import sinks

SF = "/root/testdata/sf0.001"


def test_coverage_features_roundtrip(spark, tmp_path):
    t = FX.load(spark, SF)
    feats = C.coverage_features(C.simplified_coverage(t.coverage), schema.ref_operators(spark), "4G")
    out = str(tmp_path / "geojson")
    sinks.write_features(feats, out, ["operator", "technology"])
    got = sinks.read_features_or_empty(spark, out, operator="OF", technology="4G")
    n = feats.filter("operator = 'OF'").count()
    assert got.count() == n > 0
    f = json.loads(got.first()["feature"])
    assert f["type"] == "Feature" and f["geometry"]["type"] == "MultiPolygon"
    assert f["properties"]["operator_name"] == "Orange"
    lon, lat = f["geometry"]["coordinates"][0][0][0]
    assert -6 < lon < 11 and 41 < lat < 52
    # an operator/technology never exported reads as an empty collection
    assert sinks.read_features_or_empty(spark, out, operator="XX", technology="4G").count() == 0


def test_antenna_csv_export(spark, tmp_path):
    t = FX.load(spark, SF)
    rows = A.antenna_export(t.sites, None, "OF", "4G")
    out = str(tmp_path / "csv")
    sinks.write_csv(rows, out)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    header = open(os.path.join(out, files[0])).readline().strip()
    assert header == "id,operator,latitude,longitude,commune_code,technology"
    back = spark.read.option("header", True).csv(out)
    assert back.count() == rows.count()
