"""Loads of blobs and of feature files, read back."""

import json

from pyspark.sql import functions as F

from covgrid.plans import loads as LD
from covgrid.schema import COVERAGE_SCHEMA
from covgrid.sources import coverage_files as CF
from covgrid.sources import geojson as GJ


def ring(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


ROWS = [
    (1, "2025_T3", "OF", "4G", "data", [(0, 0, ring(0.0, 0.0, 4.0)), (0, 1, ring(0.0, 0.0, 1.0)), (1, 0, ring(50.0, 0.0, 2.0))], "a"),
    (2, "2025_T3", "OF", "4G", "data", [], "a"),
    (3, "2025_T3", "OF", "4G", "data", None, "a"),
    (4, "2025_T3", "SFR", "4G", "data", [(0, 0, ring(9.0, 9.0, 3.0))], "b"),
]


def test_blobs_give_the_same_rings_back(spark):
    cov = spark.createDataFrame(ROWS * 20, COVERAGE_SCHEMA).repartition(3)
    back = CF.parse_blobs(CF.encode_blobs(cov)).select(cov.columns)
    want = cov.withColumn("rings", F.coalesce("rings", F.array().cast(COVERAGE_SCHEMA["rings"].dataType)))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_null_blob_and_empty_table(spark):
    blobs = spark.createDataFrame([(7, None)], "id long, geom binary")
    assert [tuple(r) for r in CF.parse_blobs(blobs).collect()] == [(7, [])]
    assert CF.parse_blobs(blobs.limit(0)).columns == ["id", "rings"]
    assert CF.parse_blobs(blobs.limit(0)).count() == 0


def test_loading_a_file_again_leaves_the_others(spark, tmp_path):
    blobs = CF.encode_blobs(spark.createDataFrame(ROWS, COVERAGE_SCHEMA))
    table = LD.load_twice(blobs, blobs.where("source_file = 'b'"), str(tmp_path / "raw"))
    got = {r["source_file"]: r for r in LD.coverage_load(table).collect()}
    assert (got["a"]["geometry_count"], got["a"]["points"], got["a"]["area_m2"]) == (3, 15, 64 - 4 + 16)
    assert (got["b"]["geometry_count"], got["b"]["points"], got["b"]["area_m2"]) == (1, 5, 36)
    plan = table.where("operator_code = 'SFR'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "operator_code" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_line_repeated_very_often(spark, tmp_path):
    one = {"type": "Feature", "properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1.0, 45.0]}}
    n = 2 * GJ.EQUAL_LINES + 5
    (tmp_path / "rows.geojsonl").write_text("\n" + (json.dumps(one) + "\n") * n)
    rows = GJ.read_features(spark, str(tmp_path), seq=True)
    assert rows.count() == n and rows.select("feature").distinct().count() == n
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    first = rows.first()
    assert first["properties"] == {"a": "1"} and json.loads(first["geometry"]["coordinates"]) == [1.0, 45.0]
