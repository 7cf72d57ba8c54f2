"""Edge cases of the user-level queries and plan-shape checks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from covgrid import schema
from covgrid.operators import geometry as G
from covgrid.plans import antennas as A
from covgrid.plans import coverage as C
from covgrid.plans import rail as RL
from covgrid.plans import report as RP
from covgrid.sources import fixtures as FX

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return FX.load(spark, SF)


def test_nearby_strict_vs_reference_box(spark, tables):
    ref = A.nearby_antennas(tables.sites, 46.5, 2.5, 50.0, None, 200, strict=False)
    strict = A.nearby_antennas(tables.sites, 46.5, 2.5, 50.0, limit=None)
    assert ref.count() == 90  # reference box (trap: too narrow east-west, corners beyond radius)
    assert strict.count() == 105
    assert strict.agg(F.max("distance_km")).first()[0] <= 50.0
    assert ref.agg(F.max("distance_km")).first()[0] > 50.0


def test_parameter_bounds(tables):
    with pytest.raises(ValueError):
        A.antenna_list(tables.sites, limit=1001)
    with pytest.raises(ValueError):
        A.nearby_antennas(tables.sites, 46.5, 2.5, radius_km=0)
    with pytest.raises(ValueError):
        A.search_antennas(tables.sites, "31003", "4G", limit=0)


def test_transfers_empty_lists(spark, tables):
    lines = G.lines_table(tables.line_vertices, tables.stations)
    assert RL.transfers(tables.line_vertices, lines, tables.stations, [], ["000064"], 0, 0, 0, 0).count() == 0


def test_route_segment_sampling(spark):
    # 200-vertex straight line, fractions 0 and 1: every vertex, or 150 sampled
    # and the last = 151.
    rows = [("L", 1, 0, i, 700000.0 + 100.0 * i, 6600000.0 + 50.0 * i) for i in range(200)]
    v = spark.createDataFrame(rows, "line_id string, feature long, part int, seq int, x double, y double")
    lines = G.lines_table(v, spark.createDataFrame([], schema.STATIONS_SCHEMA))
    start = (46.4, 2.9)   # before the first vertex (south-west)
    end = (47.5, 5.0)     # beyond the last vertex (north-east)
    (r,) = RL.route_segment(v, lines, "L", *start, *end).collect()
    assert len(r["coordinates"]) == 200
    (r,) = RL.route_segment(v, lines, "L", *start, *end, max_points=150).collect()
    assert len(r["coordinates"]) == 151


def test_sample_sites_and_dimensions(spark):
    s = A.sample_sites(spark)
    assert s.select("operator").distinct().count() == 4
    assert s.agg(F.min("id"), F.max("id")).first() == (1, s.count())
    d = RP.dimension_lists(schema.ref_operators(spark), schema.ref_technologies(spark)).collect()
    assert [r["code"] for r in d if r["kind"] == "operator"] == ["BYT", "FREE", "OF", "SFR"]
    assert [r["code"] for r in d if r["kind"] == "technology"] == ["2G", "3G", "4G", "5G"]


def test_seed_is_idempotent(spark):
    ops = schema.ref_operators(spark)
    once = RP.seed_refs(ops.limit(0), ops)
    twice = RP.seed_refs(once, ops)
    assert once.count() == twice.count() == 4


def test_no_nested_loop_or_cartesian_in_spatial_plans(spark):
    for key in ("route_coverage", "transfers", "operators_at_point"):
        plan = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, key


def test_columns_pruned_at_the_scan(spark):
    df = entry.queries()["nearby_antennas"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_box_filter_pushed_into_stored_sites(spark, tables, tmp_path):
    path = str(tmp_path / "sites")
    tables.sites.write.parquet(path)
    df = A.nearby_antennas(spark.read.parquet(path), 46.5, 2.5, 50.0, "4G", 20)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "latitude" in pushed and "longitude" in pushed and "technology" in pushed
    assert df.count() == 20


def test_unknown_commune_has_total_zero(tables):
    (r,) = A.commune_summary(tables.sites, "nowhere").collect()
    assert (r["commune_code"], r["count"], r["total"]) == ("nowhere", 0, 0)
    assert r["operator"] is None and r["center_lat"] is None and r["center_lon"] is None


def test_coverage_near_keeps_what_meets_the_extent(spark, tables):
    line = tables.line_vertices.filter("line_id = '000002'")
    stored = C.simplified_coverage(tables.coverage.filter("technology = '4G'"))
    box = line.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    want = {r["id"] for r in stored.collect() if r["bbox_xmin"] <= box[2] and r["bbox_xmax"] >= box[0]
            and r["bbox_ymin"] <= box[3] and r["bbox_ymax"] >= box[1]}
    raw = C.coverage_near(tables.coverage.filter("technology = '4G'"), line)
    assert {r["id"] for r in raw.select("id").collect()} == want
    assert {r["id"] for r in C.coverage_near(stored, line).select("id").collect()} == want
    assert 0 < len(want) < stored.count()


def test_route_contract_checks_counts_each_violation(spark):
    rows = [("1", "OF", 10.0, 5.0, 50.0), ("2", "OF", 10.0, 5.0, 101.0), ("3", None, 10.0, 5.0, 50.0),
            ("4", "OF", 10.0, 10.5, 100.0), ("5", "OF", 10.0, -1.0, 0.0)]
    kind = "line_id string, operator string, total_length_km double, covered_length_km double, coverage_pct double"
    assert C.route_contract_checks(spark.createDataFrame(rows, kind)).first().asDict() == {
        "rows_checked": 5, "pct_out_of_range": 1, "negative_length": 1, "covered_over_total": 1, "missing_required": 1}


def test_two_points_located_in_one_pass(spark):
    segs = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 0.0, 10.0), (1, 0, 1, 10.0, 0.0, 10.0, 30.0, 30.0)],
                                 "feature long, part int, seg int, x1 double, y1 double, x2 double, y2 double, len double")
    (r,) = RL.locate_fractions(segs, {"a": (5.0, 1.0), "b": (11.0, 20.0)}).collect()
    assert (r["a"], r["b"]) == (5.0 / 40.0, 30.0 / 40.0)
