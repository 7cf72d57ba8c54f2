"""Hand-made geometry cases: clipping, holes, touching, adjacency, locate."""

import math

import pytest
from pyspark.sql import functions as F

from covgrid.operators import geometry as G
from covgrid.operators import spatial as S
from covgrid.plans import rail as RL


def square(cx, cy, h):
    return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)]


def polys(spark, rows):
    """rows: (id, operator, [rings as point lists])"""
    data = [(pid, op, 0, k, [{"x": float(x), "y": float(y)} for x, y in ring])
            for pid, op, rings in rows for k, ring in enumerate(rings)]
    return spark.createDataFrame(
        data, "id long, operator_code string, part int, ring int, pts array<struct<x:double,y:double>>")


def line(spark, pts, feature=1, line_id="L1", part=0):
    rows = [(line_id, feature, part, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "line_id string, feature long, part int, seq int, x double, y double")


def covered(spark, line_pts, poly_rows, cell=3.0):
    segs = G.segments(line(spark, line_pts))
    out = S.covered_length(segs, polys(spark, poly_rows), cell=cell).collect()
    return {r["id"]: r["inside_m"] for r in out}


def test_segment_through_square(spark):
    got = covered(spark, [(0, 0), (10, 0)], [(1, "OF", [square(3, 0, 1)])])
    assert got[1] == pytest.approx(2.0)


def test_square_with_hole(spark):
    got = covered(spark, [(0, 0), (10, 0)], [(1, "OF", [square(3, 0, 1), square(3, 0, 0.5)])])
    assert got[1] == pytest.approx(1.0)


def test_segment_wholly_inside(spark):
    got = covered(spark, [(1, 1), (2, 2)], [(1, "OF", [square(0, 0, 50)])], cell=10.0)
    assert got[1] == pytest.approx(math.sqrt(2))


def test_corner_touch_keeps_zero_row(spark):
    got = covered(spark, [(0, 10), (10, 0)], [(1, "OF", [square(6.5, 6.5, 1.5)])])
    assert got == {1: 0.0}


def test_segment_ending_on_edge(spark):
    got = covered(spark, [(0, 0.5), (2, 0.5)], [(1, "OF", [square(3, 0, 1)])])
    assert got == {1: 0.0}
    got = covered(spark, [(0, 0.5), (3, 0.5)], [(1, "OF", [square(3, 0, 1)])])
    assert got[1] == pytest.approx(1.0)


def test_untouched_polygon_absent(spark):
    got = covered(spark, [(0, 0), (10, 0)], [(1, "OF", [square(3, 0, 1)]), (2, "SFR", [square(3, 5, 1)])])
    assert set(got) == {1}


def test_multi_segment_line_across_cells(spark):
    # zig-zag through a big square with a hole, many cells
    pts = [(0, 0), (30, 4), (60, -4), (90, 0)]
    got = covered(spark, pts, [(1, "OF", [square(45, 0, 30), square(45, 0, 5)])], cell=7.0)
    # brute force: sample the line densely
    inside = 0.0
    for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
        n = 20000
        L = math.hypot(x2 - x1, y2 - y1)
        for i in range(n):
            t = (i + 0.5) / n
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            if 15 < x < 75 and -30 < y < 30 and not (40 < x < 50 and -5 < y < 5):
                inside += L / n
    assert got[1] == pytest.approx(inside, rel=1e-3)


def test_adjacency_threshold(spark):
    a = G.segments(line(spark, [(0, 0), (1000, 0)], feature=1, line_id="A"))
    b = G.segments(line(spark, [(0, 499), (1000, 499)], feature=2, line_id="B"))
    c = G.segments(line(spark, [(0, -501), (1000, -501)], feature=3, line_id="C"))
    adj = RL.line_adjacency(a, b.unionByName(c)).collect()
    assert {r["line_b"] for r in adj} == {"B"}
    assert adj[0]["contact"]["d"] == pytest.approx(499.0)


def test_crossing_contact_point(spark):
    a = G.segments(line(spark, [(0, 0), (10, 10)], feature=1, line_id="A"))
    b = G.segments(line(spark, [(0, 10), (10, 0)], feature=2, line_id="B"))
    (r,) = RL.line_adjacency(a, b).collect()
    assert r["contact"]["d"] == 0.0
    assert (r["contact"]["x"], r["contact"]["y"]) == pytest.approx((5.0, 5.0))


def test_locate_midpoint_of_l_shape(spark):
    segs = G.segments(line(spark, [(0, 0), (10, 0), (10, 10)]))
    (r,) = RL.locate_fraction(segs, 10.5, 0.0, "f").collect()
    assert r["f"] == pytest.approx(0.5)


def test_line_lengths_fold(spark):
    segs = G.segments(line(spark, [(0, 0), (3000, 4000), (3000, 5000)]))
    (r,) = G.line_lengths(segs).collect()
    assert r["length_km"] == pytest.approx(6.0)


def test_multipart_line(spark):
    v = line(spark, [(0, 0), (10, 0)], part=0).unionByName(line(spark, [(20, 0), (30, 0)], part=1))
    segs = G.segments(v)
    assert segs.count() == 2  # no segment bridges the gap between parts
    (r,) = G.line_lengths(segs).collect()
    assert r["length_km"] == pytest.approx(0.02)


def test_pick_feature_for_duplicate_line_id(spark):
    lines = spark.createDataFrame([("X", 5, "", 2.0), ("X", 3, "", 2.0), ("X", 9, "", 1.0)],
                                  "line_id string, feature long, line_name string, length_km double")
    (r,) = G.pick_features(lines).collect()
    assert r["feature"] == 3


WALK_CASES = [
    ([(0, 0), (10, 0)], [(1, "OF", [square(3, 0, 1)])], 3.0),
    ([(0, 0), (10, 0)], [(1, "OF", [square(3, 0, 1), square(3, 0, 0.5)])], 3.0),
    ([(1, 1), (2, 2)], [(1, "OF", [square(0, 0, 50)])], 10.0),
    ([(0, 10), (10, 0)], [(1, "OF", [square(6.5, 6.5, 1.5)])], 3.0),
    ([(0, 0.5), (3, 0.5)], [(1, "OF", [square(3, 0, 1)])], 3.0),
    # passes exactly through polygon vertices and runs along an edge
    ([(0, 0), (2, -1), (4, -1), (6, 0)], [(1, "OF", [square(3, 0, 1)])], 3.0),
    # starts inside a box and inside the polygon, many cells, hole on the way
    ([(20, 1), (30, 4), (60, -4), (90, 0)], [(1, "OF", [square(45, 0, 30), square(45, 0, 5)])], 7.0),
]


@pytest.mark.parametrize("case", range(len(WALK_CASES)))
def test_walk_matches_ray(spark, case):
    pts, rows, cell = WALK_CASES[case]
    segs = G.segments(line(spark, pts))
    p = polys(spark, rows)
    got = {}
    for mode in ("ray", "walk"):
        out = S.covered_length(segs, p, cell=cell, inside=mode).collect()
        got[mode] = {r["id"]: round(r["inside_m"], 9) for r in out}
    assert got["ray"] == got["walk"]


def test_vertices_are_not_sent_through_the_driver(spark):
    """Exploded vertices are estimated at a fraction of their size: the plans that read those of all lines never broadcast them."""
    from pyspark.sql import functions as F

    from covgrid.plans import coverage as C
    from covgrid.plans import rail as RL
    v = spark.range(50).select(F.col("id").cast("string").alias("line_id"), F.col("id").alias("feature"), F.lit(0).alias("part"),
                               F.explode(F.sequence(F.lit(0), F.lit(44))).alias("seq")).selectExpr(
        "*", "CAST(feature * 5000 + seq * 300 AS DOUBLE) AS x", "CAST(seq % 2 * 400 + seq * 100 AS DOUBLE) AS y")
    stations = spark.createDataFrame([("s1", "Gare", "1", 47.0, 2.0)],
                                     "station_id string, station_name string, line_code string, latitude double, longitude double")
    lines = G.lines_table(v, stations)
    ring = [{"part": 0, "ring": 0, "pts": [(0.0, 0.0), (9e3, 0.0), (9e3, 9e3), (0.0, 9e3), (0.0, 0.0)]}]
    stg = spark.createDataFrame([(1, "OF", "4G", ring)], "id long, operator_code string, technology string, "
                                "rings array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>")
    operators = spark.createDataFrame([("OF", "Orange")], "code string, name string")
    for df in (lines, C.route_coverage(v, lines, stg, operators), RL.station_places(stations, v, lines)):
        text = df._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in text.splitlines() if "Join" in x and "seq#" in x]
        assert joins and not [x for x in joins if "Broadcast" in x]
    assert lines.count() == 50
