"""Quadtree leaves of the line and polygon join, and coverage that counts overlaps once."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from covgrid import catalog
from covgrid.operators import geometry as G
from covgrid.operators import spatial as S

SEGS = "line_id string, feature long, part int, seq int, x double, y double"
RINGS = "id long, operator_code string, part int, ring int, pts array<struct<x:double,y:double>>"


def square(i, op, x0, y0, x1, y1):
    return (i, op, 0, 0, [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])


def walks(n, seed, size=9_000.0, steps=30):
    """Lines that stay inside one cell of 10 km."""
    rng, out = random.Random(seed), []
    for f in range(n):
        x, y = rng.uniform(0, size), rng.uniform(0, size)
        for i in range(steps):
            out.append((f"L{f}", f, 0, i, x, y))
            x, y = (min(size, max(0.0, v + rng.uniform(-200, 210))) for v in (x, y))
    return out


def boxes(df):
    return S._box(df, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), "s")


def test_dense_cell_spreads(spark):
    """All segments in one 10 km cell: many leaves, none of them with much more than the limit."""
    segs = G.segments(spark.createDataFrame(walks(200, 1), SEGS))
    places = segs.select(F.col("x1").alias("x"), F.col("y1").alias("y"))
    dense = S.dense_cells(places, 40_000.0, limit=300)
    cells = S.quad_cells(boxes(segs), "sx0", "sy0", "sx1", "sy1", dense, 40_000.0)
    n = sorted(r["count"] for r in cells.groupBy("qd", "cx", "cy").count().collect())
    assert segs.select(E_cell("x1"), E_cell("y1")).distinct().count() == 1
    assert len(n) >= 20 and n[-1] <= 600  # a segment over a border counts in both leaves
    # as a join key this fills the tasks of a shuffle
    used = cells.repartition(16, "qd", "cx", "cy").groupBy(F.spark_partition_id()).count().count()
    assert used >= 12


def E_cell(name):
    return F.floor(F.col(name) / 10_000.0).alias(name)


def test_leaves_partition_the_plane(spark):
    """Each place is in exactly one leaf; a leaf over the limit is on the last level."""
    rng = random.Random(2)
    pts = [(rng.gauss(-300, 40), rng.gauss(500, 25)) for _ in range(3000)] + [(rng.uniform(-4e3, 4e3),) * 2 for _ in range(99)]
    df = spark.createDataFrame(pts, "x double, y double").withColumn("i", F.monotonically_increasing_id())
    dense = S.dense_cells(df, 1000.0, depth=4, limit=50)
    leaves = S.quad_cells(df, "x", "y", "x", "y", dense, 1000.0, depth=4)
    assert leaves.count() == len(pts) == leaves.select("i").distinct().count()
    for r in leaves.groupBy("qd", "cx", "cy").count().collect():
        assert r["count"] <= 50 or r.qd == 4
    wrong = leaves.where("floor(x / (1000D / shiftleft(1, qd))) <> cx OR floor(y / (1000D / shiftleft(1, qd))) <> cy")
    assert wrong.count() == 0


@pytest.mark.parametrize("limit", [5, 60, 10 ** 9])
def test_same_lengths_whatever_the_leaves(spark, limit):
    rng = random.Random(7)
    segs = G.segments(spark.createDataFrame(walks(12, 3, 30_000.0, 12) + [("Z", 99, 0, 0, -5e4, 1e4), ("Z", 99, 0, 1, 9e4, 1.1e4)], SEGS))
    rings = []
    for i in range(30):
        x, y, h = rng.uniform(0, 30_000), rng.uniform(0, 30_000), rng.uniform(50, 9_000)
        rings.append(square(i, "AB"[i % 2], x - h, y - h, x + h, y + h))
    polys = spark.createDataFrame(rings, RINGS)
    got = {(r.feature, r.id): r.inside_m for r in S.covered_length(segs, polys, limit=limit).collect()}
    expected = {}
    for s in segs.collect():
        for i, _, _, _, pts in rings:
            (x0, y0), (x1, y1) = pts[0], pts[2]
            t0, t1 = 0.0, 1.0
            for a, d, lo, hi in ((s.x1, s.x2 - s.x1, x0, x1), (s.y1, s.y2 - s.y1, y0, y1)):
                if d == 0:
                    t0, t1 = (t0, t1) if lo <= a <= hi else (1.0, 0.0)
                else:
                    u, v = sorted(((lo - a) / d, (hi - a) / d))
                    t0, t1 = max(t0, u), min(t1, v)
            if t1 >= t0:
                expected[s.feature, i] = expected.get((s.feature, i), 0.0) + (t1 - t0) * s.len
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-6 * max(1.0, expected[k]) for k in got)


@pytest.mark.parametrize("inside", ["ray", "walk"])
def test_union_counts_overlaps_once(spark, inside):
    """A straight line of 100 km: overlapping, nested, adjacent, equal and touching squares, and a hole."""
    v = spark.createDataFrame([("L", 1, 0, 0, 0.0, 0.0), ("L", 1, 0, 1, 50_000.0, 0.0), ("L", 1, 0, 2, 100_000.0, 0.0)], SEGS)
    rings = [square(1, "A", 1_000, -500, 21_000, 500), square(2, "A", 11_000, -900, 31_000, 700),  # 1..31
             square(3, "A", 12_000, -200, 14_000, 200),  # within both
             square(4, "A", 31_000, -500, 35_000, 500),  # adjacent: 31..35
             square(5, "A", 60_000, -500, 64_000, 500), square(6, "A", 60_000, -500, 64_000, 500),  # equal
             square(7, "B", 10_000, -500, 12_000, 500),  # another operator
             square(8, "C", 80_000, 0, 90_000, 500)]  # touches with its border
    hole = (9, "D", 0, 1, [(44_000.0, -100.0), (46_000.0, -100.0), (46_000.0, 100.0), (44_000.0, 100.0), (44_000.0, -100.0)])
    rings += [square(9, "D", 40_000, -500, 50_000, 500), hole, square(10, "D", 45_500, -500, 47_000, 500)]
    segs = G.segments(v)
    polys = spark.createDataFrame(rings, RINGS)
    got = {r.operator_code: r.inside_m for r in S.covered_length(segs, polys, union=True, inside=inside).collect()}
    assert set(got) == {"A", "B", "C", "D"}
    for op, km in (("A", 38_000), ("B", 2_000), ("D", 8_500)):
        assert abs(got[op] - km) < 1e-6, op
    total = {r.operator_code: r.m for r in S.covered_length(segs, polys, inside=inside).groupBy("operator_code")
             .agg(F.sum("inside_m").alias("m")).collect()}
    assert abs(total["A"] - 54_000) < 1e-6 and abs(total["D"] - 9_500) < 1e-6


def test_union_differs_from_sum_on_the_tables():
    """Overlaps of all technologies' squares at sf0.01, by the key's SQL (which it matches) and by plain sums."""
    con = duckdb.connect()
    for t in ("part", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    n, less, more = con.execute(
        "SELECT count(*), count(*) FILTER (u.covered_length_km < s.covered_length_km), "
        "count(*) FILTER (u.covered_length_km > s.covered_length_km) "
        f"FROM ({catalog.ALL_CTES + catalog.ROUTE_SELECT}) s JOIN ({catalog.ORACLE['route_coverage_union']}) u "
        "USING (line_id, operator)").fetchone()
    assert n > 100 and less > 10 and more == 0
