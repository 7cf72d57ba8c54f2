"""Lengths per operator summed leaf by leaf, against the pairs of lines and polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from covgrid.operators import geometry as G
from covgrid.operators import lengths as L
from covgrid.operators import spatial as S

RINGS = "id long, operator_code string, part int, ring int, pts array<struct<x:double,y:double>>"
LINES = "line_id string, feature long, part int, seq int, x double, y double"


def case(spark):
    """Lines on and off grid lines, stars with holes over each other, squares on grid lines, a touched corner."""
    rng = random.Random(5)
    lines = [(f"L{f}", f, 0, s, float(x), float(y)) for f in range(30)
             for s, (x, y) in enumerate((rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(6))]
    lines += [("G", 90, 0, s, float(x), float(y)) for s, (x, y) in enumerate([(0, 100), (300, 100), (300, 300), (300, 300), (40, 40)])]
    lines += [("T", 91, 0, s, float(x), float(y)) for s, (x, y) in enumerate([(560, 560), (600, 600)])]
    star = lambda x, y, r, n: [(x + (q := r * rng.uniform(0.4, 1)) * math.cos(a), y + q * math.sin(a))
                               for a in (2 * math.pi * i / n for i in range(n))]
    rings = []
    for i in range(40):
        x, y = rng.uniform(0, 400), rng.uniform(0, 400)
        for part, k, p in ((0, 0, star(x, y, 90, 11)), (0, 1, star(x, y, 30, 5)), (1, 0, star(x + 120, y, 40, 4))):
            rings.append((i, "AB"[i % 2], part, k, p + p[:1]))
    square = lambda x, y, w: [(float(x + a * w), float(y + b * w)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    rings += [(90, "C", 0, 0, square(100, 100, 200)), (91, "C", 0, 0, square(200, 100, 200)), (92, "D", 0, 0, square(600, 600, 50)),
              (93, "E", 0, 0, square(-1000, -1000, 3000))]
    return (G.segments(spark.createDataFrame(lines, LINES)), spark.createDataFrame(rings, RINGS))


@pytest.mark.parametrize("union", [False, True])
@pytest.mark.parametrize("cell,limit", [(7.0, 20), (25.0, 30), (1000.0, 2000)])
def test_sums_of_leaves_are_sums_of_pairs(spark, union, cell, limit):
    segs, rings = case(spark)
    pairs = S.covered_length(segs, rings, cell=50.0, union=union)
    expected = {(r.feature, r.operator_code): r.m for r in
                pairs.groupBy("feature", "operator_code").agg(F.sum("inside_m").alias("m")).collect()}
    out = L.operator_lengths(segs, rings, cell=cell, union=union, limit=limit)
    got = {(r.feature, r.operator_code): r.inside_m for r in out.collect()}
    assert got.keys() == expected.keys() and len(got) > 60
    for k, m in expected.items():
        assert got[k] == pytest.approx(m, abs=1e-6), k
    assert got[91, "D"] == 0.0


def test_no_row_per_pair(spark):
    """100 lines through 100 polygons over each other: rows of leaves, not 10,000 pairs, are shuffled."""
    segs = G.segments(spark.range(100).selectExpr("CAST(id AS STRING) AS line_id", "id AS feature", "0 AS part",
                                                  "explode(sequence(0, 1)) AS seq").selectExpr(
        "*", "CAST(-500 + 1000 * seq AS DOUBLE) AS x", "CAST(feature AS DOUBLE) AS y"))
    ring = "array({})".format(", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in
                                        ((-100, -100), (200, -100), (200, 200), (-100, 200), (-100, -100))))
    rings = spark.range(100).selectExpr("id", "'A' AS operator_code", "0 AS part", "0 AS ring", f"{ring} AS pts")
    out = L.operator_lengths(segs, rings)
    assert [r.inside_m for r in out.collect()] == [pytest.approx(30_000.0)] * 100
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SortMergeJoin" not in text


def test_no_lines_or_no_polygons(spark):
    segs, rings = case(spark)
    assert L.operator_lengths(segs.limit(0), rings).count() == 0
    assert L.operator_lengths(segs, rings.limit(0)).count() == 0


def test_leaf_where_nothing_meets_gives_an_empty_batch_of_the_same_kinds():
    """Lines and parts of one leaf that miss each other; the lengths of no rows stay doubles."""
    import pyarrow as pa
    from covgrid.operators import lengths
    square = [(1, 1.0, 1.0, 2.0, 1.0), (1, 2.0, 1.0, 2.0, 2.0), (1, 2.0, 2.0, 1.0, 2.0), (1, 1.0, 2.0, 1.0, 1.0)]
    for y, rows in ((5.0, 0), (1.5, 1)):
        leaf = pa.table({"qd": pa.array([0, 0, 0], pa.int32()), "cx": [0, 0, 0], "cy": [0, 0, 0], "feature": [7, 7, None],
                         "operator_code": pa.array([None, None, "OF"], pa.string()), "n": [-1, -1, 0],
                         "v": [[0.0, y, 1.5, y], [1.5, y, 9.0, y], [float(x) for e in square for x in e]]})
        out = next(lengths._sums(leaf, 10.0, False))
        assert [f.type for f in out.schema] == [pa.int64(), pa.string(), pa.float64()]
        assert out.num_rows == rows and out.column("inside_m").to_pylist() == [1.0] * rows
