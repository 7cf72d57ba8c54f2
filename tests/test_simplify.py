"""Douglas-Peucker simplification of nested geometries."""

import numpy as np
import pandas as pd
import pytest

from covgrid.operators import geometry as G
from covgrid.sources import fixtures as FX

SCHEMA = "id long, rings array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>"


def geom(spark, rings):
    rows = [(1, [{"part": p, "ring": r, "pts": [{"x": float(x), "y": float(y)} for x, y in pts]}
                 for p, r, pts in rings])]
    return spark.createDataFrame(rows, SCHEMA)


def simplified(spark, rings, tol):
    (r,) = G.simplify_geometries(geom(spark, rings), tol).collect()
    return [(x["part"], x["ring"], [(p["x"], p["y"]) for p in x["pts"]]) for x in r["rings"]]


def test_dp_keeps_far_points_only():
    x = np.array([0, 1, 2, 3, 4], dtype=float)
    y = np.array([0, 0.1, -0.1, 5, 0], dtype=float)
    assert G._dp_keep(x, y, 1.0).tolist() == [True, False, True, True, True]


def test_bump_below_tolerance_is_removed(spark):
    ring = [(0, 0), (50, 0), (50, 2), (60, 2), (60, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    (_, _, pts), = simplified(spark, [(0, 0, ring)], 5.0)
    assert pts == [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]


def test_bump_above_tolerance_is_kept(spark):
    ring = [(0, 0), (50, 0), (50, 20), (60, 20), (60, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    (_, _, pts), = simplified(spark, [(0, 0, ring)], 5.0)
    assert (50.0, 20.0) in pts and (60.0, 20.0) in pts


def test_small_hole_collapses_and_small_shell_takes_its_holes(spark):
    big = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    hole = [(40, 40), (42, 40), (42, 42), (40, 42), (40, 40)]
    small = [(200, 0), (202, 0), (202, 2), (200, 2), (200, 0)]
    small_hole = [(200.5, 0.5), (201, 0.5), (201, 1), (200.5, 1), (200.5, 0.5)]
    out = simplified(spark, [(0, 0, big), (0, 1, hole), (1, 0, small), (1, 1, small_hole)], 5.0)
    assert [(p, r) for p, r, _ in out] == [(0, 0)]


def _dp_reference(pts, tol):
    """Textbook recursive Douglas-Peucker (distance to the chord segment)."""
    def dist(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        dx, dy = bx - ax, by - ay
        l2 = dx * dx + dy * dy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / l2))
        return ((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) ** 0.5
    if len(pts) < 3:
        return list(pts)
    d = [dist(p, pts[0], pts[-1]) for p in pts[1:-1]]
    k = max(range(len(d)), key=lambda i: (d[i], -i))
    if d[k] <= tol:
        return [pts[0], pts[-1]]
    left = _dp_reference(pts[:k + 2], tol)
    return left[:-1] + _dp_reference(pts[k + 1:], tol)


def test_wiggly_ring_matches_textbook_dp(spark):
    # fixture-style railway zig-zag (8 km steps, 1.2 km wiggle) closed into a ring
    pts = [(k * 8000.0, (k % 2) * 1200.0) for k in range(10)] + [(72000.0, 50000.0), (0.0, 50000.0), (0.0, 0.0)]
    for tol in (300.0, 1000.0, 5000.0):
        (_, _, kept), = simplified(spark, [(0, 0, pts)], tol)
        assert kept == _dp_reference(pts, tol), tol


# ------------------------------------------------------- rings beyond one task
def _wave(n, seed):
    """A closed, rough ring: several waves and noise."""
    rng = np.random.default_rng(seed)
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 50_000 + 9_000 * np.sin(5 * a) + 2_500 * np.sin(31 * a) + rng.normal(0, 300, n)
    x, y = 600_000 + r * np.cos(a), 6_600_000 + r * np.sin(a)
    return np.r_[x, x[:1]], np.r_[y, y[:1]]


@pytest.mark.parametrize("n,tol", [(300_000, 6_000.0)])
def test_kept_points_equal_numpy(spark, n, tol):
    x, y = _wave(n, n)
    pdf = pd.DataFrame({"ring": 1, "seq": np.arange(len(x)), "x": x, "y": y})
    lines = pd.DataFrame({"ring": 2, "seq": np.arange(50), "x": np.arange(50.0) * 100, "y": np.arange(50.0) % 2 * 9_000})
    points = spark.createDataFrame(pd.concat([pdf, lines]))  # a closed ring and an open line in one run
    got = G.kept_points(points, tol).collect()
    for ring, xs, ys in ((1, x, y), (2, lines.x.to_numpy(), lines.y.to_numpy())):
        kept = sorted(r.seq for r in got if r.ring == ring)
        assert kept == np.flatnonzero(G._dp_keep(xs, ys, tol)).tolist()
    assert len(got) < n / 2


def test_large_geometries_equal_small_ones(spark):
    """Both ways on the same shapes: bent squares, one with a collapsing hole, one that collapses, one empty."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(25)
    shapes = FX.shapes(part).select("id", "rings")
    sq = [(0.0, 0.0), (9e4, 0.0), (9e4, 9e4), (0.0, 9e4), (0.0, 0.0)]
    hole = [(1e4, 1e4), (1.1e4, 1e4), (1.1e4, 1.1e4), (1e4, 1e4)]
    rows = [(900, [(0, 0, sq), (0, 1, hole)]), (901, [(0, 0, hole), (0, 1, hole)]), (902, [])]
    shapes = shapes.unionByName(spark.createDataFrame(rows, shapes.schema))
    small = {r.id: r.rings for r in G.simplify_geometries(shapes, 5_000.0).collect()}
    large = {r.id: r.rings for r in G.simplify_any(shapes, 5_000.0, large=8).collect()}
    assert large == small and len(small[900]) == 1 and small[901] == [] == small[902]
    sizes = {len(r[0].pts) for i, r in small.items() if i < 900}
    assert len(sizes) > 1 and min(sizes) < 9  # some bends are kept, others dropped
