"""Tables of points against polygons, targets and lines, compared with brute force."""

import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from covgrid.operators import geometry as G
from covgrid.operators import points as P
from covgrid.plans import coverage as C
from covgrid.sources import fixtures as FX
from covgrid.sources import sinks

SF = "/root/testdata/sf0.01"
RINGS = "id long, operator_code string, technology string, part int, ring int, pts array<struct<x:double,y:double>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def star(rng, cx, cy, r, n):
    """A closed ring that is not convex: radii vary around the centre."""
    pts = [(cx + r * rng.uniform(0.4, 1) * math.cos(a), cy + r * rng.uniform(0.4, 1) * math.sin(a))
           for a in (2 * math.pi * i / n for i in range(n))]
    return pts + pts[:1]


def odd(rings, x, y):
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    """Stars with star holes in two parts, a square on grid lines, a sliver across many cells."""
    rng = random.Random(11)
    out = []
    for i in range(25):
        x, y = rng.uniform(0, 400), rng.uniform(0, 400)
        out.append((i, "AB"[i % 2], "4G", 0, [star(rng, x, y, 80, 17), star(rng, x, y, 25, 9)]))
        out.append((i, "AB"[i % 2], "4G", 1, [star(rng, x + 300, y, 40, 5)]))
    out.append((90, "C", "4G", 0, [[(100, 100), (200, 100), (200, 200), (100, 200), (100, 100)]]))
    out.append((91, "D", "5G", 0, [[(0, 0), (400, 390), (400, 391), (0, 0)]]))
    return out


def rings_of(spark, shapes):
    rows = [(i, o, t, p, k, [(float(x), float(y)) for x, y in ring]) for i, o, t, p, rs in shapes for k, ring in enumerate(rs)]
    return spark.createDataFrame(rows, RINGS)


@pytest.mark.parametrize("cell", [7.0, 50.0, 1000.0])
def test_points_in_polygons(spark, shapes, cell):
    rng = random.Random(int(cell))
    pts = [(i, rng.uniform(-50, 800), rng.uniform(-50, 500), rng.choice(["4G", "5G"])) for i in range(1500)]
    pts += [(2000 + i, x, y, "4G") for i, (x, y) in enumerate([(150.0, 150.0), (99.0, 150.0), (140.0, 105.0), (201.0, 105.0)])]
    df = spark.createDataFrame(pts, "point_id long, x double, y double, technology string")
    got = {tuple(r) for r in P.points_in_polygons(df, rings_of(spark, shapes), ["technology"], cell).collect()}
    expected = {(i, s, o) for i, x, y, t in pts for s, o, tech, part, rs in shapes if tech == t and odd(rs, x, y)}
    assert got == expected and len(got) > 100


@pytest.mark.parametrize("cell", [7.0, 50.0, 1000.0])
def test_operators_of_points(spark, shapes, cell):
    """The distinct operators of points_in_polygons, with polygons of one operator over each other."""
    rng = random.Random(int(cell))
    twice = shapes + [(s + 1000, o, t, part, rs) for s, o, t, part, rs in shapes]
    pts = [(i, rng.uniform(-50, 800), rng.uniform(-50, 500), rng.choice(["4G", "5G"])) for i in range(1500)]
    df = spark.createDataFrame(pts, "point_id long, x double, y double, technology string")
    out = P.operators_of_points(df, rings_of(spark, twice), ["technology"], cell)
    got = [tuple(r) for r in out.collect()]
    expected = {(i, o) for i, x, y, t in pts for s, o, tech, part, rs in twice if tech == t and odd(rs, x, y)}
    assert set(got) == expected and len(got) == len(expected)


def test_point_joins_broadcast_no_cells(spark):
    """Exploded cells and blocks of targets are estimated far too small; they must not be sent to the driver."""
    import __spark_entry__ as entry
    assert "BroadcastHashJoin" not in plan(entry.queries()["site_coverage"](spark, SF))


def test_nearest_makes_no_row_per_pair(spark):
    """Points meet blocks of targets; no window or aggregation takes a row per compared pair."""
    pts = spark.range(400).selectExpr("id AS point_id", "CAST(id % 20 AS DOUBLE) AS x", "CAST(id / 20 AS DOUBLE) AS y")
    goals = spark.range(2000).selectExpr("id AS target_id", "CAST(id % 40 AS DOUBLE) / 4 AS x", "CAST(floor(id / 40) AS DOUBLE) / 4 AS y")
    got = P.nearest(pts, goals, 3, finest=8.0)
    assert "_targets" in plan(got)
    assert got.count() == 1200
    import numpy as np
    g = np.array([[r.x, r.y] for r in goals.orderBy("target_id").collect()])
    for r in pts.join(got.where("rank = 1"), "point_id").collect():
        assert np.hypot(g[:, 0] - r.x, g[:, 1] - r.y).min() == pytest.approx(r.distance)


def test_inside_cells_spare_the_edge_test(spark, shapes):
    """Every point of an inside cell is inside, and a large polygon is mostly such cells."""
    edges = G.edges(rings_of(spark, shapes).select("id", "operator_code", "technology", "part", "ring", "pts"))
    cells = P.polygon_cells(edges, ["id", "part"], 5.0).collect()
    rng, by = random.Random(1), {(s, p): rs for s, o, t, p, rs in shapes}
    whole = [r for r in cells if r.inside]
    for r in whole:
        for _ in range(3):
            assert odd(by[r.id, r.part], (r.cx + rng.random()) * 5, (r.cy + rng.random()) * 5)
    square = [r.inside for r in cells if r.id == 90]
    assert sum(square) == 19 * 19  # 20 x 20 half-open cells; one row and column meet an edge at their lower border
    sliver = [r for r in cells if r.id == 91]
    assert len(sliver) < 400  # of the 80 x 79 cells of its box


def test_no_points_or_no_polygons(spark, shapes):
    pts = spark.createDataFrame([(1, 150.0, 150.0, "4G")], "point_id long, x double, y double, technology string")
    rings = rings_of(spark, shapes)
    assert P.points_in_polygons(pts.limit(0), rings).count() == 0
    assert P.points_in_polygons(pts, rings.limit(0)).count() == 0


def test_plans_have_no_pairwise_join(spark):
    import __spark_entry__ as entry
    for key in ("site_coverage", "nearest_stations", "station_places"):
        text = plan(entry.queries()[key](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, key


# ------------------------------------------------------------- clustered layout
def test_clustered_layout_prunes(spark, tmp_path):
    t = FX.load(spark, SF)
    path = str(tmp_path / "coverage")
    sinks.write_clustered_coverage(t.coverage, path, files=32)
    stored = spark.read.parquet(path)
    assert stored.count() == t.coverage.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    point = C.operators_at_point(stored, 47.0, 2.0, "4G")
    text = plan(point)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters"):]
    for name in C.BOX:
        assert f"OrEqual({name}," in pushed[:2000], name  # LessThanOrEqual(bbox_xmin, ..) and so on
    assert "PartitionFilters: [isnotnull(technology" in text
    assert sorted(map(tuple, point.collect())) == sorted(map(tuple, C.operators_at_point(t.coverage, 47.0, 2.0, "4G").collect()))
    # the boxes of a file cover a small part of the map: few files can hold a given point
    files, meet = glob.glob(f"{path}/technology=4G/*.parquet"), 0
    for f in files:
        meta = pq.ParquetFile(f)
        at = {meta.schema.column(i).name: i for i in range(len(meta.schema))}
        def stat(n, side):
            return [getattr(meta.metadata.row_group(g).column(at[n]).statistics, side) for g in range(meta.metadata.num_row_groups)]
        meet += (min(stat("bbox_xmin", "min")) <= 620_000 <= max(stat("bbox_xmax", "max"))
                 and min(stat("bbox_ymin", "min")) <= 6_650_000 <= max(stat("bbox_ymax", "max")))
    assert len(files) >= 8 and meet <= len(files) / 2


# ------------------------------------------------------------------ nearest
@pytest.mark.parametrize("k,finest,levels", [(1, 1.0, 16), (3, 1.0, 16), (3, 50.0, 2), (5, 0.01, 20)])
def test_nearest(spark, k, finest, levels):
    """Dense and lonely targets, ties, a point far from all, as many points as cells."""
    rng = random.Random(k)
    targets = [(i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(200)] + [(500, 900.0, 900.0), (501, 900.0, 900.0)]
    targets += [(600 + i, float(i), 50.0) for i in range(10)]
    pts = [(i, rng.uniform(-100, 1000), rng.uniform(-100, 1000)) for i in range(60)]
    pts += [(100 + i, i + 0.5, 50.0) for i in range(5)] + [(200, -5e4, 3e4), (201, 900.0, 900.0), (202, 0.0, 0.0)]
    if levels == 2:  # a grid that ends at 4 * 100: only points within it
        pts = [p for p in pts if abs(p[1]) < 300 and abs(p[2]) < 300]
    tdf = spark.createDataFrame(targets, "target_id long, x double, y double")
    got = P.nearest(spark.createDataFrame(pts, "point_id long, x double, y double"), tdf, k, finest, levels)
    got = sorted((r.point_id, r["rank"], r.target_id) for r in got.collect())
    expected = []
    for i, x, y in pts:
        near = sorted((math.sqrt((x - tx) ** 2 + (y - ty) ** 2), t) for t, tx, ty in targets)[:k]
        expected += [(i, n + 1, t) for n, (_, t) in enumerate(near)]
    assert got == sorted(expected)


def test_nearest_with_few_targets(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, -1e6)], "point_id long, x double, y double")
    t = spark.createDataFrame([(7, 5.0, 5.0), (8, 2e6, 2e6)], "target_id long, x double, y double")
    assert P.nearest(pts, t, 5).count() == 4
    assert P.nearest(pts, t.limit(0), 1).count() == 0


# ------------------------------------------------------------------- locate
@pytest.mark.parametrize("block", [1, 7, 256])
def test_locate(spark, block):
    rng = random.Random(block)
    verts, brute = [], {}
    for f in range(4):
        for part in range(2):
            x, y = rng.uniform(0, 100), rng.uniform(0, 100)
            for i in range(40):
                verts.append((f"L{f}", f, part, i, x, y))
                x, y = x + rng.uniform(-9, 12), y + rng.uniform(-9, 12)
                if i == 20:
                    verts[-1] = verts[-1][:4] + verts[-2][4:]  # a segment of length 0
    v = spark.createDataFrame(verts, "line_id string, feature long, part int, seq int, x double, y double")
    pts = [(i, rng.randrange(4), rng.uniform(-20, 200), rng.uniform(-20, 200)) for i in range(80)]
    for i, f, x, y in pts:
        before, best = 0.0, None
        for part in range(2):
            line = [(a, b) for _, g, p, _, a, b in verts if g == f and p == part]
            for s, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:])):
                dx, dy = bx - ax, by - ay
                l2 = dx * dx + dy * dy
                t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / l2)) if l2 else 0.0
                d = math.hypot(x - ax - t * dx, y - ay - t * dy)
                if best is None or d < best[0] - 1e-9:
                    best = (d, part, s, before + t * math.sqrt(l2))
                before += math.sqrt(l2)
        brute[i] = best + (before,)
    got = P.locate(spark.createDataFrame(pts, "point_id long, feature long, x double, y double"), G.segments(v), block)
    rows = got.collect()
    assert len(rows) == len(pts)
    for r in rows:
        d, part, s, along, total = brute[r.point_id]
        assert (r.part, r.seg) == (part, s)
        assert abs(r.along_m - along) < 1e-3 and abs(r.total_m - total) < 1e-3 and abs(r.distance_m - d) < 1e-6


def test_long_line_is_read_by_blocks(spark):
    """A line of 20,000 segments: few blocks are joined for a point."""
    v = spark.range(20_001).selectExpr("'L' AS line_id", "1L AS feature", "0 AS part", "CAST(id AS INT) AS seq",
                                       "CAST(id * 10 AS DOUBLE) AS x", "CAST((id % 2) * 5 AS DOUBLE) AS y")
    segs = G.segments(v)
    pts = spark.createDataFrame([(1, 1, 50_003.0, 40.0), (2, 1, 199_990.0, -3.0)], "point_id long, feature long, x double, y double")
    rows = {r.point_id: r for r in P.locate(pts, segs).collect()}
    step = math.hypot(10, 5)
    assert abs(rows[1].along_m - 5000 * step) < 2 * step and abs(rows[2].along_m - 19999 * step) < 2 * step
    assert abs(rows[1].total_m - 20_000 * step) < 0.1
    widest = P.measured(segs).groupBy("feature", "part", "block").count().agg(F.max("count")).first()[0]
    assert widest == P.BLOCK


def _nearest_by_hand(points, goals, k):
    """``(point, target, distance)``, ties to the smaller target."""
    return sorted((p, t, d) for p, x, y in points
                  for d, t in sorted((math.sqrt((u - x) * (u - x) + (v - y) * (v - y)), t) for t, u, v in goals)[:k])


def test_nearest_meets_dense_cells_in_numpy(spark, monkeypatch):
    """Thousands of targets in one finest cell: blocks of points are compared in Arrow batches, not array by array per
    point, with ties, targets that come twice and a point far from all."""
    monkeypatch.setattr(P, "POINTS", 40)
    rng = random.Random(11)
    goals = [(f"t{i:04}", float(rng.randint(0, 90)), float(rng.randint(0, 90))) for i in range(1500)]
    goals += goals[:20] + [("z", 5_000.0, 5_000.0)]
    points = [(i, float(rng.randint(0, 90)), rng.uniform(0, 90)) for i in range(300)] + [(900, 1e6, -1e6), (901, 4_900.0, 5_100.0)]
    out = P.nearest(spark.createDataFrame(points, "point_id long, x double, y double"),
                    spark.createDataFrame(goals, "target_id string, x double, y double"), 3, finest=100.0, levels=5)
    assert "MapInArrow" in plan(out) and "array_sort" not in plan(out)
    got = sorted((r.point_id, r.target_id, r.distance) for r in out.collect())
    assert got == sorted(_nearest_by_hand(points, goals, 3))


def test_targets_of_a_block_in_steps():
    """A block with more targets than are held at once: each step gives the nearest of its own, the best of all among them."""
    import pyarrow as pa
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(7)]
    goals = [(100 + i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)]
    rows = [{"c": c, "_targets": False, "point_id": p + 10 * c, "target_id": None, "x": x, "y": y} if k == 0 else
            {"c": c, "_targets": True, "point_id": None, "target_id": p, "x": x, "y": y}
            for c in (0, 1) for k, some in ((0, points), (1, goals)) for p, x, y in some]
    schema = pa.schema([("c", pa.int64()), ("_targets", pa.bool_()), ("point_id", pa.int64()), ("target_id", pa.int64()),
                        ("x", pa.float64()), ("y", pa.float64())])
    nobody = [r | {"c": 2} for r in rows if r["_targets"] and r["c"] == 1]  # a block without points
    after = [r | {"c": 3, "point_id": r["point_id"] and r["point_id"] + 30} for r in rows[:9]]
    batches = pa.Table.from_pylist(rows + nobody + after, schema).to_batches(max_chunksize=9)
    for most in (12, 1000):
        found = [r for b in P._nearest_of_blocks(["c"], 2, most)(batches) for r in b.to_pylist()]
        best = {p: sorted((r["distance"], r["target_id"]) for r in found if r["point_id"] == p)[:2] for p in {r["point_id"] for r in found}}
        for c in (0, 1):
            assert sorted((p, t, d) for p, b in best.items() if p // 10 == c for d, t in b) == sorted(
                (p + 10 * c, t, d) for p, t, d in _nearest_by_hand(points, goals, 2))


def test_k_best_of_many_pairs():
    """Points split in four and targets left out give what all pairs give."""
    import numpy as np
    rng = np.random.default_rng(2)
    for n, m in ((3000, 2000), (1, 5), (4000, 1)):
        p, t = np.floor(rng.uniform(0, 300, (2, n))), np.floor(rng.uniform(0, 300, (2, m)))
        got = {}
        for i, j, d in P._k_best(*p, *t, 2):
            for a, b, c in zip(i, j, d):
                got.setdefault(a, []).append((c, b))
        d = np.sqrt((t[0] - p[0][:, None]) ** 2 + (t[1] - p[1][:, None]) ** 2)
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        assert all(got[i] == [(d[i, j], j) for j in order[i]] for i in range(n))
