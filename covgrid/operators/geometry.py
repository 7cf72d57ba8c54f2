"""Relational geometry: vertices, segments, rings, edges, bounding boxes,
grid keys and Douglas-Peucker simplification.

Geometry is never a per-row object here.  Lines are vertex rows
(line_id, feature, part, seq, x, y); polygons are nested rings
(part, ring, pts) per geometry, exploded to edge rows for every measure.
Spatial joins are equi-joins on integer grid cells, so Spark plans them as
hash or sort-merge joins (a range condition alone would plan as a
nested-loop join).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.functions import expr as E
from covgrid.session import materialize, ship_package, spread


# ------------------------------------------------------------------ lines
def segments(vertices: DataFrame, join: str | None = None) -> DataFrame:
    """Consecutive vertex pairs of each (feature, part): one row per segment.

    An equi-join of vertex ``seq`` with vertex ``seq + 1`` (``seq`` is dense
    per part, as the loaders number it): the join key is unique, so even a
    line holding a large share of all vertices spreads over every task.
    ``join``: a join hint.  The plans name ``"merge"`` for the vertices of all lines: where
    they are exploded rows, Spark estimates them before the explode and would send
    them all through the driver."""
    a = vertices.select("line_id", "feature", "part", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = vertices.select("line_id", "feature", "part", (F.col("seq") - 1).alias("seq"),
                        F.col("x").alias("x2"), F.col("y").alias("y2"))
    s = a.join(b.hint(join) if join else b, ["line_id", "feature", "part", "seq"])
    return s.select("line_id", "feature", "part", F.col("seq").alias("seg"), "x1", "y1", "x2", "y2",
                    E.seg_len("x1", "y1", "x2", "y2").alias("len"))


def line_lengths(segs: DataFrame) -> DataFrame:
    """(line_id, feature, length_km): segment lengths summed exactly in
    micrometre units, so the value does not depend on partitioning and a
    long line needs no per-line array."""
    return segs.groupBy("line_id", "feature").agg((E.fixed_sum("len", 6) / F.lit(1000.0)).alias("length_km"))


def line_names(stations: DataFrame) -> DataFrame:
    """Name of each line from its stations: first and last station name in
    alphabetical order, only for lines with >= 2 distinct names."""
    return (
        stations.filter(F.col("station_name") != "")
        .groupBy("line_code")
        .agg(F.min("station_name").alias("_a"), F.max("station_name").alias("_z"),
             F.countDistinct("station_name").alias("_n"))
        .filter(F.col("_n") >= 2)
        .select(F.col("line_code").alias("line_id"),
                F.concat_ws(" — ", "_a", "_z").alias("label"))
    )


def lines_table(vertices: DataFrame, stations: DataFrame) -> DataFrame:
    """ref_railway_lines: (line_id, feature, line_name, length_km).  The
    name is '' unless the stations give one (update-from-join)."""
    lengths = line_lengths(segments(vertices, "merge"))
    return (
        lengths.join(line_names(stations), "line_id", "left")
        .select("line_id", "feature", F.coalesce("label", F.lit("")).alias("line_name"), "length_km")
    )


def pick_features(lines: DataFrame) -> DataFrame:
    """One feature per line_id (line_id is not unique): the longest, then
    the lowest feature number."""
    best = F.max_by("feature", F.struct(F.col("length_km"), -F.col("feature")))
    return lines.groupBy("line_id").agg(best.alias("feature"))


def split_segments(segs: DataFrame, max_len: float) -> DataFrame:
    """Cut segments longer than ``max_len`` into equal pieces so each piece
    spans at most a few grid cells (``piece`` numbers them, ``npieces``
    counts them); a segment that needs no cut keeps its exact endpoints."""
    keep = [c for c in segs.columns if c not in ("x1", "y1", "x2", "y2", "len")]
    s = segs.selectExpr("*", f"greatest(1, CAST(ceil(len / {float(max_len)!r}) AS INT)) AS npieces")
    s = s.selectExpr("*", "explode(sequence(0, npieces - 1)) AS piece")
    at = lambda a, d, k: f"CASE WHEN npieces = 1 THEN {a}{'2' if k else '1'} ELSE {a}1 + ({a}2 - {a}1) * ((piece + {k}) / npieces) END"  # noqa: E501,E731
    s = s.selectExpr(*keep, "piece", "npieces", f"{at('x', 0, 0)} AS x1", f"{at('y', 0, 0)} AS y1",
                     f"{at('x', 0, 1)} AS x2", f"{at('y', 0, 1)} AS y2")
    return s.withColumn("len", E.seg_len("x1", "y1", "x2", "y2"))


# --------------------------------------------------------------- polygons
def rings(coverage: DataFrame, *keep: str) -> DataFrame:
    """One row per ring: (id, *keep, part, ring, pts)."""
    r = coverage.select("id", *keep, F.explode("rings").alias("r"))
    return r.select("id", *keep, "r.part", "r.ring", "r.pts")


def edges(ring_rows: DataFrame) -> DataFrame:
    """One row per ring edge (ax, ay) -> (bx, by); rings are closed."""
    e = ring_rows.filter(F.size("pts") >= 2).select(  # shorter rings have no edge
        *[c for c in ring_rows.columns if c != "pts"],
        F.explode(F.transform(F.sequence(F.lit(0), F.size("pts") - 2),
                              lambda i: F.struct(i.alias("e"), F.col("pts")[i].alias("a"),
                                                 F.col("pts")[i + 1].alias("b")))).alias("_e"),
    )
    return e.select(*[c for c in e.columns if c != "_e"], "_e.e",
                    F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"),
                    F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by"))


def ring_bbox(ring_rows: DataFrame, *keys: str) -> DataFrame:
    """Bounding box of the points of all rings grouped by ``keys``."""
    xs = F.transform("pts", lambda p: p["x"])
    ys = F.transform("pts", lambda p: p["y"])
    r = ring_rows.select(*keys, F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"),
                         F.array_min(ys).alias("_y0"), F.array_max(ys).alias("_y1"))
    return r.groupBy(*keys).agg(F.min("_x0").alias("xmin"), F.max("_x1").alias("xmax"),
                                F.min("_y0").alias("ymin"), F.max("_y1").alias("ymax"))


def bbox_cells(df: DataFrame, xmin, ymin, xmax, ymax, size: float) -> DataFrame:
    """Explode a box to the grid cells it overlaps: columns cx, cy added."""
    return (df.withColumn("cx", F.explode(E.cell_range(xmin, xmax, size)))
              .withColumn("cy", F.explode(E.cell_range(ymin, ymax, size))))


# ------------------------------------------------------------- simplify
def _dp_keep(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker on one open or closed polyline; returns kept mask.
    Distances are to the chord segment (a zero-length chord, as in a
    closed ring, measures to its point)."""
    n = len(x)
    keep = np.zeros(n, dtype=bool)
    if n == 0:
        return keep
    keep[0] = keep[n - 1] = True
    stack = [(0, n - 1)]
    while stack:
        i, j = stack.pop()
        if j <= i + 1:
            continue
        px, py = x[i + 1:j], y[i + 1:j]
        ax, ay, bx, by = x[i], y[i], x[j], y[j]
        dx, dy = bx - ax, by - ay
        l2 = dx * dx + dy * dy
        if l2 == 0.0:
            d = np.hypot(px - ax, py - ay)
        else:
            t = np.clip(((px - ax) * dx + (py - ay) * dy) / l2, 0.0, 1.0)
            d = np.hypot(px - (ax + t * dx), py - (ay + t * dy))
        k = int(np.argmax(d))
        if d[k] > tol:
            m = i + 1 + k
            keep[m] = True
            stack.append((i, m))
            stack.append((m, j))
    return keep


def _simplify_geometry_batches(tol: float, rings_col: str):
    """Arrow batches of geometries -> the same batches with each geometry's
    rings simplified.  A ring left with fewer than 4 points collapses; a
    hole whose shell collapsed goes with it."""
    def run(batches):
        for b in batches:
            rings = b.column(rings_col)
            r_off = rings.offsets.to_numpy()
            rv = rings.values
            part = rv.field("part").to_numpy(zero_copy_only=False)
            ring = rv.field("ring").to_numpy(zero_copy_only=False)
            pts = rv.field("pts")
            p_off = pts.offsets.to_numpy()
            xs = pts.values.field("x").to_numpy(zero_copy_only=False)
            ys = pts.values.field("y").to_numpy(zero_copy_only=False)
            o_roff, o_part, o_ring, o_poff, o_x, o_y = [0], [], [], [0], [], []
            for g in range(len(rings)):
                kept = []
                for j in range(r_off[g], r_off[g + 1]):
                    x, y = xs[p_off[j]:p_off[j + 1]], ys[p_off[j]:p_off[j + 1]]
                    keep = _dp_keep(x, y, tol)
                    if keep.sum() >= 4:
                        kept.append((int(part[j]), int(ring[j]), x[keep], y[keep]))
                shells = {p for p, r, _, _ in kept if r == 0}
                kept = [k for k in kept if k[0] in shells]
                for p, r, x, y in kept:
                    o_part.append(p)
                    o_ring.append(r)
                    o_x.append(x)
                    o_y.append(y)
                    o_poff.append(o_poff[-1] + len(x))
                o_roff.append(o_roff[-1] + len(kept))
            cx = np.concatenate(o_x) if o_x else np.zeros(0)
            cy = np.concatenate(o_y) if o_y else np.zeros(0)
            new_pts = pa.ListArray.from_arrays(
                pa.array(o_poff, pa.int32()),
                pa.StructArray.from_arrays([pa.array(cx, pa.float64()), pa.array(cy, pa.float64())], ["x", "y"]))
            new_rings = pa.ListArray.from_arrays(
                pa.array(o_roff, pa.int32()),
                pa.StructArray.from_arrays([pa.array(o_part, pa.int32()), pa.array(o_ring, pa.int32()), new_pts],
                                           ["part", "ring", "pts"]))
            cols = [new_rings if n == rings_col else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return run


#: A geometry with a ring of more points is simplified point by point over many tasks.
LARGE_RING = 200_000


def kept_points(points: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on polylines of any length: the kept rows of ``points(key..,
    seq, x, y)``, ``seq`` being dense from 0 within the other columns.

    All polylines at once, one round per level of the recursion: every undecided
    point knows the chord it lies under; each chord's farthest point (the first of
    equals) splits it if it is farther than ``tolerance``, else its points are dropped.
    A round is an aggregation by chord, merged before the shuffle, and an
    equi-join of the split chords back to their points; a point leaves as soon as it is
    decided.  Undecided points are written between rounds."""
    key = [c for c in points.columns if c not in ("seq", "x", "y")]
    c = F.col
    end = points.groupBy(*key).agg(F.max("seq").alias("_j"))
    at = points.select(*key, "seq", F.struct("x", "y").alias("_p"))
    ends = (end.join(at.where("seq = 0").select(*key, c("_p").alias("_a")), key)
            .join(at.select(*key, c("seq").alias("_j"), c("_p").alias("_b")), [*key, "_j"]))
    kept = points.join(end, key).where("seq = 0 OR seq = _j").select(points.columns)
    under = points.join(ends, key).where("seq > 0 AND seq < _j").select(
        *points.columns, F.lit(0).cast(points.schema["seq"].dataType).alias("_i"), "_j", "_a", "_b")
    done = [materialize(kept, "kept")]
    while True:
        under = materialize(under, "under")
        if under.isEmpty():
            break
        d = under.selectExpr("*", "_b.x - _a.x AS _dx", "_b.y - _a.y AS _dy")
        d = d.selectExpr("*", "_dx * _dx + _dy * _dy AS _l2")
        d = d.selectExpr("*", "CASE WHEN _l2 = 0 THEN 0D ELSE least(1D, greatest(0D, ((x - _a.x) * _dx + (y - _a.y) * _dy) "
                              "/ _l2)) END AS _t")
        d = d.selectExpr("*", "hypot(x - (_a.x + _t * _dx), y - (_a.y + _t * _dy)) AS _d")
        far = d.groupBy(*key, "_i").agg(F.max(F.struct("_d", (-c("seq")).alias("_s"), "x", "y")).alias("_f"))
        far = far.where(c("_f._d") > tolerance).select(*key, "_i", (-c("_f._s")).alias("_m"),
                                                       F.struct("_f.x", "_f.y").alias("_pm"))
        split = under.join(far, [*key, "_i"])
        done.append(materialize(split.where("seq = _m").select(points.columns), "kept"))
        left = c("seq") < c("_m")
        under = split.where("seq <> _m").select(
            *points.columns, F.when(left, c("_i")).otherwise(c("_m")).alias("_i"),
            F.when(left, c("_m")).otherwise(c("_j")).alias("_j"),
            F.when(left, c("_a")).otherwise(c("_pm")).alias("_a"), F.when(left, c("_pm")).otherwise(c("_b")).alias("_b"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def simplify_large(geoms: DataFrame, tolerance: float, rings_col: str = "rings") -> DataFrame:
    """The result of ``simplify_geometries`` for geometries of very large rings
    (``id`` is unique): their points are dealt out as rows."""
    rows = geoms.select("id", F.explode(rings_col).alias("r")).select("id", "r.part", "r.ring", F.posexplode("r.pts").alias(
        "seq", "p")).select("id", "part", "ring", "seq", "p.x", "p.y")
    kept = kept_points(materialize(rows, "points"), tolerance)
    rings = (kept.groupBy("id", "part", "ring")
             .agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("x", "y").alias("p")))).alias("_v"))
             .where(F.size("_v") >= 4).select("id", "part", "ring", F.transform("_v", lambda v: v["p"]).alias("pts")))
    shells = rings.where("ring = 0").select("id", "part")
    rings = rings.join(shells, ["id", "part"], "left_semi")
    found = rings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "ring", "pts"))).alias("_rings"))
    none = F.filter(rings_col, lambda r: F.lit(False))
    return (geoms.join(found, "id", "left").withColumn(rings_col, F.coalesce(F.col("_rings"), none))
            .select(geoms.columns))


def simplify_geometries(geoms: DataFrame, tolerance: float, rings_col: str = "rings") -> DataFrame:
    """Douglas-Peucker on every ring of every geometry row (numpy inside
    Arrow batches; geometries are independent, so Spark spreads them over
    all tasks and no shuffle regroups rings).  Collapsed rings (< 4 points)
    are dropped, and a collapsed shell takes its polygon part's holes.  For
    geometries with a ring over ``LARGE_RING`` points see ``simplify_large``."""
    ship_package(geoms.sparkSession)
    return spread(geoms).mapInArrow(_simplify_geometry_batches(float(tolerance), rings_col), geoms.schema)


def simplify_any(geoms: DataFrame, tolerance: float, rings_col: str = "rings", large: int = LARGE_RING) -> DataFrame:
    """``simplify_geometries``, with the geometries that hold a ring of more than
    ``large`` points through ``simplify_large``.  Runs the rounds of those at once, so
    it is for writing a stage, not for a lazy query."""
    big = F.coalesce(F.exists(rings_col, lambda r: F.size(r["pts"]) > large), F.lit(False))
    return simplify_geometries(geoms.where(~big), tolerance, rings_col).unionByName(
        simplify_large(geoms.where(big), tolerance, rings_col))


def geometry_bbox(rings_col: str = "rings") -> list:
    """Bounding-box columns of a nested geometry, computed in the row."""
    pts = F.flatten(F.transform(rings_col, lambda r: r["pts"]))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return [F.array_min(xs).alias("bbox_xmin"), F.array_min(ys).alias("bbox_ymin"),
            F.array_max(xs).alias("bbox_xmax"), F.array_max(ys).alias("bbox_ymax")]

