"""Joins of a whole table of points: polygons that hold them, nearest targets,
places along lines.

None of them looks at all pairs.  Polygons are indexed by grid cells, of which
those wholly inside need no edge test; nearest targets are sought at the grid
level where a point's surroundings are known to hold enough of them; lines are
cut into blocks, of which only those that may hold the closest point are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covgrid.functions import expr as E
from covgrid.operators import geometry as G
from covgrid.session import ship_package

CELL = 5_000.0


# ------------------------------------------------------------- points in polygons
def polygon_cells(edges: DataFrame, keys: list[str], cell: float = CELL) -> DataFrame:
    """Grid cells of each polygon part: ``(*keys, cx, cy, inside)``.

    ``inside`` cells are touched by no edge and lie in the polygon as a whole;
    the others meet an edge.  A cell without an edge has one status, that of its
    centre: the crossings of a row's centre line, in order, bound the runs of
    centres inside (odd-even rule, so holes need no special case)."""
    z = repr(float(cell))
    e = edges.selectExpr(*keys, "ax", "ay", "bx", "by", "least(ax, bx) AS x0", "greatest(ax, bx) AS x1",
                         "least(ay, by) AS y0", "greatest(ay, by) AS y1")
    met = G.bbox_cells(e, "x0", "y0", "x1", "y1", cell)
    # a long slanting edge misses most cells of its box: those with all corners on one side
    side = lambda i, j: f"((bx - ax) * ((cy + {j}) * {z} - ay) - (by - ay) * ((cx + {i}) * {z} - ax))"
    corners = ", ".join(side(i, j) for i in (0, 1) for j in (0, 1))
    slack = f"1e-9D * (abs(bx - ax) + abs(by - ay) + {z}) * (abs(ax) + abs(ay) + {z})"
    met = met.where(f"least({corners}) <= {slack} AND greatest({corners}) >= -({slack})")
    met = met.select(*keys, "cx", "cy").distinct()

    rows = e.withColumn("cy", F.explode(E.cell_range("y0", "y1", cell)))
    rows = rows.selectExpr(*keys, "cy", f"(cy + 0.5D) * {z} AS yc", "ax", "ay", "bx", "by")
    cuts = rows.where("(ay > yc) <> (by > yc)").selectExpr(
        *keys, "cy", "ax + (yc - ay) * (bx - ax) / (by - ay) AS x")
    w = Window.partitionBy(*keys, "cy").orderBy("x")  # the crossings of one part with one line
    runs = (cuts.select(*keys, "cy", "x", F.lead("x").over(w).alias("until"), F.row_number().over(w).alias("i"))
            .where("i % 2 = 1 AND until > x"))
    centre = f"(cx + 0.5D) * {z}"
    held = runs.withColumn("cx", F.explode(E.cell_range("x", "until", cell))).where(f"{centre} >= x AND {centre} < until")
    # sizes are estimated before the explodes, so joins of cells name their kind: no broadcast of them
    whole = held.select(*keys, "cx", "cy").join(met.hint("merge"), [*keys, "cx", "cy"], "left_anti")
    return (whole.withColumn("inside", F.lit(True))
            .unionByName(met.withColumn("inside", F.lit(False))))


def points_in_polygons(points: DataFrame, rings: DataFrame, by: list[str] = ("technology",),
                       cell: float = CELL) -> DataFrame:
    """``(point_id, id, operator_code)`` of each point inside a polygon of its own ``by``.

    points: point_id, x, y, *by;  rings: id, operator_code, *by, part, ring, pts.
    Points in an inside cell are hits at once; the others count the edges of that
    polygon part to their right, among those of their own grid row."""
    by = list(by)
    keys = ["id", "operator_code", *by, "part"]
    edges = G.edges(rings.select(*keys, "ring", "pts"))
    index = polygon_cells(edges, keys, cell)
    at = points.select("point_id", "x", "y", *by, E.cell("x", cell).alias("cx"), E.cell("y", cell).alias("cy"))
    met = at.join(index.hint("merge"), [*by, "cx", "cy"])
    sure = met.where("inside").select("point_id", "id", "operator_code")
    tested = _tested(met.where("NOT inside"), edges, cell)
    return sure.unionByName(tested.select("point_id", "id", "operator_code"))


def _tested(near: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Those of the met (point, polygon part) rows where an odd number of the part's
    edges lies to the right of the point, among those of its grid row."""
    rows = (edges.select("id", "part", F.explode(E.cell_range(F.least("ay", "by"), F.greatest("ay", "by"), cell)).alias("cy"),
                         "ax", "ay", "bx", "by"))
    right = "((ay > y) <> (by > y)) AND x < ax + (y - ay) * (bx - ax) / nullif(by - ay, 0)"
    near = near.select("point_id", "id", "operator_code", "part", "x", "y", "cy")
    return (near.join(rows.hint("merge"), ["id", "part", "cy"]).where(right)
            .groupBy("point_id", "id", "operator_code", "part").count().where("count % 2 = 1"))


def operators_of_points(points: DataFrame, rings: DataFrame, by: list[str] = ("technology",),
                        cell: float = CELL) -> DataFrame:
    """``(point_id, operator_code)``: the distinct operators of what ``points_in_polygons``
    finds, without its pairs.

    A cell that lies in one polygon of an operator answers for all its points, so
    inside cells are kept once per operator, however many polygons hold them, and
    edges are tested only where no polygon of the operator holds the cell."""
    by = list(by)
    keys = ["id", "operator_code", *by, "part"]
    at_cell = [*by, "cx", "cy"]
    edges = G.edges(rings.select(*keys, "ring", "pts"))
    index = polygon_cells(edges, keys, cell)
    held = index.where("inside").select(*at_cell, "operator_code").distinct()
    open_ = index.where("NOT inside").join(held.hint("merge"), [*at_cell, "operator_code"], "left_anti")
    at = points.select("point_id", "x", "y", *by, E.cell("x", cell).alias("cx"), E.cell("y", cell).alias("cy"))
    sure = at.join(held.hint("merge"), at_cell).select("point_id", "operator_code")
    tested = _tested(at.join(open_.hint("merge"), at_cell), edges, cell)
    return sure.unionByName(tested.select("point_id", "operator_code")).distinct()


# --------------------------------------------------------------- nearest targets
LEVELS = 16
#: Points of a cell that one block holds.
POINTS = 50_000
#: Pairs compared at once, and targets so few that no point is spared any.
PAIRS, FEW = 50_000, 24


def _level_cells(df: DataFrame, x: str, y: str, finest: float, levels: int, up: int = 0) -> DataFrame:
    """Each row once per level, with its cell ``(level, cx, cy)``; ``up``: cells of a
    level are ``2 ** up`` times as wide."""
    level = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.lit(float(finest) * 2 ** up) * F.pow(F.lit(2.0), F.col("level"))
    return (level.withColumn("cx", F.floor(F.col(x) / side).cast("long"))
            .withColumn("cy", F.floor(F.col(y) / side).cast("long")))


def _around(df: DataFrame) -> DataFrame:
    """Each row for its own cell and the eight next to it."""
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (df.withColumn("_dx", F.explode(three)).withColumn("_dy", F.explode(three))
            .withColumn("cx", F.col("cx") + F.col("_dx")).withColumn("cy", F.col("cy") + F.col("_dy"))
            .drop("_dx", "_dy"))


def nearest(points: DataFrame, targets: DataFrame, k: int = 1, finest: float = 1_000.0,
            levels: int = LEVELS) -> DataFrame:
    """The ``k`` nearest targets of each point: ``(point_id, target_id, distance, rank)``.

    points: point_id, x, y;  targets: target_id, x, y;  distance in their unit, ties
    to the smaller target id; fewer than ``k`` rows where there are fewer targets.

    A grid doubles its cells from ``finest`` over ``levels`` levels.  The first level
    whose 3 x 3 cells around a point hold ``k`` targets proves that the k-th is not
    farther than the diagonal of two cells (2.83 sides), so all ``k`` lie in the
    3 x 3 cells of four times that side, and only those are compared.  A point
    without such a level is more than ``finest * 2 ** (levels - 1)`` from the k-th (or there are
    fewer targets than ``k``): it is compared with all, in one cell of a level of its own.

    The points of a cell are dealt in blocks, each met by the targets around the cell, so
    no task holds all points of a cell; a block is compared in numpy (``_k_best``)."""
    spark = points.sparkSession
    ship_package(spark)
    places = _level_cells(targets.select("x", "y"), "x", "y", finest, levels)
    counts = places.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    rich = _around(counts).groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    # points of one finest cell share their level: sought once per cell
    side = F.lit(float(finest))
    at = points.select("point_id", "x", "y", F.floor(F.col("x") / side).cast("long").alias("fx"),
                       F.floor(F.col("y") / side).cast("long").alias("fy"))
    cells = (at.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))))
    shift = F.pow(F.lit(2.0), F.col("level"))
    cells = (cells.withColumn("cx", F.floor(F.col("fx") / shift).cast("long"))
             .withColumn("cy", F.floor(F.col("fy") / shift).cast("long")))
    found = (cells.join(rich.select("level", "cx", "cy", F.lit(True).alias("enough")), ["level", "cx", "cy"], "left")
             .groupBy("fx", "fy").agg(F.coalesce(F.min(F.when(F.col("enough"), F.col("level"))),
                                                 F.lit(levels)).alias("level"), F.max("n").alias("n")))
    # a cell of the level's comparison is four of its sides wide
    place = lambda v, unit: F.when(F.col("level") == levels, 0).otherwise(
        F.floor(F.col(v) / (F.lit(4.0 * unit) * F.pow(F.lit(2.0), F.col("level"))))).cast("long")
    at_cell = ["level", "cx", "cy"]
    found = found.select("fx", "fy", "level", place("fx", 1).alias("cx"), place("fy", 1).alias("cy"), "n")
    asked = found.groupBy(*at_cell).agg(F.ceil(F.sum("n") / F.lit(POINTS)).cast("long").alias("_n"))
    found = found.drop("n").join(asked, at_cell)
    # targets only at the levels and cells that some point asks for, around each of them
    wanted = _around(asked.select(*at_cell)).distinct()
    goals = targets.select("target_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    there = goals.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    there = there.withColumn("cx", place("tx", finest)).withColumn("cy", place("ty", finest))
    there = there.join(wanted.hint("merge"), at_cell, "left_semi")
    # the cell of its own level has no neighbours
    one = F.col("level") == levels
    there = _around(there).where(~one | ((F.col("cx") == 0) & (F.col("cy") == 0)))
    there = there.join(asked.hint("merge"), at_cell)
    # rows of both kinds, the points of a block before the targets that it meets
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    asks = at.join(found, ["fx", "fy"]).select(
        *at_cell, F.pmod(F.xxhash64("point_id", "x", "y"), F.col("_n")).alias("_block"), F.lit(False).alias("_targets"),
        "point_id", none(goals, "target_id"), "x", "y")
    met = there.select(*at_cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_block"),
                       F.lit(True).alias("_targets"), none(points, "point_id"), "target_id", F.col("tx").alias("x"),
                       F.col("ty").alias("y"))
    group = [*at_cell, "_block"]
    rows = asks.unionByName(met).repartition(*group).sortWithinPartitions(*group, "_targets")
    schema = T.StructType([points.schema["point_id"], targets.schema["target_id"], T.StructField("distance", T.DoubleType())])
    # a block may be met in several steps, and a point id may come twice
    w = Window.partitionBy("point_id").orderBy("distance", "target_id")
    return (rows.mapInArrow(_nearest_of_blocks(group, k), schema).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).select("point_id", "target_id", "distance", "rank"))


def _nearest_of_blocks(group: list[str], k: int, most: int = 400_000):
    """Rows sorted by block, points before targets -> ``k`` rows per point.  A block
    of more than ``most`` rows meets its targets in several steps."""
    def run(batches):
        held, last, n = [], None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in group])
            turn = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if last is not None and (keys[0] != last).any():
                yield from _met(held, group, k)
                held, n = [], 0
            if len(turn):
                yield from _met([*held, b.slice(0, turn[-1])], group, k)
                held, n = [b.slice(turn[-1])], 0
            else:
                held.append(b)
            last, n = keys[-1], n + held[-1].num_rows
            if n > most:  # the points of the block go on to the next targets
                yield from _met(held, group, k)
                rows = pa.Table.from_batches(held)
                held, n = rows.filter(pc.invert(rows.column("_targets"))).combine_chunks().to_batches(), 0
        if held:
            yield from _met(held, group, k)
    return run


def _met(held: list, group: list[str], k: int):
    """The rows of whole blocks -> one batch of ``point_id, target_id, distance``."""
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = np.column_stack([rows.column(c).to_numpy().astype(np.int64) for c in group])
    goal = rows.column("_targets").to_numpy()
    x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
    # ties go to the smaller target id: targets are met in the order of their ids
    place = np.empty(len(goal), np.int64)
    place[pc.sort_indices(rows.column("target_id")).to_numpy()] = np.arange(len(goal))
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
    out = []
    for s, e in zip(starts[:-1], starts[1:]):
        m = s + np.count_nonzero(~goal[s:e])
        if s < m < e:
            t = m + np.argsort(place[m:e], kind="stable")
            out.extend((s + i, t[j], d) for i, j, d in _k_best(x[s:m], y[s:m], x[t], y[t], k))
    if out:
        i, j, d = (np.concatenate(v) for v in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [rows.column("point_id").take(pa.array(i)).combine_chunks(), rows.column("target_id").take(pa.array(j)).combine_chunks(),
             pa.array(d)], names=["point_id", "target_id", "distance"])


def _k_best(px, py, tx, ty, k: int):
    """The ``k`` nearest of the targets for each point, ties to the first: arrays of the
    points' and the targets' places and the distances.  Points are split in four while
    there are many pairs; a target farther from the box of some points than the ``k``-th
    can be is none of theirs."""
    todo = [(np.arange(len(px)), np.arange(len(tx)))]
    while todo:
        p, t = todo.pop()
        if len(t) > max(FEW, k) and len(p) * len(t) > PAIRS:
            x, y, u, v = px[p], py[p], tx[t], ty[t]
            x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
            far = np.hypot(np.maximum(u - x0, x1 - u), np.maximum(v - y0, y1 - v))
            bound = np.partition(far, k - 1)[k - 1] * (1 + 1e-9) + 1e-9
            t = t[np.hypot(np.maximum(np.maximum(x0 - u, u - x1), 0), np.maximum(np.maximum(y0 - v, v - y1), 0)) <= bound]
            if x1 > x0 or y1 > y0:
                part = 2 * (x > (x0 + x1) / 2) + (y > (y0 + y1) / 2)
                if part.min() < part.max():  # else the box is as small as numbers go
                    todo.extend((q, t) for q in (p[part == i] for i in range(4)) if len(q))
                    continue
        step = max(1, 4 * PAIRS // len(t))
        for some in (p[i:i + step] for i in range(0, len(p), step)):
            dx, dy = tx[t] - px[some][:, None], ty[t] - py[some][:, None]
            d = np.sqrt(dx * dx + dy * dy)
            row = np.arange(len(some))
            for _ in range(min(k, len(t))):
                best = d.argmin(axis=1)
                yield some, t[best], d[row, best]
                d[row, best] = np.inf


# ------------------------------------------------------------ places along lines
BLOCK = 256


def measured(segs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Segments with ``before_m``, the length of their line in front of them, and
    ``total_m``.  Two levels of prefix sums in micrometres (exact, so any order
    gives the same): within blocks of ``block`` segments, and over the block sums,
    so a line of any length spreads over many tasks."""
    um = F.floor(F.col("len") * F.lit(1e6) + F.lit(0.5)).cast("decimal(28,0)")
    s = segs.withColumn("_um", um).withColumn("block", F.floor(F.col("seg") / block).cast("long"))
    sums = s.groupBy("feature", "part", "block").agg(F.sum("_um").cast("decimal(38,0)").alias("_sum"))
    line = Window.partitionBy("feature")  # one row per block
    sums = sums.select("feature", "part", "block", F.sum("_sum").over(line).alias("_total"),
                       (F.sum("_sum").over(line.orderBy("part", "block")) - F.col("_sum")).alias("_start"))
    w = Window.partitionBy("feature", "part", "block").orderBy("seg")
    s = s.withColumn("_here", F.sum("_um").over(w) - F.col("_um"))
    return (s.join(sums, ["feature", "part", "block"])
            .withColumn("before_m", (F.col("_start") + F.col("_here")).cast("double") / F.lit(1e6))
            .withColumn("total_m", F.col("_total").cast("double") / F.lit(1e6))
            .drop("_um", "_here", "_start", "_total", "_sum"))


def locate(points: DataFrame, segs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where each point's line comes closest to it: ``(point_id, feature, part, seg,
    along_m, total_m, distance_m)``; ties to the first segment.

    points: point_id, feature, x, y;  segs as of ``geometry.segments``.  Of each
    block of segments a box is known: a block is read for a point only if its box
    is not farther than some block's first vertex, which bounds the distance."""
    m = measured(segs, block)
    boxes = m.groupBy("feature", "part", "block").agg(
        F.min(F.least("x1", "x2")).alias("bx0"), F.min(F.least("y1", "y2")).alias("by0"),
        F.max(F.greatest("x1", "x2")).alias("bx1"), F.max(F.greatest("y1", "y2")).alias("by1"),
        F.min_by(F.struct("x1", "y1"), "seg").alias("v"))
    near = points.select("point_id", "feature", "x", "y").join(boxes, "feature").selectExpr(
        "point_id", "feature", "x", "y", "part", "block",
        "sqrt(power(greatest(bx0 - x, 0D, x - bx1), 2) + power(greatest(by0 - y, 0D, y - by1), 2)) AS least_m",
        "sqrt(power(v.x1 - x, 2) + power(v.y1 - y, 2)) AS most_m")
    bound = near.groupBy("point_id", "feature").agg(F.min("most_m").alias("bound_m"))
    near = near.join(bound, ["point_id", "feature"]).where("least_m <= bound_m * (1 + 1e-9D) + 1e-6D")
    pairs = near.select("point_id", "feature", "part", "block", "x", "y").join(m, ["feature", "part", "block"])
    t = ("CASE WHEN len > 0 THEN least(1D, greatest(0D, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) "
         "/ ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0D END")
    pairs = pairs.selectExpr("*", f"{t} AS t")
    d = E.seg_len(F.col("x"), F.col("y"), F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")),
                  F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1")))
    best = pairs.groupBy("point_id", "feature").agg(F.min(F.struct(
        d.alias("distance_m"), "part", "seg", (F.col("before_m") + F.col("t") * F.col("len")).alias("along_m"),
        "total_m")).alias("b"))
    return best.select("point_id", "feature", "b.part", "b.seg", "b.along_m", "b.total_m", "b.distance_m")
