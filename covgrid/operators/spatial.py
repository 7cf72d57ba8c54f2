"""Spatial joins on grid cells: covered length of lines inside polygons,
point-in-polygon, line adjacency and nearest points.

Pattern: explode both sides to the integer grid cells their boxes overlap,
equi-join on (cx, cy), then apply the exact test.  A pair met in several
cells is kept only in its *reference cell* (the cell of the lower-left
corner of the two boxes' intersection), so no ``distinct`` shuffle is
needed.

Lines meet polygons on the leaves of a quadtree: a cell that holds too many
segments and edges is split into four, and again, so a dense city is many keys
and an empty region few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covgrid.functions import expr as E
from covgrid.operators import geometry as G
from covgrid.session import spread, task_slots

SEG_KEY = ["feature", "part", "seg", "piece"]
EPS = 1e-9


def _box(df: DataFrame, x1, y1, x2, y2, prefix: str) -> DataFrame:
    return df.select("*", F.least(x1, x2).alias(f"{prefix}x0"), F.least(y1, y2).alias(f"{prefix}y0"),
                     F.greatest(x1, x2).alias(f"{prefix}x1"), F.greatest(y1, y2).alias(f"{prefix}y1"))


def _overlap_in_ref_cell(a: str, b: str, size: float) -> Column:
    """Boxes a and b overlap and the current (cx, cy) is the reference cell
    (one SQL expression: a single call to build, however often it is used)."""
    z = float(size)
    return F.expr(
        f"{a}x0 <= {b}x1 AND {b}x0 <= {a}x1 AND {a}y0 <= {b}y1 AND {b}y0 <= {a}y1"
        f" AND cx = CAST(floor(greatest({a}x0, {b}x0) / {z!r}) AS BIGINT)"
        f" AND cy = CAST(floor(greatest({a}y0, {b}y0) / {z!r}) AS BIGINT)")


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def _div(a: Column, b: Column) -> Column:
    """a / b, null when b == 0 (ANSI mode raises on a zero divisor)."""
    return F.when(b != 0, a / b)


def segment_edge_contacts(pairs: DataFrame) -> DataFrame:
    """For rows holding a segment (x1,y1)-(x2,y2) and an edge (ax,ay)-(bx,by):
    ``hit`` (closed segments touch), ``ts`` (split parameters along the
    segment: the crossing, or both ends of a collinear overlap) and
    ``clean`` (the crossing passes through the interior of both, away from
    vertices by a relative margin, so the inside/outside status certainly
    flips there).

    Intermediate terms are separate projections so each is computed once,
    written as SQL expressions (one JVM call per projection to build)."""
    p = pairs.selectExpr("*", "x2 - x1 AS _rx", "y2 - y1 AS _ry", "bx - ax AS _sx", "by - ay AS _sy",
                         "ax - x1 AS _qx", "ay - y1 AS _qy")
    p = p.selectExpr("*", "_rx * _sy - _ry * _sx AS _den", "_qx * _sy - _qy * _sx AS _tn",
                     "_qx * _ry - _qy * _rx AS _un", "_rx * _rx + _ry * _ry AS _rr",
                     "_qx * _rx + _qy * _ry AS _ta_n", "(bx - x1) * _rx + (by - y1) * _ry AS _tb_n")
    # division guarded: ANSI mode raises on a zero divisor
    p = p.selectExpr("*", "CASE WHEN _den <> 0 THEN _tn / _den END AS _t",
                     "CASE WHEN _den <> 0 THEN _un / _den END AS _u",
                     "CASE WHEN _rr <> 0 THEN _ta_n / _rr END AS _ta",
                     "CASE WHEN _rr <> 0 THEN _tb_n / _rr END AS _tb")
    e = repr(EPS)
    out = p.selectExpr(
        "*",
        "coalesce(_den <> 0 AND _t >= 0 AND _t <= 1 AND _u >= 0 AND _u <= 1, false)"
        " OR coalesce(_den = 0 AND _un = 0 AND _rr > 0 AND greatest(_ta, _tb) >= 0 AND least(_ta, _tb) <= 1,"
        " false) AS hit",
        "CASE WHEN _den <> 0 THEN array(_t)"
        " ELSE array(least(1.0D, greatest(0.0D, _ta)), least(1.0D, greatest(0.0D, _tb))) END AS ts",
        f"coalesce(_den <> 0 AND _t > {e} AND _t < 1 - {e} AND _u > {e} AND _u < 1 - {e}, false) AS clean")
    return out.drop("_rx", "_ry", "_sx", "_sy", "_qx", "_qy", "_den", "_tn", "_un", "_rr", "_ta_n", "_tb_n",
                    "_t", "_u", "_ta", "_tb")


# --------------------------------------------------------------- quadtree leaves
QUAD_DEPTH = 6
QUAD_LIMIT = 2_000
#: No cell is split that holds less than this share of all places, so no more cells than this are.
QUAD_SPLITS = 10_000


def dense_cells(places: DataFrame, top: float, depth: int = QUAD_DEPTH, limit: int = QUAD_LIMIT) -> DataFrame:
    """The inner nodes of a quadtree over ``places(x, y)``: ``(tx, ty, inner)`` for each
    cell of side ``top`` with more than ``limit`` places.  ``inner[i]`` tells whether
    node ``i`` of that cell (its levels one after the other, each row by row) is
    split: it holds more than ``limit`` places and is not on the last level.  One
    count per finest cell; an array has (4 ** depth - 1) / 3 entries.

    A cell is only split if it holds more than one part in ``QUAD_SPLITS`` of all
    places, so there are fewer rows than that, whatever the data: 15 MB at most,
    which is why ``quad_cells`` may broadcast them."""
    finest = float(top) / 2 ** depth
    n = places.groupBy(E.cell("x", finest).alias("fx"), E.cell("y", finest).alias("fy")).agg(
        F.count(F.lit(1)).alias("n"))
    up = n.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    cells = up.selectExpr("d", f"shiftright(fx, {depth} - d) AS cx", f"shiftright(fy, {depth} - d) AS cy", "n")
    enough = n.agg(F.greatest(F.lit(limit), F.coalesce(F.sum("n"), F.lit(0)) / QUAD_SPLITS).alias("n")).scalar()
    cells = cells.groupBy("d", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") > enough)
    node = ("CAST((power(4, d) - 1) / 3 + pmod(cy, shiftleft(1L, d)) * shiftleft(1L, d) + pmod(cx, shiftleft(1L, d)) "
            "AS INT) AS node")
    nodes = cells.selectExpr("shiftright(cx, d) AS tx", "shiftright(cy, d) AS ty", node)
    size = (4 ** depth - 1) // 3
    return nodes.groupBy("tx", "ty").agg(F.collect_set("node").alias("_s")).selectExpr(
        "tx", "ty", f"transform(sequence(0, {size - 1}), i -> array_contains(_s, i)) AS inner")


def meeting_places(segs: DataFrame, poly_rings: DataFrame) -> DataFrame:
    """``(x, y)`` of what the quadtree of lines and polygons counts: one place per
    segment and per polygon edge."""
    edg = G.edges(poly_rings.select("pts"))
    return segs.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(
        edg.select(F.col("ax").alias("x"), F.col("ay").alias("y")))


def quad_cells(df: DataFrame, xmin: str, ymin: str, xmax: str, ymax: str, dense: DataFrame | None, top: float,
               depth: int = QUAD_DEPTH) -> DataFrame:
    """Each row once per quadtree leaf that its box overlaps: ``qd`` (level), ``cx``,
    ``cy`` (the cell among those of that level).  The row's cells of side ``top`` are
    joined to the inner nodes; below a cell that has none, nothing is done.  No
    ``dense`` table: no cell is split."""
    z = float(top)
    if dense is None:
        return G.bbox_cells(df.withColumn("qd", F.lit(0)), xmin, ymin, xmax, ymax, z)
    at = df.withColumn("tx", F.explode(E.cell_range(xmin, xmax, z))).withColumn(
        "ty", F.explode(E.cell_range(ymin, ymax, z)))
    at = at.join(F.broadcast(dense), ["tx", "ty"], "left")  # bounded, see dense_cells
    cells = "array(named_struct('d', 0, 'cx', tx, 'cy', ty))"
    for d in range(depth):
        side = repr(z / 2 ** (d + 1))
        first, width = (4 ** d - 1) // 3, 2 ** d
        lo_x, hi_x, lo_y, hi_y = (f"CAST(floor({v} / {side}D) AS BIGINT)" for v in (xmin, xmax, ymin, ymax))
        four = ", ".join(f"named_struct('d', {d + 1}, 'cx', 2 * c.cx + {i}, 'cy', 2 * c.cy + {j})"
                         for j in (0, 1) for i in (0, 1))
        cells = (f"flatten(transform({cells}, c -> IF(c.d = {d} AND element_at(inner, CAST({first} + pmod(c.cy, {width}) * "
                 f"{width} + pmod(c.cx, {width}) AS INT) + 1), filter(array({four}), k -> k.cx BETWEEN {lo_x} AND {hi_x} "
                 f"AND k.cy BETWEEN {lo_y} AND {hi_y}), array(c))))")
    leaf = f"IF(inner IS NULL, array(named_struct('d', 0, 'cx', tx, 'cy', ty)), {cells})"
    out = at.withColumn("_leaf", F.explode(F.expr(leaf)))
    return out.select("*", F.col("_leaf.d").alias("qd"), F.col("_leaf.cx").alias("cx"),
                      F.col("_leaf.cy").alias("cy")).drop("_leaf", "inner", "tx", "ty")


def _overlap_in_ref_leaf(a: str, b: str, top: float) -> Column:
    """Boxes a and b overlap and the current leaf (qd, cx, cy) holds the lower
    left corner of their intersection."""
    side = f"({float(top)!r}D / shiftleft(1, qd))"
    return F.expr(
        f"{a}x0 <= {b}x1 AND {b}x0 <= {a}x1 AND {a}y0 <= {b}y1 AND {b}y0 <= {a}y1"
        f" AND cx = CAST(floor(greatest({a}x0, {b}x0) / {side}) AS BIGINT)"
        f" AND cy = CAST(floor(greatest({a}y0, {b}y0) / {side}) AS BIGINT)")


# ------------------------------------------------------------ lines in polygons
def covered_length(segs: DataFrame, poly_rings: DataFrame, cell: float = 10_000.0,
                   band: float | None = None, box_cell: float | None = None, inside: str = "ray",
                   union: bool = False, limit: int = QUAD_LIMIT, grid: DataFrame | str | None = "count") -> DataFrame:
    """Length of each line feature inside each polygon it intersects.

    segs:       feature, part, seg, x1, y1, x2, y2, len (metres)
    poly_rings: id, operator_code, part, ring, pts  (closed rings; ring 0 =
                shell; holes need no special case, the odd-even rule covers
                every ring)
    returns     feature, id, operator_code, inside_m -- one row per pair whose
                geometries intersect (touching only gives inside_m = 0).

    With ``union`` the result has one row per feature and operator, without an
    id: what several polygons of the operator cover counts once.

    Segments longer than ``cell`` are cut.  Segments meet edges and the boxes of
    whole polygon parts on the leaves of a quadtree from cells of ``box_cell``
    (default 4 x cell) down, split while they hold more than ``limit`` segments
    and edges.  They are counted in the same plan, or ``grid`` is a stored table
    of such counts (``dense_cells``), or None where none is so dense.

    ``inside`` picks how pieces are classified: ``"ray"`` tests every piece
    midpoint against the polygon part's edges in its band; ``"walk"`` walks
    each line through each polygon part, flipping the status at clean
    crossings, and ray-tests only where the status is not known (a line
    that starts inside the part's box, or a cut through a vertex or along an
    edge).  The walk reads far fewer edges on large rings.
    """
    c = F.col
    pieces = inside_pieces(segs, poly_rings, cell, band, box_cell, inside, limit, grid)
    held = c("n") % 2 == 1
    if union:
        # gaps and islands within each segment piece: what of an interval lies past all before it
        w = Window.partitionBy(*SEG_KEY, "operator_code").orderBy("k", "t1")
        reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.greatest(F.lit(0.0), c("t1") - F.greatest(c("k"), F.coalesce(reach, F.lit(0.0)))) * c("len")
        parts = pieces.filter(held).select("feature", "operator_code", new.alias("_m"), F.lit(True).alias("_meets"))
        touching = pieces.filter(~held & c("touch")).select("feature", "operator_code", F.lit(0.0).alias("_m"),
                                                           F.lit(True).alias("_meets"))
        return parts.unionByName(touching).groupBy("feature", "operator_code").agg(F.sum("_m").alias("inside_m"))
    # per (feature, polygon): inside length, and whether they meet at all
    # (an edge contact, or any piece inside).
    per = pieces.groupBy("feature", "id", "operator_code").agg(
        F.sum(F.when(held, c("piece_len")).otherwise(F.lit(0.0))).alias("inside_m"),
        F.max(c("touch") | held).alias("meets"))
    return per.filter("meets").select("feature", "id", "operator_code", "inside_m")


def inside_pieces(segs: DataFrame, poly_rings: DataFrame, cell: float, band: float | None = None,
                  box_cell: float | None = None, inside: str = "ray", limit: int = QUAD_LIMIT,
                  grid: DataFrame | str | None = "count") -> DataFrame:
    """The pieces into which polygon parts cut the segments near them: segment
    keys, polygon keys, start ``k`` and end ``t1`` as fractions of the segment
    of length ``len``, ``touch`` (the two meet) and ``n`` (odd: inside)."""
    band = band or cell
    top = box_cell or 4 * cell
    # Line segments are few next to coverage edges but each one drives many
    # cell and edge tests: always spread them over every task slot (AQE
    # may have coalesced their last shuffle into very few partitions).
    spark = segs.sparkSession
    tasks = max(task_slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    segs = G.split_segments(segs, cell).select(*SEG_KEY, "npieces", "x1", "y1", "x2", "y2", "len").repartition(tasks)
    seg_box = _box(segs, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), "s")

    pr = spread(poly_rings.withColumnRenamed("part", "ppart"))
    pkey = ["id", "operator_code", "ppart"]
    pbox = G.ring_bbox(pr, *pkey).select(*pkey, F.col("xmin").alias("px0"), F.col("ymin").alias("py0"),
                                         F.col("xmax").alias("px1"), F.col("ymax").alias("py1"))
    edg = G.edges(pr.select(*pkey, "ring", "pts"))
    dense = dense_cells(meeting_places(segs, pr), top, limit=limit) if isinstance(grid, str) else grid
    seg_cells = quad_cells(seg_box, "sx0", "sy0", "sx1", "sy1", dense, top)

    # 1. candidate (segment, polygon part) pairs from box cells: segments
    #    wholly inside a polygon meet no edge, so edges alone miss them.
    poly_cells = quad_cells(pbox, "px0", "py0", "px1", "py1", dense, top)
    leaf = ["qd", "cx", "cy"]
    cand = (seg_cells.join(poly_cells, leaf).filter(_overlap_in_ref_leaf("s", "p", top))
            .select(*SEG_KEY, *pkey, "npieces", "x1", "y1", "x2", "y2", "len"))

    # 2. segment x edge contacts in shared leaves -> split parameters.
    e_box = _box(edg, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), "e")
    edge_cells = quad_cells(e_box, "ex0", "ey0", "ex1", "ey1", dense, top)
    se = seg_cells.join(edge_cells, leaf).filter(_overlap_in_ref_leaf("s", "e", top))
    hits = segment_edge_contacts(se).filter("hit")

    # 3. pieces between cuts: cut parameters become rows (plus 0 and 1 for
    #    every candidate pair); ``lead`` over (segment, polygon part) ordered
    #    by t gives the sub-intervals, ``max(hit)`` over the same window
    #    whether the pair touches at all.  No per-pair arrays are collected.
    geom = ["npieces", "x1", "y1", "x2", "y2", "len"]
    ends = cand.select(*SEG_KEY, *pkey, *geom, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"),
                       F.lit(False).alias("hit"), F.lit(False).alias("clean"))
    cuts = hits.select(*SEG_KEY, *pkey, *geom, F.explode("ts").alias("t"), "hit", "clean")
    key = SEG_KEY + pkey
    w = Window.partitionBy(*key).orderBy("t")
    w_all = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_t = Window.partitionBy(*key, "t")
    c = F.col
    tt = ends.unionByName(cuts).select(
        "*", F.lead("t").over(w).alias("t1"), F.max("hit").over(w_all).alias("touch"),
        F.sum(c("hit").cast("int")).over(w_t).alias("_nh"),
        F.min(F.when(c("hit"), c("clean").cast("int"))).over(w_t).alias("_clean"))
    # The cut at a piece's start flips the status iff exactly one edge is
    # hit there, cleanly; any other hit there leaves the status unknown.
    toggle = (c("_nh") == 1) & (c("_clean") == 1) & (c("t") > 0)
    iv = tt.filter(c("t1") > c("t")).select(
        *key, "touch", c("t").alias("k"), "t1", "len", "npieces", toggle.alias("toggle"),
        ((c("_nh") > 0) & ~toggle).alias("ambiguous"),
        ((c("t1") - c("t")) * c("len")).alias("piece_len"),
        (c("x1") + (c("x2") - c("x1")) * (c("t") + c("t1")) / 2).alias("mx"),
        (c("y1") + (c("y2") - c("y1")) * (c("t") + c("t1")) / 2).alias("my"))

    # 4. midpoint inside test: odd number of edges of the same polygon part
    #    crossed by the ray to +x (half-open rule), edges bucketed by y band.
    edge_rows = (edg.withColumn("row", F.explode(E.cell_range(F.least("ay", "by"), F.greatest("ay", "by"), band)))
                 .select("id", "ppart", "row", "ax", "ay", "bx", "by"))
    if inside == "walk":
        iv = _walk(iv)
        tested = iv.filter("needs_ray")
    else:
        tested = iv
    mids = tested.withColumn("row", E.cell("my", band)).alias("m")
    er = edge_rows.alias("e")
    m, e = (lambda n: F.col(f"m.{n}")), (lambda n: F.col(f"e.{n}"))
    straddle = (e("ay") > m("my")) != (e("by") > m("my"))
    crossing = m("mx") < e("ax") + _div((m("my") - e("ay")) * (e("bx") - e("ax")), e("by") - e("ay"))
    on = (m("id") == e("id")) & (m("ppart") == e("ppart")) & (m("row") == e("row")) & straddle & crossing
    # Left join keeps pieces that cross no edge (outside, unless touching).
    pieces = (mids.join(er, on, "left")
              .groupBy(*[m(k) for k in SEG_KEY], m("id"), m("operator_code"), m("ppart"), m("k"))
              .agg(F.first(m("piece_len")).alias("piece_len"), F.first(m("t1")).alias("t1"),
                   F.first(m("len")).alias("len"), F.first(m("touch")).alias("touch"), F.count(e("ax")).alias("n")))

    if inside == "walk":
        status = pieces.select(*SEG_KEY, *pkey, "k", (c("n") % 2).alias("_ray"))
        pieces = _walk_status(iv.join(status, SEG_KEY + pkey + ["k"], "left"))

    return pieces


def _walk(iv: DataFrame) -> DataFrame:
    """Order pieces along each (line part, polygon part) and mark anchors:
    a piece not continuing the previous one, or one after an ambiguous cut.
    An anchor whose predecessor piece exists but is not a candidate starts
    outside (the shared point lies outside the part's box); other anchors
    need a ray test.  ``grp`` numbers the runs between anchors, ``par`` is
    the parity of clean crossings since the run's anchor."""
    c = F.col
    walk = ["feature", "part", "id", "operator_code", "ppart"]
    w = Window.partitionBy(*walk).orderBy("seg", "piece", "k")
    prev = lambda n: F.lag(n).over(w)
    same_piece = (prev("seg") == c("seg")) & (prev("piece") == c("piece")) & (prev("t1") == c("k"))
    next_piece = ((c("k") == 0) & (prev("t1") == 1)
                  & (((prev("seg") == c("seg")) & (prev("piece") == c("piece") - 1))
                     | ((prev("seg") == c("seg") - 1) & (c("piece") == 0) & (prev("piece") == prev("npieces") - 1))))
    contiguous = F.coalesce(same_piece | next_piece, F.lit(False))
    anchor = ~contiguous | c("ambiguous")
    known_out = ~contiguous & ~c("ambiguous") & ((c("seg") > 0) | (c("piece") > 0)) & (c("k") == 0)
    iv = iv.select("*", anchor.alias("anchor"), known_out.alias("known_out"))
    iv = iv.select("*", (c("anchor") & ~c("known_out")).alias("needs_ray"),
                   F.sum(c("anchor").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("grp"))
    wg = Window.partitionBy(*walk, "grp").orderBy("seg", "piece", "k").rowsBetween(Window.unboundedPreceding, 0)
    return iv.select("*", F.sum((c("toggle") & ~c("anchor")).cast("int")).over(wg).alias("par"))


def _walk_status(iv: DataFrame) -> DataFrame:
    """Status of every piece: its run's anchor status (ray result, or 0 when
    known outside) flipped by the crossings since; returned in the shape of
    the ray path's piece counts (``n`` odd = inside)."""
    c = F.col
    walk = ["feature", "part", "id", "operator_code", "ppart"]
    wg = Window.partitionBy(*walk, "grp").orderBy("seg", "piece", "k")
    anchor_status = F.when(c("known_out"), F.lit(0)).otherwise(F.coalesce(c("_ray"), F.lit(0)))
    first = F.first(F.when(c("anchor"), anchor_status), ignorenulls=True).over(
        wg.rowsBetween(Window.unboundedPreceding, 0))
    return iv.select(*SEG_KEY, "id", "operator_code", "ppart", "k", "t1", "len", "piece_len", "touch",
                     ((first + c("par")) % 2).cast("long").alias("n"))
