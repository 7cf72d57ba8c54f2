"""Covered length of lines per operator, summed leaf by leaf.

Route coverage only needs sums over all polygons of an operator, so no
(segment, polygon) pair becomes a row.  Segments and polygon parts are dealt to
the leaves of the quadtree of ``operators.spatial``.  A part that holds a leaf
without any edge in it is a count there; of the others the edges in the leaf and
those to its right go along.  Each leaf then sums what its segments have inside
its own square, so what is shuffled are the leaves of the input and one row per
leaf, line and operator, not their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.operators import geometry as G
from covgrid.operators import spatial as S
from covgrid.session import ship_package, spread, task_slots

LEAF = ["qd", "cx", "cy"]
#: Segment x edge tests made at once.
TESTS = 100_000


def operator_lengths(segs: DataFrame, poly_rings: DataFrame, cell: float = 10_000.0, box_cell: float | None = None,
                     union: bool = False, limit: int = S.QUAD_LIMIT, grid: DataFrame | str | None = "count") -> DataFrame:
    """``(feature, operator_code, inside_m)`` of each line and operator that meet: the sum of
    ``spatial.covered_length`` over the operator's polygons, or with ``union`` the
    same as there.  Same tests on the same numbers; parameters as there."""
    top = box_cell or 4 * cell
    spark = segs.sparkSession
    ship_package(spark)
    tasks = max(task_slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    # a segment that comes twice counts once
    # dealt once: what follows groups by more than the keys of the deal
    segs = (G.split_segments(segs, cell).select(*S.SEG_KEY, "x1", "y1", "x2", "y2").repartition(tasks, *S.SEG_KEY)
            .distinct())
    pr = spread(poly_rings.withColumnRenamed("part", "ppart"))
    dense = S.dense_cells(S.meeting_places(segs, pr), top, limit=limit) if isinstance(grid, str) else grid

    line = S.quad_cells(S._box(segs, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), "s"), "sx0", "sy0", "sx1", "sy1",
                        dense, top)
    side = lambda f, c: f(F.transform("pts", lambda p: p[c]))
    pkey = ["id", "operator_code", "ppart"]
    parts = poly_rings.withColumnRenamed("part", "ppart").repartition(tasks, *pkey).groupBy(*pkey).agg(
        F.collect_list("pts").alias("rings"), F.min(side(F.array_min, "x")).alias("px0"),
        F.min(side(F.array_min, "y")).alias("py0"), F.max(side(F.array_max, "x")).alias("px1"),
        F.max(side(F.array_max, "y")).alias("py1"))
    held = S.quad_cells(parts, "px0", "py0", "px1", "py1", dense, top).select(
        F.col("qd").cast("int").alias("qd"), "cx", "cy", "operator_code", "rings")
    code = f"operator_code {parts.schema['operator_code'].dataType.simpleString()}"
    held = held.mapInArrow(_leaf_parts(top), f"qd int, cx bigint, cy bigint, {code}, n bigint, v array<double>")

    feature = segs.schema["feature"].dataType
    line = line.select(F.col("qd").cast("int").alias("qd"), "cx", "cy", "feature",
                       F.lit(None).cast(parts.schema["operator_code"].dataType).alias("operator_code"),
                       F.lit(-1).cast("long").alias("n"), F.array("x1", "y1", "x2", "y2").alias("v"))
    rows = line.unionByName(held.withColumn("feature", F.lit(None).cast(feature)))
    # by leaf; more partitions than slots, so that leaves of unlike weight even out
    rows = rows.repartition(4 * tasks, *LEAF).sortWithinPartitions(*LEAF)
    out = rows.mapInArrow(_leaf_lengths(top, union), f"feature {feature.simpleString()}, {code}, inside_m double")
    return out.groupBy("feature", "operator_code").agg(F.sum("inside_m").alias("inside_m"))


def _leaf_parts(top: float):
    """Rows of a polygon part in a leaf -> its edges there and to the right as ``v``
    (in the leaf or not, ax, ay, bx, by for each) with ``n`` 0, or, without an edge in the
    leaf, the number of parts that hold it whole as ``n``."""
    def run(batches):
        for b in batches:
            rings = b.column("rings")
            r_off = rings.offsets.to_numpy().astype(np.int64)
            p_off = rings.values.offsets.to_numpy().astype(np.int64)
            x, y = (rings.values.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            ring_row = np.repeat(np.arange(len(rings)), np.diff(r_off))
            ring = np.arange(r_off[0], r_off[-1])
            n_edges = np.maximum(p_off[ring + 1] - p_off[ring] - 1, 0)
            row = np.repeat(ring_row, n_edges)
            at = np.repeat(p_off[ring] - (np.cumsum(n_edges) - n_edges), n_edges) + np.arange(n_edges.sum())
            ax, ay, bx, by = x[at], y[at], x[at + 1], y[at + 1]
            side = float(top) / 2.0 ** b.column("qd").to_numpy()
            lx, ly = b.column("cx").to_numpy() * side, b.column("cy").to_numpy() * side
            z, x0, y0 = side[row], lx[row], ly[row]
            x1, y1 = x0 + z, y0 + z
            slack = 1e-9 * (np.abs(x0) + np.abs(y0) + z)
            in_row = (np.minimum(ay, by) <= y1 + slack) & (np.maximum(ay, by) >= y0 - slack) & (np.maximum(ax, bx) >= x0 - slack)
            # a slanting edge misses the leaf if all its corners lie on one side
            c = [(bx - ax) * (v - ay) - (by - ay) * (u - ax) for u in (x0, x1) for v in (y0, y1)]
            room = slack * (np.abs(bx - ax) + np.abs(by - ay) + z)
            inside = (in_row & (np.minimum(ax, bx) <= x1 + slack) & (np.minimum.reduce(c) <= room)
                      & (np.maximum.reduce(c) >= -room))
            met = np.bincount(row[inside], minlength=len(rings)) > 0
            # the others hold their leaf if they hold its centre
            mx, my = x0 + z / 2, y0 + z / 2
            whole = np.bincount(row[_right(mx, my, ax, ay, bx, by)], minlength=len(rings)) % 2 == 1
            whole &= ~met
            keep = in_row & met[row]
            order = np.flatnonzero(keep)  # rows ascend
            v = np.column_stack([inside[order].astype(float), ax[order], ay[order], bx[order], by[order]])
            count = np.bincount(row[order], minlength=len(rings))
            pick = np.flatnonzero(met | whole)
            off = np.concatenate([[0], np.cumsum(count[pick] * 5)]).astype(np.int32)
            take = pa.array(pick)
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(take) for k in (*LEAF, "operator_code")]
                + [pa.array(whole[pick].astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(v.ravel()))],
                names=[*LEAF, "operator_code", "n", "v"])
    return run


def _right(px, py, ax, ay, bx, by):
    """Does the ray from p to +x cross the edge a-b (half-open rule)?"""
    dy = by - ay
    return ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / np.where(dy != 0, dy, 1.0))


def _leaf_lengths(top: float, union: bool):
    """Rows sorted by leaf -> a row per leaf, line and operator that meet there."""
    def run(batches):
        held, last = [], None
        schema = None
        for b in batches:
            if b.num_rows == 0:
                continue
            schema = b.schema
            keys = np.column_stack([b.column(k).to_numpy().astype(np.int64) for k in LEAF])
            turn = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if last is not None and (keys[0] != last).any():
                yield from _sums(pa.Table.from_batches(held), top, union)
                held = []
            if len(turn):
                held.append(b.slice(0, turn[-1]))
                yield from _sums(pa.Table.from_batches(held), top, union)
                held = [b.slice(turn[-1])]
            else:
                held.append(b)
            last = keys[-1]
        if held:
            yield from _sums(pa.Table.from_batches(held, schema), top, union)
    return run


def _sums(rows: pa.Table, top: float, union: bool):
    """The rows of whole leaves -> one batch of ``feature, operator_code, inside_m``."""
    rows = rows.combine_chunks()
    col = lambda n: rows.column(n).chunk(0)
    keys = np.column_stack([col(k).to_numpy().astype(np.int64) for k in LEAF])
    n, off, v = col("n").to_numpy(), col("v").offsets.to_numpy(), col("v").values.to_numpy()
    codes = col("operator_code").dictionary_encode(null_encoding="encode")
    code = codes.indices.to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
    out_row, out_op, out_m = [], [], []
    for s, e in zip(starts[:-1], starts[1:]):
        line = s + np.flatnonzero(n[s:e] < 0)
        part = s + np.flatnonzero(n[s:e] == 0)
        whole = s + np.flatnonzero(n[s:e] > 0)
        if not len(line) or not len(part) + len(whole):
            continue
        ops, op = np.unique(np.concatenate([code[part], code[whole]]), return_inverse=True)
        cover = np.bincount(op[len(part):], weights=n[whole], minlength=len(ops))
        size = (off[part + 1] - off[part]) // 5
        edges = np.concatenate([v[off[p]:off[p + 1]] for p in part]).reshape(-1, 5) if len(part) else np.zeros((0, 5))
        side = float(top) / 2.0 ** keys[s, 0]
        box = keys[s, 1] * side, (keys[s, 1] + 1) * side, keys[s, 2] * side, (keys[s, 2] + 1) * side
        step = max(1, TESTS // max(1, len(edges)))
        for k in range(0, len(line), step):
            some = line[k:k + step]
            seg = v[off[some][:, None] + np.arange(4)]
            m, meets = _in_leaf(seg, box, edges, size, op[:len(part)], cover, union)
            i, o = np.nonzero(meets)
            out_row.append(some[i])
            out_op.append(ops[o])
            out_m.append(m[i, o])
    if out_row:  # one row for each line and operator, whatever the number of segments and leaves
        features = col("feature").dictionary_encode(null_encoding="encode")
        n_codes = len(codes.dictionary)
        pair = features.indices.to_numpy()[np.concatenate(out_row)].astype(np.int64) * n_codes + np.concatenate(out_op)
        pair, at = np.unique(pair, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [features.dictionary.take(pa.array(pair // n_codes)), codes.dictionary.take(pa.array(pair % n_codes)),
             pa.array(np.bincount(at, weights=np.concatenate(out_m), minlength=len(pair)).astype(float))],  # none: integers
            names=["feature", "operator_code", "inside_m"])


def _in_leaf(seg, box, edges, size, op, cover, union):
    """Lengths and meetings, segments x operators, within the square ``box``.

    ``edges`` are those of the parts one after the other, ``size`` of each, ``op`` their
    operators; ``cover`` counts the parts of each operator that hold the leaf.  Cuts,
    pieces and the test of their middles are those of ``spatial.inside_pieces``."""
    x1, y1, x2, y2 = seg.T
    length = np.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    # the part of the segment in the half-open square: neighbours share their ends exactly
    lo, hi = np.zeros(len(seg)), np.ones(len(seg))
    for a, b, g0, g1 in ((x1, x2, *box[:2]), (y1, y2, *box[2:])):
        d = b - a
        flat = d == 0
        t0, t1 = (g0 - a) / np.where(flat, 1.0, d), (g1 - a) / np.where(flat, 1.0, d)
        lo = np.where(flat, lo, np.maximum(lo, np.minimum(t0, t1)))
        hi = np.where(flat, np.where((a >= g0) & (a < g1), hi, -1.0), np.minimum(hi, np.maximum(t0, t1)))
    here = hi > lo
    full = np.where(here, (hi - lo) * length, 0.0)
    m = np.outer(full, (cover > 0) if union else cover)
    meets = here[:, None] & (cover > 0)[None, :]
    if not len(size):
        return m, meets
    n_ops, n_parts = len(cover), len(size)
    first = np.concatenate([[0], np.cumsum(size)])
    part_of = np.repeat(np.arange(n_parts), size)

    near = np.flatnonzero(edges[:, 0] > 0)
    ax, ay, bx, by = edges[near, 1:].T
    # only pairs whose boxes meet can touch
    slack = 1e-9 * max(map(abs, box))
    close = np.ones((len(seg), len(near)), dtype=bool)
    for s, t, a, b in ((x1, x2, ax, bx), (y1, y2, ay, by)):
        close &= np.minimum(a, b) <= (np.maximum(s, t) + slack)[:, None]
        close &= np.maximum(a, b) >= (np.minimum(s, t) - slack)[:, None]
    i, e = np.nonzero(close)
    rx, ry, sx, sy = (x2 - x1)[i], (y2 - y1)[i], (bx - ax)[e], (by - ay)[e]
    qx, qy = ax[e] - x1[i], ay[e] - y1[i]
    den, tn, un = rx * sy - ry * sx, qx * sy - qy * sx, qx * ry - qy * rx
    safe = np.where(den != 0, den, 1.0)
    t, u = tn / safe, un / safe
    hit = np.flatnonzero((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    cut_i, cut_p, cut_t = [i[hit]], [part_of[near[e[hit]]]], [t[hit]]
    flat = np.flatnonzero((den == 0) & (un == 0))  # on one line
    if len(flat):
        i, e, dx, dy, qx, qy = (v[flat] for v in (i, e, rx, ry, qx, qy))
        rr = dx * dx + dy * dy
        ok = rr > 0
        rr = np.where(ok, rr, 1.0)
        ta = (qx * dx + qy * dy) / rr
        tb = ((bx[e] - x1[i]) * dx + (by[e] - y1[i]) * dy) / rr
        ok &= (np.maximum(ta, tb) >= 0) & (np.minimum(ta, tb) <= 1)
        for w in (ta, tb):
            cut_i.append(i[ok])
            cut_p.append(part_of[near[e[ok]]])
            cut_t.append(np.clip(w[ok], 0.0, 1.0))
    ci, cp, ct = (np.concatenate(c) for c in (cut_i, cut_p, cut_t))
    meets[ci, op[cp]] = True
    within = (ct > lo[ci]) & (ct < hi[ci])
    ci, cp, ct = ci[within], cp[within], ct[within]

    # pairs without a cut: the middle of the whole piece
    ax, ay, bx, by = edges[:, 1:].T
    mid = (lo + hi) / 2
    mx, my = x1 + (x2 - x1) * mid, y1 + (y2 - y1) * mid
    crossed = _right(mx[:, None], my[:, None], ax, ay, bx, by)
    odd = np.add.reduceat(crossed, first[:-1], axis=1, dtype=np.int64) % 2 == 1
    odd &= here[:, None]
    odd[ci, cp] = False
    by_op = np.zeros((n_parts, n_ops))
    by_op[np.arange(n_parts), op] = 1.0
    wholly = odd.astype(float) @ by_op
    meets |= wholly > 0
    m = np.outer(full, np.ones(n_ops)) * ((wholly + cover > 0) if union else (wholly + cover))
    if not len(ci):
        return m, meets

    # pairs with cuts: every piece between them
    cut = np.zeros(len(seg) * n_parts, dtype=bool)
    cut[ci * n_parts + cp] = True
    key = np.flatnonzero(cut)
    pair, gt = np.concatenate([key, ci * n_parts + cp]), np.concatenate([lo[key // n_parts], ct])
    order = np.lexsort((gt, pair))
    pair, gt = pair[order], gt[order]
    gi, gp = pair // n_parts, pair % n_parts
    same = np.zeros(len(gi), dtype=bool)
    same[:-1] = pair[1:] == pair[:-1]
    end = hi[gi]
    end[:-1] = np.where(same[:-1], gt[1:], end[:-1])
    some = end > gt
    gi, gp, gt, end = gi[some], gp[some], gt[some], end[some]
    mid = (gt + end) / 2
    mx, my = x1[gi] + (x2 - x1)[gi] * mid, y1[gi] + (y2 - y1)[gi] * mid
    many = size[gp]
    piece = np.repeat(np.arange(len(gi)), many)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[gp], many)
    crossed = _right(mx[piece], my[piece], ax[at], ay[at], bx[at], by[at])
    held = np.bincount(piece[crossed], minlength=len(gi)) % 2 == 1
    gi, go, gt, end = gi[held], op[gp[held]], gt[held], end[held]
    meets[gi, go] = True
    if union:
        # pieces of one operator over each other: where at least one is open
        rest = ~((wholly + cover > 0)[gi, go])
        gi, go, gt, end = gi[rest], go[rest], gt[rest], end[rest]
        k = np.tile(gi * n_ops + go, 2)
        t, d = np.concatenate([gt, end]), np.repeat([1, -1], len(gi))
        order = np.lexsort((-d, t, k))
        k, t, d = k[order], t[order], d[order]
        gain = np.where(np.cumsum(d)[:-1] > 0, np.diff(t), 0.0) if len(k) else np.zeros(0)
        add = np.bincount(k[:-1], weights=gain, minlength=len(seg) * n_ops) if len(k) else np.zeros(len(seg) * n_ops)
    else:
        add = np.bincount(gi * n_ops + go, weights=end - gt, minlength=len(seg) * n_ops)
    return m + add.reshape(len(seg), n_ops) * length[:, None], meets
