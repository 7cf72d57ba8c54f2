"""Railway queries: line and station search, line GeoJSON, transfers,
line segments between two points, direct routes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covgrid.functions import expr as E
from covgrid.operators import geometry as G
from covgrid.operators import points as P
from covgrid.operators import spatial as S
from covgrid.operators.predicates import check_range, like_any
from covgrid.session import materialize, ship_package

ADJACENCY_M = 500.0
#: So many pieces of segments are sent to all tasks, some 20 MB of cells.
FEW_PIECES = 60_000


def railway_lines(lines: DataFrame, search: str | None = None, limit: int = 50) -> DataFrame:
    """Lines without geometry; ``search`` matches the lower-cased name or
    the raw line id as a substring."""
    check_range("limit", limit, 1, 200)
    df = lines
    if search:
        df = df.filter(like_any("line_name", search) | F.col("line_id").like(f"%{search}%"))
    return (df.select("line_id", "line_name", E.round_half("length_km", 1).alias("length_km"))
            .orderBy(F.asc_nulls_last("line_name"), "line_id").limit(limit))


def railway_stations(stations: DataFrame, search: str | None = None, limit: int = 20) -> DataFrame:
    """One row per station name: lowest id, sorted distinct line codes,
    first commune/department, mean position (6 dp)."""
    check_range("limit", limit, 1, 100)
    df = stations.filter(like_any("station_name", search)) if search else stations
    return (
        df.groupBy("station_name").agg(
            F.min("station_id").alias("station_id"),
            F.array_join(F.array_sort(F.collect_set("line_code")), ",").alias("line_codes"),
            F.min("commune").alias("commune"), F.min("department").alias("department"),
            E.round_half(E.mean_exact("latitude"), 6).alias("latitude"),
            E.round_half(E.mean_exact("longitude"), 6).alias("longitude"))
        .select("station_id", "station_name", "line_codes", "commune", "department", "latitude", "longitude")
        .orderBy("station_name").limit(limit)
    )


def chosen_vertices(vertices: DataFrame, lines: DataFrame, line_ids: list[str] | None = None) -> DataFrame:
    chosen = G.pick_features(lines)
    if line_ids:
        chosen = chosen.filter(F.col("line_id").isin(line_ids))
    return vertices.join(chosen, ["line_id", "feature"], "left_semi")


def route_vertices(vertices: DataFrame, lines: DataFrame, line_ids: list[str] | None = None) -> DataFrame:
    """Vertices of lines in degrees (7 dp), one feature per line id, with
    the line's name and length (1 dp)."""
    v = chosen_vertices(vertices, lines, line_ids)
    lon, lat = E.lambert_lonlat("x", "y")
    return (v.join(lines.select("feature", "line_name", "length_km"), "feature")
            .select("line_id", "part", "seq", E.round_half(lon, 7).alias("lon"), E.round_half(lat, 7).alias("lat"),
                    "line_name", E.round_half("length_km", 1).alias("length_km")))


def _coord_text(lon, lat):
    """``[lon,lat]`` with 7 fixed decimals (values are already rounded to 7
    dp, so every engine prints the same digits; no exponent notation)."""
    return F.concat(F.lit("["), F.format_string("%.7f", lon), F.lit(","), F.format_string("%.7f", lat), F.lit("]"))


def route_geojson(vertices: DataFrame, lines: DataFrame, line_ids: list[str] | None = None) -> DataFrame:
    """One GeoJSON geometry per line (LineString, or MultiLineString when the
    feature has several parts), with the line's id, name and length.  A
    line's vertices are one geometry, so collecting them per line is
    bounded by that geometry."""
    rv = route_vertices(vertices, lines, line_ids)
    parts = (rv.groupBy("line_id", "line_name", "length_km", "part")
             .agg(F.array_sort(F.collect_list(F.struct("seq", _coord_text("lon", "lat").alias("c")))).alias("_p"))
             .select("line_id", "line_name", "length_km", "part",
                     F.concat(F.lit("["), F.array_join(F.transform("_p", lambda p: p["c"]), ","), F.lit("]")).alias("c")))
    g = parts.groupBy("line_id", "line_name", "length_km").agg(
        F.array_sort(F.collect_list(F.struct("part", "c"))).alias("_ps"))
    texts = F.transform("_ps", lambda p: p["c"])
    geom = F.when(F.size("_ps") == 1,
                  F.concat(F.lit('{"type":"LineString","coordinates":'), F.element_at(texts, 1), F.lit("}")))\
        .otherwise(F.concat(F.lit('{"type":"MultiLineString","coordinates":['), F.array_join(texts, ","),
                            F.lit("]}")))
    return g.select("line_id", "line_name", "length_km", geom.alias("geometry"))


# ----------------------------------------------------------------- transfers
def _pt_seg(px, py, ax, ay, bx, by):
    """Closest point on segment a-b to p and its distance."""
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    some = l2 > 0
    t = np.where(some, np.minimum(1.0, np.maximum(0.0, ((px - ax) * dx + (py - ay) * dy) / np.where(some, l2, 1.0))), 0.0)
    cx, cy = ax + t * dx, ay + t * dy
    return cx, cy, np.sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py))


CONTACT = pa.struct([("d", pa.float64()), ("k", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])


def segment_pair_contact(df: DataFrame, distance: float | None = None) -> DataFrame:
    """Rows with segment a (ax1..ay2) and segment b (bx1..by2): distance
    between the segments and the point of a closest to b.  Crossing
    segments give distance 0 at the crossing; otherwise the best of the
    four endpoint projections (ties: first in a fixed order).  With ``distance``
    only the rows that are not farther apart."""
    def run(batches):
        for b in batches:
            ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = (
                b.column(f"{s}{k}{i}").to_numpy(zero_copy_only=False) for s in "ab" for i in (1, 2) for k in "xy")
            rx, ry, sx, sy, qx, qy = ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1, bx1 - ax1, by1 - ay1
            den = rx * sy - ry * sx
            safe = np.where(den != 0, den, 1.0)
            t, u = (qx * sy - qy * sx) / safe, (qx * ry - qy * rx) / safe
            crosses = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
            # a's endpoints against b: the point on a is the endpoint itself.
            _, _, d1 = _pt_seg(ax1, ay1, bx1, by1, bx2, by2)
            _, _, d2 = _pt_seg(ax2, ay2, bx1, by1, bx2, by2)
            # b's endpoints against a: the point on a is the projection.
            p3x, p3y, d3 = _pt_seg(bx1, by1, ax1, ay1, ax2, ay2)
            p4x, p4y, d4 = _pt_seg(bx2, by2, ax1, ay1, ax2, ay2)
            d = np.stack([np.zeros(len(den)), d1, d2, d3, d4])
            x = np.stack([ax1 + t * rx, ax1, ax2, p3x, p4x])
            y = np.stack([ay1 + t * ry, ay1, ay2, p3y, p4y])
            k = np.where(crosses, 0, 1 + d[1:].argmin(axis=0)) if len(den) else np.zeros(0, np.int64)
            d, x, y = (np.take_along_axis(v, k[None], 0)[0] for v in (d, x, y))
            keep = pa.array(np.flatnonzero(d <= distance) if distance is not None else np.arange(len(d)))
            contact = pa.StructArray.from_arrays([pa.array(d), pa.array(k.astype(np.int32)), pa.array(x), pa.array(y)],
                                                 fields=list(CONTACT))
            yield pa.RecordBatch.from_arrays([*b.take(keep).columns, contact.take(keep)], names=[*b.schema.names, "contact"])

    ship_package(df.sparkSession)
    contact = T.StructType().add("d", "double").add("k", "integer").add("x", "double").add("y", "double")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("contact", contact)]))


def line_adjacency(segs_a: DataFrame, segs_b: DataFrame, distance: float = ADJACENCY_M,
                   cell: float = 10_000.0, few: bool = False) -> DataFrame:
    """(feature_a, feature_b, contact point on a, distance) for every pair
    of features within ``distance``; the contact is the closest point of a
    to b (lowest (seg a, seg b) on ties).  Grid equi-join with a's boxes
    grown by the distance.  ``few``: b holds ``FEW_PIECES`` segments at most, so its cells are sent to a's."""
    a = segs_a.select(F.col("line_id").alias("line_a"), F.col("feature").alias("fa"), F.col("seg").alias("sa"),
                      F.col("x1").alias("ax1"), F.col("y1").alias("ay1"),
                      F.col("x2").alias("ax2"), F.col("y2").alias("ay2"))
    b = segs_b.select(F.col("line_id").alias("line_b"), F.col("feature").alias("fb"), F.col("seg").alias("sb"),
                      F.col("x1").alias("bx1"), F.col("y1").alias("by1"),
                      F.col("x2").alias("bx2"), F.col("y2").alias("by2"))
    a = S._box(a, F.col("ax1"), F.col("ay1"), F.col("ax2"), F.col("ay2"), "qa")
    a = a.select("*", *[(F.col(f"qa{k}0") - distance).alias(f"g{k}0") for k in "xy"],
                 *[(F.col(f"qa{k}1") + distance).alias(f"g{k}1") for k in "xy"])
    b = S._box(b, F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"), "qb")
    ac = G.bbox_cells(a, "gx0", "gy0", "gx1", "gy1", cell)
    bc = G.bbox_cells(b, "qbx0", "qby0", "qbx1", "qby1", cell)
    pairs = (ac.join(F.broadcast(bc) if few else bc, ["cx", "cy"]).filter(S._overlap_in_ref_cell("g", "qb", cell))
             .filter(F.col("line_a") != F.col("line_b")))
    sides = [f"{s}{k}{i}" for s in "ab" for i in (1, 2) for k in "xy"]
    near = segment_pair_contact(pairs.select("line_a", "fa", "sa", "line_b", "fb", "sb", *sides), distance)
    return near.groupBy("line_a", "fa", "line_b", "fb").agg(
        F.min_by("contact", F.struct("contact.d", "sa", "sb", "contact.k")).alias("contact"))


def nearest_station_name(stations: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """Name of the station nearest a point by squared degree distance (no
    cosine factor); ties on the lowest station id."""
    d2 = ((F.col("latitude") - latitude) * (F.col("latitude") - latitude)
          + (F.col("longitude") - longitude) * (F.col("longitude") - longitude))
    return stations.agg(F.min_by("station_name", F.struct(d2, F.col("station_id"))).alias("station_name"))


def nearest_stations(places: DataFrame, stations: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` stations nearest to each place ``(id, latitude, longitude)`` in
    metres of the projection, with their rank; ties to the lowest station id."""
    x, y = E.lambert_xy("longitude", "latitude")
    found = P.nearest(places.select(F.col("id").alias("point_id"), x.alias("x"), y.alias("y")),
                      stations.select(F.col("station_id").alias("target_id"), x.alias("x"), y.alias("y")), k)
    names = stations.select(F.col("station_id").alias("target_id"), "station_name")
    return found.join(names, "target_id").select(
        F.col("point_id").alias("id"), F.col("target_id").alias("station_id"), "station_name",
        F.col("rank").cast("int").alias("rank"), E.round_half(F.col("distance") / 1000.0, 3).alias("distance_km"))


def station_places(stations: DataFrame, vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """Where each station lies along its line (one feature per line id): kilometres
    from the line's start, fraction of its length, and kilometres off it."""
    segs = G.segments(chosen_vertices(vertices, lines), "merge")
    x, y = E.lambert_xy("longitude", "latitude")
    at = stations.select(F.col("station_id").alias("point_id"), F.col("line_code").alias("line_id"),
                         x.alias("x"), y.alias("y")).join(G.pick_features(lines), "line_id")
    found = P.locate(at, segs)
    return (found.join(stations.select(F.col("station_id").alias("point_id"), "station_name", "line_code"), "point_id")
            .select(F.col("point_id").alias("station_id"), "station_name", F.col("line_code").alias("line_id"),
                    E.round_half(F.col("along_m") / 1000.0, 3).alias("along_km"),
                    E.round_half(F.col("along_m") / F.when(F.col("total_m") != 0, F.col("total_m")), 5).alias("fraction"),
                    E.round_half(F.col("distance_m") / 1000.0, 3).alias("distance_km")))


def transfers(vertices: DataFrame, lines: DataFrame, stations: DataFrame, dep_lines: list[str],
              arr_lines: list[str], dep_lat: float, dep_lon: float, arr_lat: float, arr_lon: float,
              limit: int = 5) -> DataFrame:
    """Bridge lines within 500 m of a departure line and of an arrival line,
    with the transfer station nearest the departure/bridge contact point.
    Start and end stations are dropped; one option per station, longest
    bridge first; at most ``limit`` rows."""
    spark = lines.sparkSession
    if not dep_lines or not arr_lines:
        return spark.createDataFrame([], "line_id string, line_name string, length_km double, "
                                         "transfer_station string, transfer_lat double, transfer_lon double")
    segs = G.segments(vertices, "merge")
    ends = dep_lines + arr_lines
    bridge_segs = segs.filter(~F.col("line_id").isin(ends))
    adj = line_adjacency(segs.filter(F.col("line_id").isin(ends)), bridge_segs)
    # A bridge touches a departure line and an arrival line: one pass over
    # the adjacency rows of each bridge feature (a window, not a self-join).
    near_arr = F.max(F.col("line_a").isin(arr_lines)).over(Window.partitionBy("fb"))
    bridge = (adj.withColumn("_arr", near_arr)
              .filter(F.col("_arr") & F.col("line_a").isin(dep_lines))
              .select(F.col("fb").alias("feature"), F.col("line_b").alias("line_id"),
                      F.col("fa").alias("dep_feature"), "contact")
              .join(lines.select("feature", "line_name", "length_km"), "feature"))

    # Candidate stations: on the bridge line or on any departure line.  The
    # OR becomes an exploded candidate line code and an equi-join.
    cand_line = F.explode(F.array_distinct(F.concat(F.array("line_id"), F.array(*[F.lit(x) for x in dep_lines]))))
    b = bridge.select("*", cand_line.alias("line_code"))
    sx, sy = E.lambert_xy("longitude", "latitude")
    st = stations.select("line_code", "station_id", "station_name", sx.alias("sx"), sy.alias("sy"))
    d = E.seg_len(F.col("sx"), F.col("sy"), F.col("contact.x"), F.col("contact.y"))
    nearest = (b.join(st, "line_code")
               .groupBy("feature", "dep_feature", "line_id", "line_name", "length_km")
               .agg(F.min_by("station_name", F.struct(d, F.col("station_id"))).alias("transfer_station")))

    first_by_name = stations.groupBy("station_name").agg(
        F.min_by("latitude", "station_id").alias("transfer_lat"),
        F.min_by("longitude", "station_id").alias("transfer_lon"))
    ends_names = (nearest_station_name(stations, dep_lat, dep_lon)
                  .unionByName(nearest_station_name(stations, arr_lat, arr_lon)))
    opts = (nearest.select("line_id", "line_name", E.round_half("length_km", 1).alias("length_km"),
                           "transfer_station").distinct()
            .join(ends_names.withColumnRenamed("station_name", "transfer_station"), "transfer_station", "left_anti")
            .join(first_by_name.withColumnRenamed("station_name", "transfer_station"), "transfer_station", "left"))
    w = Window.partitionBy("transfer_station").orderBy(F.desc("length_km"), "line_id")
    return (opts.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("line_id", "line_name", "length_km", "transfer_station", "transfer_lat", "transfer_lon")
            .orderBy(F.desc("length_km"), "line_id", "transfer_station").limit(limit))


def direct_route(stations: DataFrame, dep_station: str, arr_station: str) -> DataFrame:
    """Lines common to two station names (a direct route); the first common
    line in sorted order is the one taken."""
    two = stations.filter(F.col("station_name").isin(dep_station, arr_station))
    lines = lambda name: F.array_sort(F.collect_set(F.when(F.col("station_name") == name, F.col("line_code"))))
    g = two.agg(lines(dep_station).alias("dep_lines"), lines(arr_station).alias("arr_lines"))
    common = F.array_intersect("dep_lines", "arr_lines")
    return g.select(F.lit(dep_station).alias("departure"), F.lit(arr_station).alias("arrival"),
                    F.array_join(common, ",").alias("common_lines"),
                    F.element_at(common, 1).alias("direct_line"))


# ---------------------------------------------------------------- segment
def locate_fraction(segs: DataFrame, x: float | Column, y: float | Column, name: str) -> DataFrame:
    """Fraction of each feature's length at the point of the line closest
    to (x, y) (first segment on ties)."""
    return locate_fractions(segs, {name: (x, y)})


def locate_fractions(segs: DataFrame, points: dict[str, tuple]) -> DataFrame:
    """One fraction column per named point, all in one pass over the segments."""
    c = F.col
    # Running length before each segment, summed in vertex order; the
    # window holds one line feature (a bounded group).
    w = Window.partitionBy("feature").orderBy("part", "seg").rowsBetween(Window.unboundedPreceding, -1)
    s = segs.withColumn("_before", F.coalesce(F.sum("len").over(w), F.lit(0.0)))
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    l2 = dx * dx + dy * dy
    nearest = []
    for name, (x, y) in points.items():
        px = x if isinstance(x, Column) else F.lit(float(x))
        py = y if isinstance(y, Column) else F.lit(float(y))
        t = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(
            F.lit(0.0), ((px - c("x1")) * dx + (py - c("y1")) * dy) / l2))).otherwise(F.lit(0.0))
        d = E.seg_len(px, py, c("x1") + t * dx, c("y1") + t * dy)
        nearest.append(F.min_by(c("_before") + t * c("len"), F.struct(d, c("part"), c("seg"))).alias(name))
    return s.groupBy("feature").agg(*nearest, F.max(c("_before") + c("len")).alias("_total")).select(
        "feature", *[(c(name) / c("_total")).alias(name) for name in points])


def route_segment(vertices: DataFrame, lines: DataFrame, line_id: str, from_lat: float, from_lon: float,
                  to_lat: float, to_lon: float, max_points: int | None = None) -> DataFrame:
    """Sub-line between the points closest to two positions.

    Fractions of length map to *vertex indices* (truncated) over the
    flattened coordinates, both ends included; with ``max_points`` more
    points are sampled down to that many plus the last; the length is the
    rounded line length times the fraction gap.  One row per line with the coordinates."""
    vertices, lines = (df.filter(F.col("line_id") == line_id) for df in (vertices, lines))
    v = chosen_vertices(vertices, lines)
    segs = G.segments(v)
    fx, fy = E.lambert_xy(f"{float(from_lon)!r}D", f"{float(from_lat)!r}D")
    tx, ty = E.lambert_xy(f"{float(to_lon)!r}D", f"{float(to_lat)!r}D")
    fr = locate_fractions(segs, {"f1": (fx, fy), "f2": (tx, ty)})
    lon, lat = E.lambert_lonlat("x", "y")
    coords = (v.select("feature", "part", "seq", F.array(E.round_half(lon, 7), E.round_half(lat, 7)).alias("c"))
              .groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "c"))).alias("_v"))
              .select("feature", F.transform("_v", lambda p: p["c"]).alias("coords")))
    g = (coords.join(fr, "feature").join(lines.select("feature", "line_id", "line_name", "length_km"), "feature"))
    c = F.col
    n = F.size("coords")
    f_lo, f_hi = F.least("f1", "f2"), F.greatest("f1", "f2")
    start = F.greatest(F.lit(0), (f_lo * (n - 1)).cast("int"))
    end0 = F.least(n, (f_hi * (n - 1)).cast("int") + 1)
    end = F.when(end0 <= start, start + 1).otherwise(end0)
    g = g.select("*", start.alias("_s"), end.alias("_e"), f_lo.alias("_lo"), f_hi.alias("_hi"))
    sl = F.when(n > 1, F.slice("coords", c("_s") + 1, c("_e") - c("_s"))).otherwise(c("coords"))
    g = g.select("*", sl.alias("_seg"))
    out = c("_seg")
    if max_points is not None:
        m = F.size("_seg")
        step = m.cast("double") / F.lit(float(max_points))
        sampled = F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(max_points - 1)),
                        lambda j: F.element_at("_seg", (j.cast("double") * step).cast("int") + 1)),
            F.array(F.element_at("_seg", -1)))
        out = F.when(m > max_points, sampled).otherwise(out)
    km = E.round_half(E.round_half("length_km", 1) * (c("_hi") - c("_lo")), 1)
    return g.select("line_id", "line_name", km.alias("length_km"), out.alias("coordinates"))


def route_segment_points(segment: DataFrame) -> DataFrame:
    """The coordinates of a route segment as rows (idx, lon, lat)."""
    p = segment.select("line_id", "line_name", "length_km", F.posexplode("coordinates").alias("idx", "c"))
    return p.select("line_id", "line_name", "length_km", F.col("idx").cast("long").alias("idx"),
                    F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


def route_extent(stations: DataFrame, station_names: list[str], pad_lon: float = 0.5,
                 pad_lat: float = 0.3) -> DataFrame:
    """Map extent around the stations of a route: per station name the
    mean position (6 dp, as the station search returns it), then the box
    padded by 0.5 degree east-west and 0.3 north-south."""
    pos = (stations.filter(F.col("station_name").isin(station_names)).groupBy("station_name")
           .agg(E.round_half(E.mean_exact("latitude"), 6).alias("lat"),
                E.round_half(E.mean_exact("longitude"), 6).alias("lon")))
    return pos.agg((F.min("lon") - pad_lon).alias("west"), (F.min("lat") - pad_lat).alias("south"),
                   (F.max("lon") + pad_lon).alias("east"), (F.max("lat") + pad_lat).alias("north"),
                   F.count(F.lit(1)).alias("stations"))


# ------------------------------------------------------------ pairs of stations

def line_contacts(segs: DataFrame, ends: DataFrame | None = None, distance: float = ADJACENCY_M,
                  bridges: DataFrame | None = None) -> DataFrame:
    """Lines within ``distance`` of the lines ``ends(line_id)``, or of any: ``(line_a, fa,
    line_b, fb, contact)``, ``a`` an end line, ``b`` one of ``bridges(feature)`` or any, in one pass
    for all of them.  Cells are a few distances wide and segments are cut to that
    length, so a cell holds few."""
    cell = 4 * distance
    # pieces are numbered along their feature, so ties fall as between whole segments
    small = lambda s: G.split_segments(s, cell).withColumn(
        "seg", F.col("seg").cast("long") * 1_000_000 + F.col("piece"))
    own = segs if ends is None else segs.join(ends, "line_id", "left_semi")
    other, few = segs, False
    if bridges is not None:  # counted, not estimated
        other = segs.join(bridges, "feature", "left_semi")
        few = (other.agg(F.sum(F.ceil(F.col("len") / cell) + 1)).first()[0] or 0) <= FEW_PIECES
    return line_adjacency(small(own), small(other), distance, cell, few)


#: Bridges of a round, best first; the last round has all others.  So many lines or less are one round.
ROUNDS, ONE_ROUND = (32, 256, 2_048, 16_384), 1_024


def _rounds(lines: DataFrame, rounds: tuple, one_round: int) -> list[Column]:
    """Conditions on ``lines(_km, line_id)`` that deal the bridges in the order of the options, longest
    first, then by line id.  Lines equal in both are in one round."""
    key = lines.select(F.coalesce("_km", F.lit(-1.0)).alias("k"), F.coalesce("line_id", F.lit("")).alias("i")).distinct()
    # no more rows than the rounds have
    keys = key.orderBy(F.desc("k"), "i").limit(max(sum(rounds), one_round) + 1).collect()
    upto = [sum(rounds[:n + 1]) for n in range(len(rounds))] if len(keys) > one_round else []
    bounds = [keys[n - 1] for n in upto if n < len(keys)]
    k, i = F.coalesce("_km", F.lit(-1.0)), F.coalesce("line_id", F.lit(""))
    after = [(k < b.k) | ((k == b.k) & (i > b.i)) for b in bounds]
    lows, highs = [F.lit(True), *after], [*[~a for a in after], F.lit(True)]
    return [lo & hi for lo, hi in zip(lows, highs)]


def pair_transfers(pairs: DataFrame, vertices: DataFrame, lines: DataFrame, stations: DataFrame,
                   limit: int = 5, rounds: tuple = ROUNDS, one_round: int = ONE_ROUND) -> DataFrame:
    """Interchanges of each pair ``(pair_id, dep_station, arr_station)`` of station names:
    what ``transfers`` gives for one pair, for a whole table, plus ``option`` from 1.

    Options are ordered by their bridge, the longest first, so bridges are met in that
    order, in rounds: a pair with ``limit`` options after a round has them for good, as those
    of later bridges come after them.  The other pairs go on, to the last bridge if need be.  A round finds the
    contacts of its bridges with the end lines of its pairs, so contacts of all lines, whose
    number grows with the square of the lines, are never held at once.

    Every end line's contacts are found once, however many pairs it serves.  The
    interchange at a contact depends on the departure's name alone, so it is sought
    once per departure (``nearest_of_group``); pairs meet the interchanges of
    their departure, not its contacts, and pairs of equal names are one."""
    c = F.col
    codes = stations.select("station_name", c("line_code").alias("line_id")).distinct()
    names = lambda name: F.array_sort(F.collect_set(name))
    keyed = materialize(pairs.where("pair_id IS NOT NULL").groupBy("pair_id").agg(
        names("dep_station").alias("dep"), names("arr_station").alias("arr")), "pairs")
    asked = keyed.select("dep", "arr").distinct()
    side = lambda df, key, of: (df.select(*key, F.explode(of).alias("station_name")).join(codes, "station_name")
                                .select(*key, "line_id").distinct())
    dep = materialize(side(asked.select("dep").distinct(), ["dep"], "dep"), "dep")
    arr = materialize(side(asked.select("arr").distinct(), ["arr"], "arr"), "arr")
    asked = asked.join(dep, "dep", "left_semi").join(arr, "arr", "left_semi")
    lines = materialize(lines.select("feature", "line_id", "line_name", E.round_half("length_km", 1).alias("_km")), "lines")
    segs = materialize(G.segments(vertices, "merge"), "segs")
    x, y = E.lambert_xy("longitude", "latitude")
    st = stations.select(c("line_code").alias("on"), "station_id", "station_name", x.alias("sx"), y.alias("sy"))

    # the names nearest to the pair's own positions are no interchange
    ends = asked.select("dep", "arr", F.explode(F.array_union("dep", "arr")).alias("station_name"))
    at = station_positions(stations, ends.select("station_name").distinct())
    close = P.nearest(at.select(c("station_name").alias("point_id"), c("longitude").alias("x"), c("latitude").alias("y")),
                      stations.select(c("station_id").alias("target_id"), c("longitude").alias("x"),
                                      c("latitude").alias("y")), finest=0.01)
    close = close.join(stations.select(c("station_id").alias("target_id"), c("station_name").alias("name")), "target_id")
    ends = materialize(ends.join(close.select(c("point_id").alias("station_name"), "name"), "station_name")
                       .select("dep", "arr", c("name").alias("transfer_station")).distinct(), "ends")
    first = stations.groupBy(c("station_name").alias("transfer_station")).agg(
        F.min_by("latitude", "station_id").alias("transfer_lat"), F.min_by("longitude", "station_id").alias("transfer_lon"))
    one = Window.partitionBy("dep", "arr", "transfer_station").orderBy(F.desc("length_km"), "line_id")
    order = Window.partitionBy("dep", "arr").orderBy(F.desc("length_km"), "line_id", "transfer_station")

    found, left = None, asked
    for bridges in _rounds(lines, rounds, one_round):
        left = materialize(left, "left")
        if found is not None and left.isEmpty():
            break
        opts = _interchanges(left, dep, arr, segs, lines.where(bridges), st)
        opts = opts.join(ends, ["dep", "arr", "transfer_station"], "left_anti").join(first, "transfer_station")
        opts = opts if found is None else opts.unionByName(found.drop("option"))
        opts = (opts.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
                .withColumn("option", F.row_number().over(order)).where(c("option") <= limit))
        found = materialize(opts, "options")
        left = left.join(found.where(c("option") == limit), ["dep", "arr"], "left_anti")
    return keyed.join(found, ["dep", "arr"]).drop("dep", "arr")


def _interchanges(asked: DataFrame, dep: DataFrame, arr: DataFrame, segs: DataFrame, lines: DataFrame,
                  st: DataFrame) -> DataFrame:
    """Distinct ``(dep, arr, line_id, line_name, length_km, transfer_station)`` of the asked pairs by the
    bridges ``lines``; ``dep`` and ``arr`` have the line ids of each side, ``st`` the stations by line."""
    c = F.col
    own = asked.join(dep, "dep").unionByName(asked.join(arr, "arr"))
    dep, arr = (df.join(asked, key, "left_semi") for df, key in ((dep, "dep"), (arr, "arr")))
    adj = line_contacts(segs, dep.select("line_id").union(arr.select("line_id")).distinct(),
                        bridges=lines.select("feature").distinct())
    touch = materialize(adj.select(c("line_a").alias("line_id"), "fa", c("line_b").alias("bridge"), c("fb").alias("feature"),
                                   c("contact.x").alias("x"), c("contact.y").alias("y")), "contacts")
    from_dep = touch.join(dep, "line_id").select("dep", "bridge", "feature", "fa", "x", "y")
    to_arr = touch.join(arr, "line_id").select("arr", "feature").distinct()

    # the station nearest to the contact, on the bridge or on any departure line
    d = E.seg_len("sx", "sy", "x", "y")
    on_bridge = (touch.join(dep.select("line_id").distinct(), "line_id", "left_semi")
                 .select("feature", "bridge", "fa", "x", "y").distinct().join(st, c("bridge") == c("on"))
                 .groupBy("feature", "fa").agg(F.min(F.struct(d.alias("d"), "station_id", "station_name")).alias("best")))
    on_dep = nearest_of_group(from_dep, dep.join(st, c("line_id") == c("on")).select(
        "dep", "station_id", "station_name", "sx", "sy").distinct(), "dep")
    near = (on_dep.join(on_bridge, ["feature", "fa"], "left")
            .select("dep", "bridge", "feature", F.least("near", "best")["station_name"].alias("transfer_station")).distinct())
    near = near.join(lines, "feature")
    return (asked.join(near, "dep").join(to_arr, ["arr", "feature"], "left_semi")
            .join(own.withColumnRenamed("line_id", "bridge"), ["dep", "arr", "bridge"], "left_anti")
            .select("dep", "arr", "line_id", "line_name", c("_km").alias("length_km"), "transfer_station").distinct())


def nearest_of_group(points: DataFrame, stations: DataFrame, group: str, block: int = 50_000) -> DataFrame:
    """``points`` with ``near`` (d, station_id, station_name), the nearest of the
    ``stations(group, station_id, station_name, sx, sy)`` of the point's ``group``, ties to the
    smaller id and name.  A group's points are dealt in blocks, each met by all its
    stations, so no compared pair is a row and no task holds a group."""
    many = points.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("_n"))
    dealt = points.join(many, group).withColumn("_block", F.pmod(F.xxhash64("feature", "fa"), F.col("_n"))).drop("_n")
    there = (stations.withColumnRenamed(group, "_group").join(many.withColumnRenamed(group, "_group"), "_group")
             .select("_group", "station_id", "station_name", "sx", "sy",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_at")))
    ship_package(points.sparkSession)
    kept = [k for k in points.columns if k not in ("x", "y")]
    schema = T.StructType([*[points.schema[k] for k in kept], T.StructField("near", T.StructType([
        T.StructField("d", T.DoubleType()), stations.schema["station_id"], stations.schema["station_name"]]))])

    def run(left, right):
        right = right.sort_by([("station_id", "ascending"), ("station_name", "ascending")])
        x, y, sx, sy = (t.column(k).to_numpy() for t, k in ((left, "x"), (left, "y"), (right, "sx"), (right, "sy")))
        at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = max(1, 1_000_000 // max(1, len(sx)))
        for i in range(0, len(x) if len(sx) else 0, step):
            dx, dy = x[i:i + step, None] - sx, y[i:i + step, None] - sy
            far = np.sqrt(dx * dx + dy * dy)
            at[i:i + step] = far.argmin(axis=1)
            d[i:i + step] = far[np.arange(len(far)), at[i:i + step]]
        out = left.slice(0, len(x) if len(sx) else 0).select(kept).combine_chunks()
        place = pa.array(at[:len(out)])
        near = pa.StructArray.from_arrays(
            [pa.array(d[:len(out)]), *[right.column(k).take(place).combine_chunks() for k in ("station_id", "station_name")]],
            ["d", "station_id", "station_name"])
        return out.append_column("near", near)

    return (dealt.groupBy(group, "_block").cogroup(there.groupBy("_group", "_at")).applyInArrow(run, schema))


def station_positions(stations: DataFrame, names: DataFrame) -> DataFrame:
    """Mean position (6 dp) of the stations of each name, as the station search gives it."""
    return (stations.join(names, "station_name", "left_semi").groupBy("station_name")
            .agg(E.round_half(E.mean_exact("latitude"), 6).alias("latitude"),
                 E.round_half(E.mean_exact("longitude"), 6).alias("longitude")))


def routes(pairs: DataFrame, vertices: DataFrame, lines: DataFrame, stations: DataFrame, limit: int = 5,
           rounds: tuple = ROUNDS, one_round: int = ONE_ROUND) -> DataFrame:
    """How to get from one station to another, for a table of pairs ``(pair_id,
    dep_station, arr_station)``: ``direct`` rows name the first common line; a pair
    without one gets its ``transfer`` rows instead; a pair with neither, or with an
    unknown station, gets one ``none`` row.  The pairs that have a direct
    route are taken out by an anti-join before any contact is sought.  Lines are sought once for pairs of
    equal names.  ``rounds``: see ``pair_transfers``."""
    c = F.col
    # stored, so that joins know their size
    stations = materialize(stations.select("station_id", "station_name", "line_code", "latitude", "longitude"), "stations")
    codes = stations.select("station_name", "line_code").distinct()
    dep = pairs.select("dep_station", "arr_station").distinct().join(
        codes.withColumnRenamed("station_name", "dep_station"), "dep_station")
    both = dep.join(codes.withColumnRenamed("station_name", "arr_station"), ["arr_station", "line_code"])
    common = both.groupBy("dep_station", "arr_station").agg(F.min("line_code").alias("line_id"))
    direct = pairs.join(common, ["dep_station", "arr_station"]).groupBy("pair_id").agg(F.min("line_id").alias("line_id"))
    names = lines.groupBy("line_id").agg(F.max_by(F.struct("line_name", "length_km"), F.struct(
        c("length_km"), -c("feature"))).alias("l"))
    found = direct.join(names, "line_id", "left").select(
        "pair_id", F.lit("direct").alias("kind"), F.lit(1).alias("option"), "line_id", "l.line_name",
        E.round_half("l.length_km", 1).alias("length_km"), F.lit(None).cast("string").alias("transfer_station"),
        F.lit(None).cast("double").alias("transfer_lat"), F.lit(None).cast("double").alias("transfer_lon"))
    rest = pairs.join(direct, "pair_id", "left_anti")
    changes = pair_transfers(rest, vertices, lines, stations, limit, rounds, one_round).withColumn("kind", F.lit("transfer"))
    out = found.unionByName(changes.select(found.columns))
    return pairs.join(out, "pair_id", "left").withColumn("kind", F.coalesce("kind", F.lit("none")))
