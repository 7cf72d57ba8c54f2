"""Coverage queries: simplified coverage, route coverage, merged routes,
operators at a point, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.functions import expr as E
from covgrid.operators import geometry as G
from covgrid.operators import lengths as L
from covgrid.operators import points as P
from covgrid.operators import spatial as S
from covgrid.operators.predicates import check_range
from covgrid.session import materialize

SIMPLIFY_TOLERANCE = 5000.0  # metres, analysis and per-operator export
TILE_TOLERANCE = 750.0       # metres, map tile export
BOX = ["bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax"]


def simplified_coverage(coverage: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE,
                        quarter: str | None = None) -> DataFrame:
    """stg_coverage_simplified: every coverage row with its geometry
    simplified (Douglas-Peucker per ring) and the bounding box of the
    *unsimplified* geometry.  Rows whose geometry collapses are kept with
    empty rings, so the row count is preserved."""
    cov = coverage.filter(F.col("quarter") == quarter) if quarter else coverage
    boxed = cov.select("id", "quarter", "operator_code", "technology", "rings", *G.geometry_bbox("rings"))
    return G.simplify_geometries(boxed, tolerance)


def coverage_near(coverage: DataFrame, vertices: DataFrame) -> DataFrame:
    """Coverage rows whose box meets the extent of the line vertices.  Stored
    box columns are used where there are some, so the filter reaches the scan;
    a row outside holds no part of any of these lines."""
    extent = vertices.agg(F.struct(F.min("x").alias("xmin"), F.min("y").alias("ymin"),
                                   F.max("x").alias("xmax"), F.max("y").alias("ymax")).alias("box")).scalar()
    stored = set(BOX) <= set(coverage.columns)
    xmin, ymin, xmax, ymax = [F.col(n) for n in BOX] if stored else G.geometry_bbox("rings")
    return coverage.filter((xmin <= extent["xmax"]) & (xmax >= extent["xmin"])
                           & (ymin <= extent["ymax"]) & (ymax >= extent["ymin"]))


def simplified_summary(stg: DataFrame) -> DataFrame:
    """Per simplified geometry: bbox and the number of points kept."""
    n = F.aggregate(F.transform("rings", lambda r: F.size(r["pts"])), F.lit(0), lambda a, b: a + b)
    return stg.select("id", "operator_code", "technology", "bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax",
                      n.alias("n_points"))


def simplified_points(shapes: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """The vertices that simplification keeps: one row per geometry, part, ring and
    place in the simplified ring."""
    r = G.rings(G.simplify_geometries(shapes, tolerance))
    p = r.select("id", "part", "ring", F.posexplode("pts").alias("idx", "p"))
    return p.select("id", "part", "ring", F.col("idx").cast("long").alias("idx"), "p.x", "p.y")


def route_coverage(vertices: DataFrame, lines: DataFrame, stg: DataFrame, operators: DataFrame,
                   technology: str = "4G", line_ids: list[str] | None = None, buffer_km: float = 2.0,
                   cell: float = 10_000.0, inside: str = "ray", union: bool = False,
                   grid: DataFrame | str | None = "count") -> DataFrame:
    """Covered km and percent of each railway line per operator.

    Sums over overlapping polygons and quarters, then caps at the line
    length; with ``union`` a stretch that several polygons cover counts once; operators with no intersecting polygon are absent; touching
    only gives a 0.0 row.  ``technology='all'`` takes every technology's polygons.  ``buffer_km`` only widens the reference's box
    prefilter, which cannot change the result (the line itself is
    intersected), so it is validated and otherwise unused.  ``grid``: see
    ``spatial.covered_length``; ``stored_grid`` gives one.  With ``inside="ray"`` lengths are
    summed leaf by leaf (``lengths.operator_lengths``), else pair by pair.
    """
    check_range("buffer_km", buffer_km, 0.1, 10)
    if line_ids:
        vertices, lines = (df.filter(F.col("line_id").isin(line_ids)) for df in (vertices, lines))
    segs = G.segments(vertices, "merge").join(G.pick_features(lines), ["line_id", "feature"], "left_semi")
    polys = G.rings(stg if technology == "all" else stg.filter(F.col("technology") == technology), "operator_code")
    if inside == "ray":
        pairs = L.operator_lengths(segs, polys, cell=cell, union=union, grid=grid)
    else:
        pairs = S.covered_length(segs, polys, cell=cell, inside=inside, union=union, grid=grid)
    per = (
        pairs.join(lines.select("feature", "line_id", "length_km"), "feature")
        .groupBy("line_id", "operator_code")
        .agg(F.sum(F.col("inside_m") / 1000.0).alias("_cov"), F.max("length_km").alias("total_length_km"))
    )
    names = operators.select(F.col("code").alias("operator_code"), F.col("name").alias("operator_name"))
    tot = F.col("total_length_km")
    return (
        per.join(names, "operator_code", "left")
        .select("line_id", F.col("operator_code").alias("operator"), "operator_name", "total_length_km",
                E.round_half(F.least(F.col("_cov"), tot), 1).alias("covered_length_km"),
                E.round_half(F.least(F.col("_cov") / F.when(tot != 0, tot) * 100.0, F.lit(100.0)), 1)
                .alias("coverage_pct"))
    )


def stored_grid(vertices: DataFrame, stg: DataFrame, cell: float = 10_000.0) -> DataFrame | None:
    """The dense cells of the lines and the simplified coverage as a stored table, to be
    kept beside the stage; None where no cell is dense.  Lines longer than ``cell``
    are counted by the pieces they are cut into."""
    segs = G.split_segments(G.segments(vertices, "merge"), cell)
    found = materialize(S.dense_cells(S.meeting_places(segs, G.rings(stg)), 4 * cell), "grid")
    return None if found.isEmpty() else found


def route_contract_checks(route_rows: DataFrame) -> DataFrame:
    """Result-contract violations of route coverage rows: percent outside
    0..100, negative lengths, more covered than the line is long (beyond the
    rounding to 0.1 km), missing line or operator."""
    c = F.col
    return route_rows.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count(F.when((c("coverage_pct") < 0) | (c("coverage_pct") > 100), 1)).alias("pct_out_of_range"),
        F.count(F.when((c("covered_length_km") < 0) | (c("total_length_km") < 0), 1)).alias("negative_length"),
        F.count(F.when(c("covered_length_km") > c("total_length_km") + 0.1, 1)).alias("covered_over_total"),
        F.count(F.when(c("line_id").isNull() | c("operator").isNull(), 1)).alias("missing_required"),
    )


def merged_route_coverage(route_rows: DataFrame) -> DataFrame:
    """Merge the per-line results of a multi-line route per operator:
    sums of the rounded covered km and of the line totals, percent of the
    sums (1 dp); totals of lines an operator does not appear on are not
    counted for it."""
    g = route_rows.groupBy("operator").agg(F.first("operator_name").alias("operator_name"),
                                           F.sum("covered_length_km").alias("_c"),
                                           F.sum("total_length_km").alias("_t"))
    t = F.when(F.col("_t") != 0, F.col("_t")).otherwise(F.lit(1.0))
    return g.select("operator", "operator_name",
                    E.round_half("_t", 1).alias("total_length_km"),
                    E.round_half("_c", 1).alias("covered_length_km"),
                    (E.round_half(F.col("_c") / t * 1000.0, 0) / 10.0).alias("coverage_pct")
                    ).orderBy(F.desc("coverage_pct"), "operator")


def operators_at_point(coverage: DataFrame, latitude: float, longitude: float,
                       technology: str | None = "4G", band: float = 10_000.0) -> DataFrame:
    """Operators whose coverage polygons contain a point (odd-even rule on
    the edges of the point's y band; the ray runs to +x).  Stored box columns
    (``sinks.write_clustered_coverage``) are used where there are some: the filter
    then reaches the scan, and Parquet statistics skip what lies elsewhere."""
    cov = coverage.filter(F.col("technology") == technology) if technology else coverage
    x, y = E.lambert_xy(f"{float(longitude)!r}D", f"{float(latitude)!r}D")
    # Only geometries whose box holds the point are exploded to edges.
    stored = set(BOX) <= set(coverage.columns)
    x0, y0, x1, y1 = [F.col(n) for n in BOX] if stored else G.geometry_bbox("rings")
    cov = cov.filter((x0 <= x) & (x1 >= x) & (y0 <= y) & (y1 >= y))
    edg = G.edges(G.rings(cov, "operator_code", "technology"))
    c = F.col
    pt = edg.select("*", x.alias("px"), y.alias("py"))
    pt = pt.filter((E.cell(F.least("ay", "by"), band) <= E.cell("py", band))
                   & (E.cell(F.greatest("ay", "by"), band) >= E.cell("py", band)))
    cross = (((c("ay") > c("py")) != (c("by") > c("py")))
             & (c("px") < c("ax") + S._div((c("py") - c("ay")) * (c("bx") - c("ax")), c("by") - c("ay"))))
    inside = (pt.filter(cross).groupBy("id", "part", "operator_code", "technology").count()
              .filter(c("count") % 2 == 1))
    return inside.select(F.col("operator_code").alias("operator"), "technology").distinct()


def site_coverage(sites: DataFrame, coverage: DataFrame, cell: float = P.CELL) -> DataFrame:
    """For every site the operators whose coverage of the site's technology holds
    it: their number, their codes in order, and whether the site's own is among
    them.  All sites are joined at once (``points.operators_of_points``)."""
    x, y = E.lambert_xy("longitude", "latitude")
    at = sites.select(F.col("id").alias("point_id"), "technology", x.alias("x"), y.alias("y"))
    hits = P.operators_of_points(at, G.rings(coverage, "operator_code", "technology"), ["technology"], cell)
    # at most one entry per operator and site
    found = hits.groupBy(F.col("point_id").alias("id")).agg(F.array_sort(F.collect_set("operator_code")).alias("_ops"))
    ops = F.coalesce("_ops", F.array().cast("array<string>"))
    return (sites.select("id", "operator", "technology").join(found.hint("merge"), "id", "left")
            .select("id", "operator", "technology", F.size(ops).cast("long").alias("n_operators"),
                    F.array_join(ops, ",").alias("operators"),
                    F.coalesce(F.array_contains(ops, F.col("operator")), F.lit(False)).alias("own_operator")))


def coverage_features(stg: DataFrame, operators: DataFrame, technology: str = "4G",
                      operator_code: str | None = None) -> DataFrame:
    """GeoJSON features of simplified coverage in degrees: one row per
    geometry that is not empty, properties operator, operator_name (code
    when unknown), technology, quarter; ``technology='all'`` keeps every
    technology.  Coordinates are written with 7 fixed decimals."""
    s = stg if technology == "all" else stg.filter(F.col("technology") == technology)
    if operator_code:
        s = s.filter(F.col("operator_code") == operator_code)
    s = s.filter(F.size("rings") > 0)

    def pt_text(p):
        lon, lat = E.lambert_lonlat(p["x"], p["y"])
        return F.concat(F.lit("["), F.format_string("%.7f", E.round_half(lon, 7)), F.lit(","),
                        F.format_string("%.7f", E.round_half(lat, 7)), F.lit("]"))

    ring_text = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r["pts"], pt_text), ","), F.lit("]"))
    parts = F.array_sort(F.array_distinct(F.transform("rings", lambda r: r["part"])))
    poly_text = F.transform(parts, lambda p: F.concat(
        F.lit("["), F.array_join(F.transform(F.filter("rings", lambda r: r["part"] == p), ring_text), ","),
        F.lit("]")))
    geom = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.array_join(poly_text, ","), F.lit("]}"))
    names = operators.select(F.col("code").alias("operator_code"), F.col("name").alias("_n"))
    props = F.to_json(F.struct(F.col("operator_code").alias("operator"),
                               F.coalesce("_n", "operator_code").alias("operator_name"), "technology", "quarter"))
    return (s.join(names, "operator_code", "left")
            .select("id", F.col("operator_code").alias("operator"), "technology", "quarter",
                    F.concat(F.lit('{"type":"Feature","geometry":'), geom, F.lit(',"properties":'), props,
                             F.lit("}")).alias("feature")))


def ranked_route_coverage(route_rows: DataFrame) -> DataFrame:
    """Route coverage with each operator's rank on its line (best first;
    ties on the operator code)."""
    from pyspark.sql import Window
    w = Window.partitionBy("line_id").orderBy(F.desc_nulls_last("coverage_pct"), "operator")
    return route_rows.withColumn("rank", F.row_number().over(w))
