"""Antenna-site queries: counts, lists, nearby search, exports, tiles.

Each function takes the sites DataFrame (raw_antenna_sites shape) plus
parameters and returns a lazy DataFrame.  Filters are plain column
predicates so Catalyst pushes them into the Parquet scan; counts are
``groupBy().count()`` so they aggregate map-side before the shuffle; top-k
queries are ``orderBy().limit()`` which plans as ``TakeOrderedAndProject``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covgrid import schema
from covgrid.functions import expr as E
from covgrid.operators.predicates import all_of, check_range


def antenna_stats(sites: DataFrame, operator: str | None = None) -> DataFrame:
    """Site count by operator and technology (optional operator filter)."""
    return (
        sites.filter(all_of(operator=operator))
        .groupBy("operator", "technology").agg(F.count(F.lit(1)).alias("site_count"))
        .orderBy(F.asc_nulls_last("operator"), F.asc_nulls_last("technology"))
    )


def antenna_list(sites: DataFrame, operator: str | None = None, technology: str | None = None,
                 commune_code: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of sites ordered by operator, technology, id."""
    check_range("limit", limit, 1, 1000)
    check_range("offset", offset, 0, None)
    page = (
        sites.filter(all_of(operator=operator, technology=technology, commune_code=commune_code))
        .select("id", "operator", "latitude", "longitude", "commune_code", "technology")
        .orderBy(F.asc_nulls_last("operator"), F.asc_nulls_last("technology"), F.asc_nulls_last("id"))
    )
    return (page.offset(offset) if offset else page).limit(limit)


def nearby_antennas(sites: DataFrame, latitude: float, longitude: float, radius_km: float = 2.0,
                    technology: str | None = None, limit: int | None = 50, strict: bool = True) -> DataFrame:
    """Sites within a radius of a point, nearest first (all of them without a
    ``limit``).

    The degree box that prunes the scan is widened east-west by 1/cos(lat)
    and rows beyond the radius are dropped.  With ``strict=False`` the box is
    a plain degree square and nothing else is dropped.  Ties on the rounded
    distance break on id.
    """
    check_range("radius_km", radius_km, 0.1)
    if limit is not None:
        check_range("limit", limit, 1)
    delta = radius_km / E.KM_PER_DEGREE
    dlon = delta / math.cos(math.radians(latitude)) if strict else delta
    dist = E.planar_km("latitude", "longitude", latitude, longitude)
    out = sites.filter(
        F.col("latitude").between(latitude - delta, latitude + delta)
        & F.col("longitude").between(longitude - dlon, longitude + dlon)
        & all_of(technology=technology)
    ).withColumn("_d", dist)
    if strict:
        out = out.filter(F.col("_d") <= radius_km)
    out = out.select("id", "operator", "technology", "latitude", "longitude", "commune_code",
                     "department_code", E.round_half("_d", 2).alias("distance_km"))
    return out if limit is None else out.orderBy("distance_km", "id").limit(limit)


def nearby_breakdown(sites: DataFrame, latitude: float, longitude: float,
                     radius_km: float = 2.0, limit: int | None = None) -> DataFrame:
    """Counts by operator and by technology over all sites in range (over the
    ``limit`` nearest ones if given)."""
    near = nearby_antennas(sites, latitude, longitude, radius_km, None, limit)
    by_op = near.groupBy(F.col("operator").alias("value")).count().withColumn("dimension", F.lit("operator"))
    by_tech = near.groupBy(F.col("technology").alias("value")).count().withColumn("dimension", F.lit("technology"))
    return by_op.unionByName(by_tech).select("dimension", "value", F.col("count").alias("n"))


def department_stats(sites: DataFrame, department_code: str) -> DataFrame:
    return (
        sites.filter(F.col("department_code") == department_code)
        .groupBy("operator", "technology").agg(F.count(F.lit(1)).alias("site_count"))
        .orderBy("operator", "technology")
    )


def commune_summary(sites: DataFrame, commune_code: str) -> DataFrame:
    """Per (operator, technology): count and mean position (5 dp), with the
    commune total and centre (unweighted mean of the rounded group means,
    summed in operator/technology order).  An unknown commune gives one row
    of count and total 0 without operator, technology or centre."""
    groups = (
        sites.filter(F.col("commune_code") == commune_code)
        .groupBy("commune_code", "operator", "technology")
        .agg(F.count(F.lit(1)).alias("count"),
             E.round_half(E.mean_exact("latitude"), 5).alias("avg_lat"),
             E.round_half(E.mean_exact("longitude"), 5).alias("avg_lon"))
    )
    n = F.nullif(F.size("_g"), F.lit(0))
    # The group count per commune is bounded by operators x technologies.
    per_commune = groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total"),
        F.array_sort(F.collect_list(F.struct("operator", "technology", "avg_lat", "avg_lon"))).alias("_g"),
    ).select(
        F.lit(commune_code).alias("commune_code"), "total",
        (E.fold_sum(F.transform("_g", lambda g: g["avg_lat"])) / n).alias("center_lat"),
        (E.fold_sum(F.transform("_g", lambda g: g["avg_lon"])) / n).alias("center_lon"),
    )
    return (per_commune.join(groups, "commune_code", "left")
            .select("commune_code", "operator", "technology", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    "avg_lat", "avg_lon", "total",
                    "center_lat", "center_lon")
            .orderBy("operator", "technology"))


def departments(sites: DataFrame, dept_names: DataFrame) -> DataFrame:
    """Departments with antenna counts; name falls back to the code."""
    counts = (sites.filter(F.col("department_code").isNotNull())
              .groupBy("department_code").agg(F.count(F.lit(1)).alias("antenna_count")))
    return (
        counts.join(dept_names, "department_code", "left")
        .select(F.col("department_code").alias("code"),
                F.coalesce("department_name", "department_code").alias("name"), "antenna_count")
        .orderBy("code")
    )


def antenna_count(sites: DataFrame, commune_code: str | None = None,
                  technology: str | None = None) -> DataFrame:
    """Counts by operator/technology plus the overall total on every row."""
    grouped = (sites.filter(all_of(commune_code=commune_code, technology=technology))
               .groupBy("operator", "technology").agg(F.count(F.lit(1)).alias("cnt")))
    # Window over the grouped result only: bounded by operators x technologies.
    return grouped.withColumn("total", F.sum("cnt").over(Window.partitionBy())).orderBy("operator", "technology")


def compare_operators(sites: DataFrame, operators: DataFrame, technology: str = "4G") -> DataFrame:
    """National ranking of operators by site count, with the first-last gap."""
    counts = (
        sites.filter(F.col("technology") == technology)
        .join(operators.select(F.col("code").alias("operator"), F.col("name").alias("operator_name")),
              "operator", "left")
        .groupBy("operator", "operator_name").agg(F.count(F.lit(1)).alias("site_count"))
    )
    w_all = Window.partitionBy()
    return (
        counts.select(
            F.row_number().over(Window.orderBy(F.desc("site_count"), F.asc_nulls_last("operator"))).alias("rank"),
            "operator", F.coalesce("operator_name", "operator").alias("display_name"), "site_count",
            F.when(F.count(F.lit(1)).over(w_all) >= 2,
                   F.max("site_count").over(w_all) - F.min("site_count").over(w_all)).alias("gap"),
        ).orderBy("rank")
    )


def search_antennas(sites: DataFrame, commune_code: str, technology: str = "4G", limit: int = 20) -> DataFrame:
    """Sites of a commune for one technology, id order."""
    check_range("limit", limit, 1)
    return (sites.filter((F.col("commune_code") == commune_code) & (F.col("technology") == technology))
            .select("id", "operator", "latitude", "longitude", "technology")
            .orderBy("id").limit(limit))


def operator_tech_pivot(sites: DataFrame) -> DataFrame:
    """Operator x technology matrix of site counts; other technologies (and
    none) are counted as ``sites_other``."""
    known = F.coalesce(F.col("technology").isin(schema.TECH_CODES), F.lit(False))
    return sites.groupBy("operator").agg(
        *[F.count(F.when(F.col("technology") == t, 1)).alias(f"sites_{t.lower()}") for t in schema.TECH_CODES],
        F.count(F.when(~known, 1)).alias("sites_other")).orderBy(F.asc_nulls_last("operator"))


def technology_share(sites: DataFrame) -> DataFrame:
    """Sites per technology and share of the total in percent (1 dp)."""
    per = sites.groupBy("technology").agg(F.count(F.lit(1)).alias("site_count"))
    total = F.sum("site_count").over(Window.partitionBy())  # bounded: one row per technology
    return per.select("technology", "site_count",
                      E.round_half(F.col("site_count") / total * 100.0, 1).alias("share_pct")
                      ).orderBy(F.asc_nulls_last("technology"))


def panel_totals(sites: DataFrame, operators: list[str] | None = None) -> DataFrame:
    """One row: total sites, per technology and per operator, each with the rest
    as ``other``."""
    ops = operators or [c for c, _, _ in schema.OPERATORS]
    tech = [F.count(F.when(F.col("technology") == t, 1)).alias(f"sites_{t.lower()}") for t in schema.TECH_CODES]
    per_op = [F.count(F.when(F.col("operator") == o, 1)).alias(f"sites_{o.lower()}") for o in ops]
    rest = [F.count(F.when(~F.coalesce(F.col(c).isin(known), F.lit(False)), 1)).alias(name) for c, known, name in
            (("technology", schema.TECH_CODES, "sites_other_technology"), ("operator", ops, "sites_other_operator"))]
    return sites.agg(F.count(F.lit(1)).alias("total_sites"), *tech, *per_op, *rest)


def antenna_export(sites: DataFrame, department: str | None = None, operator: str | None = None,
                   technology: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the CSV export: all sites whose commune code begins with the
    department, or the first ``limit`` of them."""
    prefix = F.col("commune_code").startswith(department) if department else F.lit(True)
    rows = (sites.filter(prefix & all_of(operator=operator, technology=technology))
            .select("id", "operator", "latitude", "longitude", "commune_code", "technology"))
    order = [F.asc_nulls_last(c) for c in ("operator", "technology", "id")]
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def antenna_features(sites: DataFrame, operators: DataFrame) -> DataFrame:
    """Antenna GeoJSON features inside the metropolitan box (41..52 N,
    -6..10 E); operator name falls back to the code."""
    names = operators.select(F.col("code").alias("operator"), F.col("name").alias("_name"))
    return (
        sites.filter(F.col("latitude").between(41, 52) & F.col("longitude").between(-6, 10))
        .join(names, "operator", "left")
        .select("id", "operator", F.coalesce("_name", "operator").alias("operator_name"), "technology",
                F.col("commune_code").alias("commune"), "longitude", "latitude")
    )


def feature_json(df: DataFrame) -> DataFrame:
    """Point features as GeoJSON text, one per row."""
    return df.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct("operator", "operator_name", "technology", "commune").alias("properties"),
    )).alias("feature"))


def tile_clusters(sites: DataFrame, min_zoom: int = 7, max_zoom: int = 14, cluster_px: int = 50) -> DataFrame:
    """Point clusters per zoom level: Web-Mercator tile address and a
    ``cluster_px`` pixel cell inside the tile (256-px tiles); per cell the
    point count and mean position.  Same metropolitan box as the export."""
    cells_per_tile = 256.0 / cluster_px
    z = F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))).alias("zoom")
    pts = sites.filter(F.col("latitude").between(41, 52) & F.col("longitude").between(-6, 10)) \
        .select("latitude", "longitude", z)
    x, y = E.web_mercator_tile("longitude", "latitude", "zoom")
    pts = pts.select("zoom", "latitude", "longitude", x.alias("tx"), y.alias("ty"))
    return (
        pts.groupBy(
            "zoom",
            F.floor("tx").alias("tile_x"), F.floor("ty").alias("tile_y"),
            F.floor((F.col("tx") - F.floor("tx")) * cells_per_tile).alias("cell_x"),
            F.floor((F.col("ty") - F.floor("ty")) * cells_per_tile).alias("cell_y"),
        ).agg(F.count(F.lit(1)).alias("point_count"),
              E.round_half(E.mean_exact("latitude"), 5).alias("latitude"),
              E.round_half(E.mean_exact("longitude"), 5).alias("longitude"))
    )


def merged_clusters(sites: DataFrame, min_zoom: int = 7, max_zoom: int = 14, cluster_px: int = 50) -> DataFrame:
    """Point clusters per zoom level that no tile or cell border cuts.

    Points are first counted by ``cluster_px`` pixel cells of the whole map.  A cell
    whose mean place has no stronger cell's within ``cluster_px`` pixels is a seed (more
    points are stronger, then the smaller cell address); each other cell joins the
    strongest seed within that distance, or stays a cluster of its own.  Means lie in
    their cells, so only the eight neighbours of a cell can be that near: everything
    after the count is an equi-join of cells, whatever the number of points."""
    c = F.col
    z = F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))).alias("zoom")
    pts = sites.filter(c("latitude").between(41, 52) & c("longitude").between(-6, 10)).select("latitude", "longitude", z)
    x, y = E.web_mercator_tile("longitude", "latitude", "zoom")
    per_tile = F.lit(256.0 / cluster_px)
    pts = pts.select("zoom", "latitude", "longitude", (x * per_tile).alias("px"), (y * per_tile).alias("py"))
    cells = pts.groupBy("zoom", F.floor("px").alias("cx"), F.floor("py").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), E.mean_exact("px").alias("mx"), E.mean_exact("py").alias("my"),
        E.fixed_sum("latitude", 9).alias("lat"), E.fixed_sum("longitude", 9).alias("lon"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = cells.select("zoom", "cx", "cy", "n", "mx", "my", F.explode(steps).alias("s")).select(
        "zoom", (c("cx") + c("s.i")).alias("bx"), (c("cy") + c("s.j")).alias("by"), "cx", "cy", "n", "mx", "my")
    other = cells.select("zoom", c("cx").alias("bx"), c("cy").alias("by"), c("n").alias("bn"), c("mx").alias("bmx"), c("my").alias("bmy"))
    dx, dy = c("mx") - c("bmx"), c("my") - c("bmy")
    stronger = F.struct(c("bn"), -c("bx"), -c("by")) > F.struct(c("n"), -c("cx"), -c("cy"))
    pairs = near.join(other, ["zoom", "bx", "by"]).where((dx * dx + dy * dy <= 1.0) & stronger)
    weaker = pairs.select("zoom", c("cx").alias("bx"), c("cy").alias("by")).distinct()  # these are no seeds
    joined = (pairs.join(weaker, ["zoom", "bx", "by"], "left_anti").groupBy("zoom", "cx", "cy")
              .agg(F.max(F.struct("bn", (-c("bx")).alias("x"), (-c("by")).alias("y"))).alias("to")))
    owned = cells.join(joined, ["zoom", "cx", "cy"], "left").select(
        "zoom", F.coalesce(-c("to.x"), c("cx")).alias("cell_x"), F.coalesce(-c("to.y"), c("cy")).alias("cell_y"), "n", "lat", "lon")
    total = F.sum("n")
    return owned.groupBy("zoom", "cell_x", "cell_y").agg(
        F.count(F.lit(1)).alias("cells"), total.alias("point_count"),
        E.round_half(E.fixed_sum("lat", 9) / total, 5).alias("latitude"),
        E.round_half(E.fixed_sum("lon", 9) / total, 5).alias("longitude"))


def sample_sites(spark) -> DataFrame:
    """Sample seeder: 8 communes x 4 operators x 4 technologies with 3-8
    sites each on a small diagonal.  The count uses a stable formula in
    place of the reference's per-process string hash; ids run from 1."""
    rows, first_id = [], 1
    for cpos, (code, name, dept, lat, lon) in enumerate(schema.SAMPLE_COMMUNES):
        for opos, op in enumerate(schema.SAMPLE_OPERATORS):
            for tpos, tech in enumerate(schema.TECH_CODES):
                n = 3 + (cpos * 16 + opos * 4 + tpos) % 6
                rows.append((first_id, n, op, code, name, dept, tech, lat, lon))
                first_id += n
    groups = spark.createDataFrame(
        rows, "first_id long, n int, operator string, commune_code string, commune_name string, "
              "department_code string, technology string, lat double, lon double")
    g = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return g.select(
        (F.col("first_id") + F.col("i")).alias("id"), "operator",
        (F.col("lat") + F.col("i") * 0.003 - 0.01).alias("latitude"),
        (F.col("lon") + F.col("i") * 0.004 - 0.01).alias("longitude"),
        "commune_code", "commune_name", "department_code", "technology",
    )
