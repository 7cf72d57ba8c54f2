"""Registered queries: key -> Spark job over a scale-factor directory, and
key -> equivalent SQL for the oracle database.

Parameters are fixed per key so both sides compute the same thing; every
job reads the driver's tables (through the derivations in
``sources.fixtures``) so its work grows with the scale factor.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covgrid import schema
from covgrid.functions import expr as E
from covgrid.functions.expr import sql_fixed_sum, sql_mean_exact, sql_planar_km, sql_round_half as R
from covgrid.plans import antennas as A
from covgrid.plans import mart as M
from covgrid.plans import report as RP
from covgrid.sources import fixtures as FX
from covgrid.sources.fixtures import oracle_with as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


@lru_cache(maxsize=16)
def _tables(spark, sf_dir: str) -> FX.Tables:
    return FX.load(spark, sf_dir)


def _t(spark, sf_dir) -> FX.Tables:
    """Derived tables of a directory, shared by the queries of one session
    (lazy DataFrames: sharing them only saves re-reading file metadata)."""
    return _tables(spark, sf_dir)


OPS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{n}', '{col}')" for c, n, col in schema.OPERATORS) + ") AS t(code, name, color))"
DEPTS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(c, n.replace("'", "''")) for c, n in schema.DEPARTMENT_NAMES
) + ") AS t(department_code, department_name))"

# ---------------------------------------------------------------- antennas
register("antenna_stats", W("sites") + """
SELECT operator, technology, COUNT(*) AS site_count FROM sites GROUP BY operator, technology""")(
    lambda s, d: A.antenna_stats(_t(s, d).sites))

register("antenna_list", W("sites") + """
SELECT id, operator, latitude, longitude, commune_code, technology FROM sites
WHERE operator = 'OF' AND technology = '4G' ORDER BY operator, technology, id LIMIT 100 OFFSET 20""")(
    lambda s, d: A.antenna_list(_t(s, d).sites, "OF", "4G", None, 100, 20))

register("nearby_antennas", W("sites") + f"""
SELECT id, operator, technology, latitude, longitude, commune_code, department_code,
       {R(sql_planar_km('latitude', 'longitude', 46.5, 2.5), 2)} AS distance_km
FROM sites WHERE {sql_planar_km('latitude', 'longitude', 46.5, 2.5)} <= 50.0
ORDER BY distance_km, id LIMIT 200""")(
    lambda s, d: A.nearby_antennas(_t(s, d).sites, 46.5, 2.5, 50.0, None, 200))

_P = (49.919, 2.841)
register("nearby_breakdown", W("sites") + f"""
, near AS (
  SELECT id, operator, technology, {R(sql_planar_km('latitude', 'longitude', *_P), 2)} AS distance_km
  FROM sites WHERE {sql_planar_km('latitude', 'longitude', *_P)} <= 2.0)
SELECT 'operator' AS dimension, operator AS value, COUNT(*) AS n FROM near GROUP BY operator
UNION ALL SELECT 'technology', technology, COUNT(*) FROM near GROUP BY technology""")(
    lambda s, d: A.nearby_breakdown(_t(s, d).sites, *_P, 2.0))

register("department_stats", W("sites") + """
SELECT operator, technology, COUNT(*) AS site_count FROM sites WHERE department_code = '31'
GROUP BY operator, technology""")(
    lambda s, d: A.department_stats(_t(s, d).sites, "31"))

def _commune_summary_sql(code: str) -> str:
    return W("sites") + f"""
, g AS (SELECT commune_code, operator, technology, COUNT(*) AS count,
               {R(sql_mean_exact('latitude'), 5)} AS avg_lat, {R(sql_mean_exact('longitude'), 5)} AS avg_lon
        FROM sites WHERE commune_code = '{code}' GROUP BY commune_code, operator, technology),
c AS (SELECT '{code}' AS commune_code, coalesce(SUM(count), 0) AS total,
             list_reduce(list(avg_lat ORDER BY operator, technology), lambda a, b: a + b) / COUNT(*) AS center_lat,
             list_reduce(list(avg_lon ORDER BY operator, technology), lambda a, b: a + b) / COUNT(*) AS center_lon
      FROM g)
SELECT commune_code, operator, technology, coalesce(count, 0) AS count, avg_lat, avg_lon,
       CAST(total AS BIGINT) AS total, center_lat, center_lon FROM c LEFT JOIN g USING (commune_code)"""


for _key, _code in (("commune_summary", "31003"), ("commune_summary_unknown", "99999")):
    register(_key, _commune_summary_sql(_code))(lambda s, d, code=_code: A.commune_summary(_t(s, d).sites, code))

register("departments", W("sites") + f"""
SELECT s.department_code AS code, coalesce(n.department_name, s.department_code) AS name, s.antenna_count
FROM (SELECT department_code, COUNT(*) AS antenna_count FROM sites WHERE department_code IS NOT NULL
      GROUP BY department_code) s LEFT JOIN {DEPTS_SQL} n USING (department_code)""")(
    lambda s, d: A.departments(_t(s, d).sites, schema.ref_departments(s)))

register("antenna_count", W("sites") + """
SELECT operator, technology, COUNT(*) AS cnt, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total
FROM sites WHERE technology = '4G' GROUP BY operator, technology""")(
    lambda s, d: A.antenna_count(_t(s, d).sites, None, "4G"))

register("compare_operators", W("sites") + f"""
, c AS (SELECT a.operator, o.name AS operator_name, COUNT(*) AS site_count
        FROM sites a LEFT JOIN {OPS_SQL} o ON a.operator = o.code WHERE a.technology = '4G'
        GROUP BY a.operator, o.name)
SELECT CAST(row_number() OVER (ORDER BY site_count DESC, operator) AS INTEGER) AS rank, operator,
       coalesce(operator_name, operator) AS display_name, site_count,
       CASE WHEN COUNT(*) OVER () >= 2 THEN MAX(site_count) OVER () - MIN(site_count) OVER () END AS gap
FROM c""")(
    lambda s, d: A.compare_operators(_t(s, d).sites, schema.ref_operators(s), "4G"))

register("search_antennas", W("sites") + """
SELECT id, operator, latitude, longitude, technology FROM sites
WHERE commune_code = '31003' AND technology = '4G' ORDER BY id LIMIT 20""")(
    lambda s, d: A.search_antennas(_t(s, d).sites, "31003", "4G", 20))

register("operator_tech_pivot", W("sites") + """
SELECT operator, COUNT(*) FILTER (WHERE technology = '2G') AS sites_2g,
       COUNT(*) FILTER (WHERE technology = '3G') AS sites_3g,
       COUNT(*) FILTER (WHERE technology = '4G') AS sites_4g,
       COUNT(*) FILTER (WHERE technology = '5G') AS sites_5g,
       COUNT(*) FILTER (WHERE coalesce(technology NOT IN ('2G', '3G', '4G', '5G'), true)) AS sites_other
FROM sites GROUP BY operator""")(
    lambda s, d: A.operator_tech_pivot(_t(s, d).sites))

register("technology_share", W("sites") + f"""
SELECT technology, COUNT(*) AS site_count,
       {R('COUNT(*) / SUM(COUNT(*)) OVER () * 100.0', 1)} AS share_pct
FROM sites GROUP BY technology""")(
    lambda s, d: A.technology_share(_t(s, d).sites))

register("panel_totals", W("sites") + """
SELECT COUNT(*) AS total_sites,
       COUNT(*) FILTER (WHERE technology = '2G') AS sites_2g, COUNT(*) FILTER (WHERE technology = '3G') AS sites_3g,
       COUNT(*) FILTER (WHERE technology = '4G') AS sites_4g, COUNT(*) FILTER (WHERE technology = '5G') AS sites_5g,
       COUNT(*) FILTER (WHERE operator = 'BYT') AS sites_byt, COUNT(*) FILTER (WHERE operator = 'FREE') AS sites_free,
       COUNT(*) FILTER (WHERE operator = 'OF') AS sites_of, COUNT(*) FILTER (WHERE operator = 'SFR') AS sites_sfr,
       COUNT(*) FILTER (WHERE coalesce(technology NOT IN ('2G', '3G', '4G', '5G'), true)) AS sites_other_technology,
       COUNT(*) FILTER (WHERE coalesce(operator NOT IN ('BYT', 'FREE', 'OF', 'SFR'), true)) AS sites_other_operator
FROM sites""")(
    lambda s, d: A.panel_totals(_t(s, d).sites))

register("antenna_export", W("sites") + """
SELECT id, operator, latitude, longitude, commune_code, technology FROM sites
WHERE operator = 'OF' AND starts_with(commune_code, '13')""")(
    lambda s, d: A.antenna_export(_t(s, d).sites, "13", "OF", None))

register("antenna_geojson", W("sites") + f"""
SELECT id, operator, coalesce(o.name, operator) AS operator_name, technology, commune_code AS commune,
       longitude, latitude
FROM sites LEFT JOIN {OPS_SQL} o ON sites.operator = o.code
WHERE latitude BETWEEN 41 AND 52 AND longitude BETWEEN -6 AND 10""")(
    lambda s, d: A.antenna_features(_t(s, d).sites, schema.ref_operators(s)))

_TILE_X = "((longitude + 180.0) / 360.0 * pow(2.0, CAST(zoom AS DOUBLE)))"
_TILE_Y = ("((1.0 - ln(tan(radians(latitude)) + 1.0 / cos(radians(latitude))) / pi()) / 2.0 "
           "* pow(2.0, CAST(zoom AS DOUBLE)))")
register("tile_clusters", W("sites") + f"""
, p AS (SELECT zoom, latitude, longitude, {_TILE_X} AS tx, {_TILE_Y} AS ty
        FROM (SELECT latitude, longitude, unnest(range(7, 15)) AS zoom FROM sites
              WHERE latitude BETWEEN 41 AND 52 AND longitude BETWEEN -6 AND 10))
SELECT CAST(zoom AS INTEGER) AS zoom, CAST(floor(tx) AS BIGINT) AS tile_x, CAST(floor(ty) AS BIGINT) AS tile_y,
       CAST(floor((tx - floor(tx)) * 5.12) AS BIGINT) AS cell_x, CAST(floor((ty - floor(ty)) * 5.12) AS BIGINT) AS cell_y,
       COUNT(*) AS point_count, {R(sql_mean_exact('latitude'), 5)} AS latitude, {R(sql_mean_exact('longitude'), 5)} AS longitude
FROM p GROUP BY 1, 2, 3, 4, 5""")(
    lambda s, d: A.tile_clusters(_t(s, d).sites))

register("tile_clusters_merged", W("sites") + f"""
, p AS (SELECT zoom, latitude, longitude, {_TILE_X} * 5.12 AS px, {_TILE_Y} * 5.12 AS py
        FROM (SELECT latitude, longitude, unnest(range(7, 15)) AS zoom FROM sites
              WHERE latitude BETWEEN 41 AND 52 AND longitude BETWEEN -6 AND 10)),
c AS (SELECT zoom, CAST(floor(px) AS BIGINT) AS cx, CAST(floor(py) AS BIGINT) AS cy, COUNT(*) AS n,
             {sql_mean_exact('px')} AS mx, {sql_mean_exact('py')} AS my,
             {sql_fixed_sum('latitude', 9)} AS lat, {sql_fixed_sum('longitude', 9)} AS lon
      FROM p GROUP BY 1, 2, 3),
pr AS (SELECT a.zoom, a.cx, a.cy, b.cx AS ox, b.cy AS oy, b.n AS bn
       FROM (SELECT *, unnest([-1, 0, 1]) AS i FROM c) a JOIN c b
         ON a.zoom = b.zoom AND b.cx = a.cx + a.i AND b.cy BETWEEN a.cy - 1 AND a.cy + 1
       WHERE (a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) <= 1.0
         AND (b.n > a.n OR (b.n = a.n AND (b.cx < a.cx OR (b.cx = a.cx AND b.cy < a.cy))))),
weak AS (SELECT DISTINCT zoom, cx AS ox, cy AS oy FROM pr),
j AS (SELECT zoom, cx, cy, ox, oy FROM pr ANTI JOIN weak USING (zoom, ox, oy)
      QUALIFY row_number() OVER (PARTITION BY zoom, cx, cy ORDER BY bn DESC, ox, oy) = 1)
SELECT CAST(zoom AS INTEGER) AS zoom, coalesce(j.ox, cx) AS cell_x, coalesce(j.oy, cy) AS cell_y, COUNT(*) AS cells,
       CAST(SUM(n) AS BIGINT) AS point_count,
       {R(sql_fixed_sum('lat', 9) + ' / SUM(n)', 5)} AS latitude, {R(sql_fixed_sum('lon', 9) + ' / SUM(n)', 5)} AS longitude
FROM c LEFT JOIN j USING (zoom, cx, cy) GROUP BY 1, 2, 3""")(
    lambda s, d: A.merged_clusters(_t(s, d).sites))

# -------------------------------------------------------------------- mart
register("mart_build", W("sites") + """
SELECT commune_code, commune_name, department_code, operator AS operator_code, technology,
       '2025_T3' AS quarter, CAST(NULL AS DOUBLE) AS coverage_pct, CAST(NULL AS INTEGER) AS population_covered,
       CAST(NULL AS INTEGER) AS total_population, CAST(COUNT(*) AS INTEGER) AS antenna_count
FROM sites WHERE commune_code IS NOT NULL
GROUP BY commune_code, commune_name, department_code, operator, technology""")(
    lambda s, d: M.mart_build(_t(s, d).sites, "2025_T3"))

register("commune_coverage", W("mart") + """
SELECT commune_code, commune_name, operator_code AS operator, technology, coverage_pct, antenna_count,
       total_population AS population
FROM mart WHERE commune_code = '31003' AND technology = '4G'""")(
    lambda s, d: M.commune_coverage(_t(s, d).mart, "31003", "4G"))

register("top_communes", W("mart") + """
SELECT commune_code, commune_name, department_code, CAST(SUM(antenna_count) AS BIGINT) AS total,
       coalesce(commune_name || ' (' || department_code || ')', commune_code) AS label
FROM mart GROUP BY commune_code, commune_name, department_code ORDER BY total DESC, commune_code LIMIT 10""")(
    lambda s, d: M.top_communes(_t(s, d).mart, None, 10))

register("operator_ranking", W("mart") + f"""
, o AS (SELECT operator_code, {R('AVG(coverage_pct)', 1)} AS mean_coverage_pct,
               CAST(SUM(antenna_count) AS BIGINT) AS antennas,
               COUNT(DISTINCT CASE WHEN coverage_pct > 0 THEN commune_code END) AS communes_covered
        FROM mart WHERE department_code = '31' AND technology = '4G' GROUP BY operator_code)
SELECT CAST(row_number() OVER (ORDER BY mean_coverage_pct DESC NULLS LAST, operator_code) AS INTEGER) AS rank,
       operator_code, mean_coverage_pct, antennas, communes_covered,
       {R('MAX(mean_coverage_pct) OVER () - MIN(mean_coverage_pct) OVER ()', 1)} AS gap
FROM o""")(
    lambda s, d: M.operator_ranking(_t(s, d).mart, "31", "4G"))

register("coverage_gaps", W("mart") + f"""
, c AS (SELECT * FROM mart WHERE commune_code = '31003'),
d AS (SELECT department_code, operator_code, technology, {R('AVG(coverage_pct)', 1)} AS department_mean_pct
      FROM mart WHERE department_code IN (SELECT department_code FROM c)
      GROUP BY department_code, operator_code, technology)
SELECT commune_code, operator_code, technology, coverage_pct, department_mean_pct,
       {R('coverage_pct - department_mean_pct', 1)} AS gap_vs_department
FROM c LEFT JOIN d USING (department_code, operator_code, technology) WHERE coverage_pct < 80.0""")(
    lambda s, d: M.coverage_gaps(_t(s, d).mart, "31003"))

register("least_covered", W("mart") + f"""
SELECT commune_code, commune_name, {R('AVG(coverage_pct)', 1)} AS mean_coverage_pct
FROM mart WHERE technology = '4G' GROUP BY commune_code, commune_name
ORDER BY mean_coverage_pct NULLS LAST, commune_code LIMIT 10""")(
    lambda s, d: M.least_covered(_t(s, d).mart, None, "4G", 10))

register("contract_checks", W("mart") + """
SELECT COUNT(*) AS rows_checked,
       COUNT(*) FILTER (WHERE coverage_pct < 0 OR coverage_pct > 100) AS pct_out_of_range,
       COUNT(*) FILTER (WHERE commune_code IS NULL OR operator_code IS NULL OR technology IS NULL) AS missing_required
FROM mart""")(
    lambda s, d: M.contract_checks(_t(s, d).mart))

# ----------------------------------------------------------------- reports
register("coverage_stats", W("squares") + f"""
SELECT c.operator_code AS operator, o.name AS operator_name, c.technology, COUNT(*) AS geometry_count, c.quarter
FROM squares c LEFT JOIN {OPS_SQL} o ON c.operator_code = o.code WHERE c.technology = '4G'
GROUP BY c.operator_code, o.name, c.technology, c.quarter""")(
    lambda s, d: RP.coverage_stats(_t(s, d).coverage, schema.ref_operators(s), "4G"))

register("data_summary", W("sites", "squares") + """
SELECT 'coverage' AS kind, operator_code AS operator, technology, quarter, COUNT(*) AS cnt
FROM squares GROUP BY operator_code, technology, quarter
UNION ALL SELECT 'antennas', operator, technology, NULL, COUNT(*) FROM sites GROUP BY operator, technology
UNION ALL SELECT 'antennas_total', NULL, NULL, NULL, COUNT(*) FROM sites""")(
    lambda s, d: RP.data_summary(_t(s, d).coverage, _t(s, d).sites))

# ---------------------------------------------------------------- coverage
from covgrid.operators import geometry as G  # noqa: E402
from covgrid.plans import coverage as C  # noqa: E402
from covgrid.session import materialize  # noqa: E402


def _lines(t: FX.Tables) -> DataFrame:
    return G.lines_table(t.line_vertices, t.stations)


_LINES_SQL = f"""
, sg AS (SELECT line_id, feature, seq, x AS x1, y AS y1,
                lead(x) OVER (PARTITION BY feature ORDER BY seq) AS x2,
                lead(y) OVER (PARTITION BY feature ORDER BY seq) AS y2 FROM line_vertices),
segs AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM sg WHERE x2 IS NOT NULL),
names AS (SELECT line_code AS line_id, min(station_name) || ' — ' || max(station_name) AS label
          FROM stations WHERE station_name <> '' GROUP BY line_code HAVING COUNT(DISTINCT station_name) >= 2),
lines AS (SELECT l.line_id, l.feature, coalesce(n.label, '') AS line_name, l.length_km
          FROM (SELECT line_id, feature, {sql_fixed_sum('len', 6)} / 1000.0 AS length_km
                FROM segs GROUP BY line_id, feature) l LEFT JOIN names n USING (line_id))
"""


def _sq_simplified(tol: float) -> str:
    """Squares after Douglas-Peucker at ``tol``: a square ring survives iff
    its corner lies farther than tol from the diagonal (h * sqrt 2 > tol)."""
    return f"""
, poly AS (SELECT id, quarter, operator_code, technology, cx, cy, hw,
                  CASE WHEN hole_hw > 0 AND hole_hw * sqrt(2.0) > {tol} THEN hole_hw ELSE 0 END AS hh
           FROM squares WHERE hw * sqrt(2.0) > {tol})
"""


def _lb(lo: str, hi: str, a: str, d: str) -> tuple[str, str]:
    """Entry / exit parameters of a segment a + t d on the slab [lo, hi]."""
    return f"least(({lo} - {a}) / {d}, ({hi} - {a}) / {d})", f"greatest(({lo} - {a}) / {d}, ({hi} - {a}) / {d})"


def _clip(h: str) -> tuple[str, str]:
    ex0, ex1 = _lb(f"p.cx - {h}", f"p.cx + {h}", "s.x1", "(s.x2 - s.x1)")
    ey0, ey1 = _lb(f"p.cy - {h}", f"p.cy + {h}", "s.y1", "(s.y2 - s.y1)")
    return f"greatest(0.0, {ex0}, {ey0})", f"least(1.0, {ex1}, {ey1})"


_T0, _T1 = _clip("p.hw")
_H0, _H1 = _clip("p.hh")
ROUTE_CTES = W("line_vertices", "stations", "squares") + _LINES_SQL + _sq_simplified(5000.0) + f"""
, cl AS (SELECT s.line_id, s.feature, s.seq AS seg_seq, p.id, p.operator_code, s.len, p.hh, {_T0} AS t0, {_T1} AS t1,
                {_H0} AS h0, {_H1} AS h1,
                (p.hh > 0 AND least(s.x1, s.x2) > p.cx - p.hh AND greatest(s.x1, s.x2) < p.cx + p.hh
                 AND least(s.y1, s.y2) > p.cy - p.hh AND greatest(s.y1, s.y2) < p.cy + p.hh) AS in_hole
         FROM segs s JOIN poly p
           ON p.technology = '4G' AND least(s.x1, s.x2) <= p.cx + p.hw AND greatest(s.x1, s.x2) >= p.cx - p.hw
          AND least(s.y1, s.y2) <= p.cy + p.hw AND greatest(s.y1, s.y2) >= p.cy - p.hw),
pp AS (SELECT line_id, feature, id, operator_code,
              SUM(greatest(t1 - t0, 0.0) * len - CASE WHEN hh > 0 THEN greatest(h1 - h0, 0.0) * len ELSE 0.0 END)
                AS inside_m,
              bool_or(t0 <= t1 AND NOT in_hole) AS touch
       FROM cl GROUP BY line_id, feature, id, operator_code),
agg AS (SELECT pp.line_id, pp.operator_code, SUM(inside_m / 1000.0) AS cov, MAX(l.length_km) AS total
        FROM pp JOIN lines l USING (line_id, feature) WHERE touch GROUP BY pp.line_id, pp.operator_code)
"""
ROUTE_SELECT = f"""
SELECT line_id, operator_code AS operator, o.name AS operator_name, total AS total_length_km,
       {R('least(cov, total)', 1)} AS covered_length_km,
       {R('least(cov / nullif(total, 0) * 100, 100)', 1)} AS coverage_pct
FROM agg LEFT JOIN {OPS_SQL} o ON agg.operator_code = o.code"""
ROUTE_COVERAGE_SQL = ROUTE_CTES + ROUTE_SELECT


@lru_cache(maxsize=16)
def _stage(s, d: str, technology: str) -> tuple[DataFrame, DataFrame | None]:
    """The simplified coverage of one technology, or of all, a stored table of the session:
    written by the first query that reads it, shared by all others.  It keeps the
    box columns, so a query for a few lines prunes its scan.  Beside it, the grid of
    the dense cells of lines and coverage."""
    cov = _t(s, d).coverage
    if technology != "all":
        cov = cov.filter(F.col("technology") == technology)
    stg = materialize(C.simplified_coverage(cov, C.SIMPLIFY_TOLERANCE), "stg")
    return stg, C.stored_grid(_t(s, d).line_vertices, stg)


def _route_coverage(s, d, technology="4G", line_ids=None, union=False):
    t = _t(s, d)
    (stg, grid), lines = _stage(s, d, technology), _lines(t)
    if line_ids:
        stg = C.coverage_near(stg, t.line_vertices.filter(F.col("line_id").isin(line_ids)))
    return C.route_coverage(t.line_vertices, lines, stg, schema.ref_operators(s), technology, line_ids, union=union,
                            grid=grid)


register("route_coverage", ROUTE_COVERAGE_SQL)(
    lambda s, d: _route_coverage(s, d).orderBy("line_id", F.desc_nulls_last("coverage_pct"), "operator"))

ALL_CTES = ROUTE_CTES.replace("p.technology = '4G' AND ", "")
register("route_coverage_union", ALL_CTES + f"""
, iv AS (SELECT line_id, feature, seg_seq, len, operator_code, unnest(CASE WHEN hh > 0 AND h1 > h0
                  THEN [{{'a': t0, 'b': greatest(t0, h0)}}, {{'a': least(t1, h1), 'b': t1}}] ELSE [{{'a': t0, 'b': t1}}] END) AS i
         FROM cl WHERE t1 > t0),
nw AS (SELECT *, i.a AS a, i.b AS b, max(i.b) OVER (PARTITION BY feature, seg_seq, operator_code ORDER BY i.a, i.b
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE i.b > i.a),
uc AS (SELECT line_id, feature, operator_code, SUM(greatest(0.0, b - greatest(a, coalesce(reach, 0.0))) * len) AS m
       FROM nw GROUP BY line_id, feature, operator_code),
ag2 AS (SELECT agg.line_id, agg.operator_code, coalesce(uc.m, 0.0) / 1000.0 AS cov, total
        FROM agg LEFT JOIN uc USING (line_id, operator_code))
SELECT line_id, operator_code AS operator, o.name AS operator_name, total AS total_length_km,
       {R('least(cov, total)', 1)} AS covered_length_km,
       {R('least(cov / nullif(total, 0) * 100, 100)', 1)} AS coverage_pct
FROM ag2 LEFT JOIN {OPS_SQL} o ON ag2.operator_code = o.code""")(
    lambda s, d: _route_coverage(s, d, "all", union=True))

register("route_contract_checks", ROUTE_CTES + f"""
, rc AS ({ROUTE_SELECT})
SELECT COUNT(*) AS rows_checked,
       COUNT(*) FILTER (WHERE coverage_pct < 0 OR coverage_pct > 100) AS pct_out_of_range,
       COUNT(*) FILTER (WHERE covered_length_km < 0 OR total_length_km < 0) AS negative_length,
       COUNT(*) FILTER (WHERE covered_length_km > total_length_km + 0.1) AS covered_over_total,
       COUNT(*) FILTER (WHERE line_id IS NULL OR operator IS NULL) AS missing_required
FROM rc""")(
    lambda s, d: C.route_contract_checks(_route_coverage(s, d)))

register("simplified_coverage", W("squares") + f"""
SELECT id, operator_code, technology, cx - hw AS bbox_xmin, cy - hw AS bbox_ymin, cx + hw AS bbox_xmax,
       cy + hw AS bbox_ymax,
       CAST(CASE WHEN hw * sqrt(2.0) <= 5000.0 THEN 0
                 WHEN hole_hw > 0 AND hole_hw * sqrt(2.0) > 5000.0 THEN 10 ELSE 5 END AS INTEGER) AS n_points
FROM squares""")(
    lambda s, d: C.simplified_summary(C.simplified_coverage(_t(s, d).coverage, C.SIMPLIFY_TOLERANCE)))

#: A bend of a side is kept where it is deeper than the tolerance; corners always are (see FIXTURES.md).
register("simplified_shapes", W("squares") + """
, b AS (SELECT id, cx, cy, hw + 10000 AS h, [CASE WHEN (id + k) % 3 = 0 THEN -1 ELSE 1 END
               * [1000, 3500, 6000, 8000][(id + k * k) % 4 + 1] FOR k IN [0, 1, 2, 3]] AS d FROM squares),
v AS (SELECT id, unnest([{'i': 0, 'x': cx - h, 'y': cy - h, 'd': NULL}, {'i': 1, 'x': cx, 'y': cy - (h + d[1]), 'd': d[1]},
        {'i': 2, 'x': cx + h, 'y': cy - h, 'd': NULL}, {'i': 3, 'x': cx + h + d[2], 'y': cy, 'd': d[2]},
        {'i': 4, 'x': cx + h, 'y': cy + h, 'd': NULL}, {'i': 5, 'x': cx, 'y': cy + h + d[3], 'd': d[3]},
        {'i': 6, 'x': cx - h, 'y': cy + h, 'd': NULL}, {'i': 7, 'x': cx - (h + d[4]), 'y': cy, 'd': d[4]},
        {'i': 8, 'x': cx - h, 'y': cy - h, 'd': NULL}]) AS p FROM b)
SELECT id, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring, row_number() OVER (PARTITION BY id ORDER BY p.i) - 1 AS idx,
       p.x AS x, p.y AS y FROM v WHERE p.d IS NULL OR abs(p.d) > 5000""")(
    lambda s, d: C.simplified_points(_t(s, d).shapes))

_ROUTE_LINES = ["000002", "000064"]
register("merged_route_coverage", ROUTE_CTES + f"""
, rc AS ({ROUTE_SELECT} WHERE line_id IN ('000002', '000064'))
SELECT operator, min(operator_name) AS operator_name, {R('SUM(total_length_km)', 1)} AS total_length_km,
       {R('SUM(covered_length_km)', 1)} AS covered_length_km,
       {R('SUM(covered_length_km) / (CASE WHEN SUM(total_length_km) <> 0 THEN SUM(total_length_km) ELSE 1.0 END) * 1000.0', 0)} / 10.0 AS coverage_pct
FROM rc GROUP BY operator""")(
    lambda s, d: C.merged_route_coverage(_route_coverage(s, d, "4G", _ROUTE_LINES)))

from covgrid.functions.expr import sql_lambert_lonlat, sql_lambert_xy  # noqa: E402

_PT = (47.0, 2.0)
_PX, _PY = sql_lambert_xy(repr(_PT[1]), repr(_PT[0]))
register("operators_at_point", W("squares") + f"""
, q AS (SELECT *, {_PX} AS px, {_PY} AS py FROM squares WHERE technology = '4G')
SELECT DISTINCT operator_code AS operator, technology FROM q
WHERE px > cx - hw AND px < cx + hw AND py > cy - hw AND py < cy + hw
  AND NOT (hole_hw > 0 AND px > cx - hole_hw AND px < cx + hole_hw AND py > cy - hole_hw AND py < cy + hole_hw)""")(
    lambda s, d: C.operators_at_point(_t(s, d).coverage, *_PT, "4G"))

_CX, _CY = sql_lambert_xy("longitude", "latitude")
register("site_coverage", W("sites", "squares") + f"""
, pt AS (SELECT id, operator, technology, {_CX} AS px, {_CY} AS py FROM sites),
h AS (SELECT pt.id, list_sort(list(DISTINCT operator_code)) AS ops FROM pt JOIN squares q USING (technology)
      WHERE px > cx - hw AND px < cx + hw AND py > cy - hw AND py < cy + hw
        AND NOT (hole_hw > 0 AND px > cx - hole_hw AND px < cx + hole_hw AND py > cy - hole_hw AND py < cy + hole_hw)
      GROUP BY pt.id)
SELECT id, operator, technology, CAST(coalesce(len(ops), 0) AS BIGINT) AS n_operators,
       coalesce(array_to_string(ops, ','), '') AS operators, coalesce(list_contains(ops, operator), false) AS own_operator
FROM pt LEFT JOIN h USING (id)""")(
    lambda s, d: C.site_coverage(_t(s, d).sites, _t(s, d).coverage))


def _ring_sql(h: str) -> str:
    """GeoJSON text of a square ring (counter-clockwise from the lower-left
    corner, closed) of half-width ``h`` around (cx, cy), in degrees."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    pts = []
    for dx, dy in corners:
        lon, lat = sql_lambert_lonlat(f"(cx + {dx} * {h})", f"(cy + {dy} * {h})")
        pts.append(f"'[' || printf('%.7f', {R(lon, 7)}) || ',' || printf('%.7f', {R(lat, 7)}) || ']'")
    return "'[' || " + " || ',' || ".join(pts) + " || ']'"


def _features_sql(tol: float, tech_filter: str) -> str:
    return W("squares") + _sq_simplified(tol) + f"""
SELECT p.id, p.operator_code AS operator, p.technology, p.quarter,
       '{{"type":"Feature","geometry":{{"type":"MultiPolygon","coordinates":[[' || {_ring_sql('hw')} ||
       CASE WHEN hh > 0 THEN ',' || {_ring_sql('hh')} ELSE '' END || ']]}},"properties":' ||
       to_json({{'operator': p.operator_code, 'operator_name': coalesce(o.name, p.operator_code),
                'technology': p.technology, 'quarter': p.quarter}}) || '}}' AS feature
FROM poly p LEFT JOIN {OPS_SQL} o ON p.operator_code = o.code {tech_filter}"""


register("coverage_geojson", _features_sql(5000.0, "WHERE p.technology = '4G'"))(
    lambda s, d: C.coverage_features(C.simplified_coverage(_t(s, d).coverage, C.SIMPLIFY_TOLERANCE),
                                     schema.ref_operators(s), "4G"))
register("coverage_tiles", _features_sql(750.0, ""))(
    lambda s, d: C.coverage_features(C.simplified_coverage(_t(s, d).coverage, C.TILE_TOLERANCE),
                                     schema.ref_operators(s), "all"))

# -------------------------------------------------------------------- rail
from covgrid.plans import rail as RL  # noqa: E402

register("line_names", W("stations") + """
SELECT line_code AS line_id, min(station_name) || ' — ' || max(station_name) AS label
FROM stations WHERE station_name <> '' GROUP BY line_code HAVING COUNT(DISTINCT station_name) >= 2""")(
    lambda s, d: G.line_names(_t(s, d).stations))

register("railway_lines", W("line_vertices", "stations") + _LINES_SQL + f"""
SELECT line_id, line_name, {R('length_km', 1)} AS length_km FROM lines ORDER BY line_name, line_id LIMIT 50""")(
    lambda s, d: RL.railway_lines(_lines(_t(s, d)), None, 50))

register("railway_lines_search", W("line_vertices", "stations") + _LINES_SQL + f"""
SELECT line_id, line_name, {R('length_km', 1)} AS length_km FROM lines
WHERE lower(line_name) LIKE '%gare 12%' OR line_id LIKE '%Gare 12%' ORDER BY line_name, line_id LIMIT 50""")(
    lambda s, d: RL.railway_lines(_lines(_t(s, d)), "Gare 12", 50))

register("railway_stations", W("stations") + f"""
SELECT min(station_id) AS station_id, station_name,
       array_to_string(list_sort(list(DISTINCT line_code)), ',') AS line_codes,
       min(commune) AS commune, min(department) AS department,
       {R(sql_mean_exact('latitude'), 6)} AS latitude, {R(sql_mean_exact('longitude'), 6)} AS longitude
FROM stations GROUP BY station_name ORDER BY station_name LIMIT 20""")(
    lambda s, d: RL.railway_stations(_t(s, d).stations, None, 20))


_LON, _LAT = sql_lambert_lonlat("x", "y")
register("route_vertices", W("line_vertices", "stations") + _LINES_SQL + f"""
SELECT v.line_id, CAST(0 AS INTEGER) AS part, CAST(v.seq AS INTEGER) AS seq, {R(_LON, 7)} AS lon, {R(_LAT, 7)} AS lat,
       l.line_name, {R('l.length_km', 1)} AS length_km
FROM line_vertices v JOIN lines l USING (line_id, feature)""")(
    lambda s, d: RL.route_vertices(_t(s, d).line_vertices, _lines(_t(s, d))))

register("route_geojson", W("line_vertices", "stations") + _LINES_SQL + f"""
SELECT v.line_id, l.line_name, {R('l.length_km', 1)} AS length_km,
       '{{"type":"LineString","coordinates":[' ||
       string_agg('[' || printf('%.7f', {R(_LON, 7)}) || ',' || printf('%.7f', {R(_LAT, 7)}) || ']', ',' ORDER BY v.seq)
       || ']}}' AS geometry
FROM line_vertices v JOIN lines l USING (line_id, feature)
GROUP BY v.line_id, l.line_name, l.length_km""")(
    lambda s, d: RL.route_geojson(_t(s, d).line_vertices, _lines(_t(s, d))))

register("direct_route", W("stations") + """
, g AS (SELECT list_sort(list(DISTINCT line_code) FILTER (WHERE station_name = 'Gare 14')) AS dl,
               list_sort(list(DISTINCT line_code) FILTER (WHERE station_name = 'Gare 38')) AS al
        FROM stations WHERE station_name IN ('Gare 14', 'Gare 38')),
c AS (SELECT list_filter(dl, lambda x: list_contains(al, x)) AS common FROM g)
SELECT 'Gare 14' AS departure, 'Gare 38' AS arrival, array_to_string(common, ',') AS common_lines,
       common[1] AS direct_line FROM c""")(
    lambda s, d: RL.direct_route(_t(s, d).stations, "Gare 14", "Gare 38"))


def station_position(suppkey: int, i: int) -> tuple[float, float]:
    """Latitude/longitude of fixture station i of a supplier's line."""
    lat = 46.5 + (6150000 + (suppkey * 64217 % 800000) + (1 if suppkey % 2 == 0 else -1) * i * 15000
                  - 6600000) / 111200.0
    lon = 3 + (150000 + (suppkey * 78901 % 600000) + i * 40000 - 700000) / 76500.0
    return lat, lon


_DEP = station_position(2, 0)
_ARR = station_position(64, 0)
_SX, _SY = sql_lambert_xy("longitude", "latitude")


def _contact_sql() -> str:
    def pt_seg(px, py, ax, ay, bx, by, tag):
        dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
        l2 = f"({dx} * {dx} + {dy} * {dy})"
        t = (f"(CASE WHEN {l2} > 0 THEN least(1.0, greatest(0.0, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {l2}))"
             f" ELSE 0.0 END)")
        cx, cy = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
        d = f"sqrt(({px} - {cx}) * ({px} - {cx}) + ({py} - {cy}) * ({py} - {cy}))"
        return f"{cx} AS {tag}x, {cy} AS {tag}y, {d} AS {tag}d"
    return ", ".join([
        pt_seg("ax1", "ay1", "bx1", "by1", "bx2", "by2", "p1"),
        pt_seg("ax2", "ay2", "bx1", "by1", "bx2", "by2", "p2"),
        pt_seg("bx1", "by1", "ax1", "ay1", "ax2", "ay2", "p3"),
        pt_seg("bx2", "by2", "ax1", "ay1", "ax2", "ay2", "p4"),
    ])


TRANSFERS_SQL = W("line_vertices", "stations") + _LINES_SQL + f"""
, a AS (SELECT line_id AS line_a, feature AS fa, seq AS sa, x1 AS ax1, y1 AS ay1, x2 AS ax2, y2 AS ay2
        FROM segs WHERE line_id IN ('000002', '000064')),
b AS (SELECT line_id AS line_b, feature AS fb, seq AS sb, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2
      FROM segs WHERE line_id NOT IN ('000002', '000064')),
pr AS (SELECT *, (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) AS den,
              (bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1) AS tn,
              (bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1) AS un,
              {_contact_sql()}
       FROM a JOIN b ON line_a <> line_b
        AND least(ax1, ax2) - 500.0 <= greatest(bx1, bx2) AND least(bx1, bx2) <= greatest(ax1, ax2) + 500.0
        AND least(ay1, ay2) - 500.0 <= greatest(by1, by2) AND least(by1, by2) <= greatest(ay1, ay2) + 500.0),
cp AS (SELECT line_a, fa, line_b, fb, sa, sb,
              (den <> 0 AND tn / den >= 0 AND tn / den <= 1 AND un / den >= 0 AND un / den <= 1) AS crosses,
              * EXCLUDE (line_a, fa, line_b, fb, sa, sb) FROM pr),
cq AS (SELECT line_a, fa, line_b, fb, sa, sb,
              CASE WHEN crosses THEN 0.0 ELSE least(p1d, p2d, p3d, p4d) END AS d,
              CASE WHEN crosses THEN 0 WHEN p1d <= p2d AND p1d <= p3d AND p1d <= p4d THEN 1
                   WHEN p2d <= p3d AND p2d <= p4d THEN 2 WHEN p3d <= p4d THEN 3 ELSE 4 END AS k,
              CASE WHEN crosses THEN ax1 + tn / den * (ax2 - ax1) WHEN p1d <= p2d AND p1d <= p3d AND p1d <= p4d THEN ax1
                   WHEN p2d <= p3d AND p2d <= p4d THEN ax2 WHEN p3d <= p4d THEN p3x ELSE p4x END AS cx,
              CASE WHEN crosses THEN ay1 + tn / den * (ay2 - ay1) WHEN p1d <= p2d AND p1d <= p3d AND p1d <= p4d THEN ay1
                   WHEN p2d <= p3d AND p2d <= p4d THEN ay2 WHEN p3d <= p4d THEN p3y ELSE p4y END AS cy
       FROM cp),
adj AS (SELECT line_a, fa, line_b, fb, arg_min(cx, (d, sa, sb, k)) AS cx, arg_min(cy, (d, sa, sb, k)) AS cy
        FROM cq WHERE d <= 500.0 GROUP BY line_a, fa, line_b, fb),
bridge AS (SELECT d.fb AS feature, d.line_b AS line_id, d.fa AS dep_feature, d.cx, d.cy, l.line_name, l.length_km
           FROM adj d JOIN lines l ON l.feature = d.fb
           WHERE d.line_a IN ('000002') AND d.fb IN (SELECT fb FROM adj WHERE line_a IN ('000064'))),
st AS (SELECT line_code, station_id, station_name, {_SX} AS sx, {_SY} AS sy FROM stations),
nearest AS (SELECT b.feature, b.dep_feature, b.line_id, b.line_name, b.length_km,
                   arg_min(st.station_name, (sqrt((st.sx - b.cx) * (st.sx - b.cx) + (st.sy - b.cy) * (st.sy - b.cy)),
                                             st.station_id)) AS transfer_station
            FROM bridge b JOIN st ON st.line_code = b.line_id OR st.line_code IN ('000002')
            GROUP BY b.feature, b.dep_feature, b.line_id, b.line_name, b.length_km),
ends AS (SELECT arg_min(station_name, ((latitude - {_DEP[0]!r}) * (latitude - {_DEP[0]!r})
                                       + (longitude - {_DEP[1]!r}) * (longitude - {_DEP[1]!r}), station_id)) AS n
         FROM stations
         UNION ALL
         SELECT arg_min(station_name, ((latitude - {_ARR[0]!r}) * (latitude - {_ARR[0]!r})
                                       + (longitude - {_ARR[1]!r}) * (longitude - {_ARR[1]!r}), station_id))
         FROM stations),
first_pos AS (SELECT station_name, arg_min(latitude, station_id) AS transfer_lat,
                     arg_min(longitude, station_id) AS transfer_lon FROM stations GROUP BY station_name),
opts AS (SELECT DISTINCT line_id, line_name, {R('length_km', 1)} AS length_km, transfer_station FROM nearest
         WHERE transfer_station NOT IN (SELECT n FROM ends)),
ranked AS (SELECT o.*, f.transfer_lat, f.transfer_lon,
                  row_number() OVER (PARTITION BY transfer_station ORDER BY length_km DESC, line_id) AS r
           FROM opts o LEFT JOIN first_pos f ON f.station_name = o.transfer_station)
SELECT line_id, line_name, length_km, transfer_station, transfer_lat, transfer_lon FROM ranked WHERE r = 1
ORDER BY length_km DESC, line_id, transfer_station LIMIT 5"""

register("transfers", TRANSFERS_SQL)(
    lambda s, d: RL.transfers(_t(s, d).line_vertices, _lines(_t(s, d)), _t(s, d).stations,
                              ["000002"], ["000064"], *_DEP, *_ARR))

#: Contacts of all lines with each other, as in TRANSFERS_SQL of some lines with the others.
_CONTACTS = TRANSFERS_SQL[TRANSFERS_SQL.index(", a AS ("):TRANSFERS_SQL.index("bridge AS (")]
_CONTACTS = _CONTACTS.replace("WHERE line_id IN ('000002', '000064')", "").replace(
    "WHERE line_id NOT IN ('000002', '000064')", "")
register("routes", W("line_vertices", "stations", "station_pairs") + _LINES_SQL + _CONTACTS + f"""
codes AS (SELECT DISTINCT station_name, line_code FROM stations),
dep0 AS (SELECT DISTINCT pair_id, line_code FROM station_pairs JOIN codes ON dep_station = station_name),
arr0 AS (SELECT DISTINCT pair_id, line_code FROM station_pairs JOIN codes ON arr_station = station_name),
direct AS (SELECT pair_id, min(line_code) AS line_id FROM dep0 JOIN arr0 USING (pair_id, line_code) GROUP BY pair_id),
dep AS (SELECT * FROM dep0 WHERE pair_id NOT IN (SELECT pair_id FROM direct)),
arr AS (SELECT * FROM arr0 WHERE pair_id NOT IN (SELECT pair_id FROM direct)),
toarr AS (SELECT DISTINCT pair_id, fb FROM adj JOIN arr ON line_a = line_code),
own AS (SELECT pair_id, line_code AS line_b FROM dep UNION SELECT pair_id, line_code FROM arr),
br AS (SELECT dep.pair_id, adj.* FROM adj JOIN dep ON line_a = line_code JOIN toarr t ON t.pair_id = dep.pair_id AND t.fb = adj.fb
       ANTI JOIN own ON own.pair_id = dep.pair_id AND own.line_b = adj.line_b),
st AS (SELECT line_code, station_id, station_name, {_SX} AS sx, {_SY} AS sy FROM stations),
cand AS (SELECT br.*, st.* FROM br JOIN st ON st.line_code = br.line_b
         UNION ALL SELECT br.*, st.* FROM br JOIN dep ON dep.pair_id = br.pair_id JOIN st ON st.line_code = dep.line_code),
near AS (SELECT pair_id, fb, fa, arg_min(station_name, (sqrt((sx - cx) * (sx - cx) + (sy - cy) * (sy - cy)), station_id)) AS transfer_station
         FROM cand GROUP BY pair_id, fb, fa),
pos AS (SELECT station_name, {R(sql_mean_exact('latitude'), 6)} AS la, {R(sql_mean_exact('longitude'), 6)} AS lo FROM stations GROUP BY station_name),
close AS (SELECT pos.station_name, arg_min(s.station_name, (sqrt((longitude - lo) * (longitude - lo) + (latitude - la) * (latitude - la)), station_id)) AS n
          FROM pos, stations s GROUP BY pos.station_name),
ends AS (SELECT DISTINCT pair_id, n FROM station_pairs JOIN close ON station_name IN (dep_station, arr_station)),
first_pos AS (SELECT station_name AS transfer_station, arg_min(latitude, station_id) AS transfer_lat,
                     arg_min(longitude, station_id) AS transfer_lon FROM stations GROUP BY station_name),
opts AS (SELECT DISTINCT pair_id, line_id, line_name, {R('length_km', 1)} AS length_km, transfer_station
         FROM near JOIN lines l ON l.feature = fb ANTI JOIN ends e ON e.pair_id = near.pair_id AND e.n = transfer_station),
r1 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, transfer_station ORDER BY length_km DESC, line_id) AS r FROM opts),
r2 AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY pair_id ORDER BY length_km DESC, line_id, transfer_station) AS option
       FROM r1 WHERE r = 1),
res AS (SELECT pair_id, 'direct' AS kind, 1 AS option, line_id, line_name, {R('length_km', 1)} AS length_km,
               NULL AS transfer_station, NULL AS transfer_lat, NULL AS transfer_lon FROM direct JOIN lines USING (line_id)
        UNION ALL SELECT pair_id, 'transfer', option, line_id, line_name, length_km, transfer_station, transfer_lat, transfer_lon
        FROM r2 JOIN first_pos USING (transfer_station) WHERE option <= 5)
SELECT p.pair_id, dep_station, arr_station, coalesce(kind, 'none') AS kind, CAST(option AS INTEGER) AS option, line_id,
       line_name, length_km, transfer_station, transfer_lat, transfer_lon FROM station_pairs p LEFT JOIN res USING (pair_id)""")(
    lambda s, d: RL.routes(_t(s, d).station_pairs, _t(s, d).line_vertices, _lines(_t(s, d)), _t(s, d).stations))

register("nearest_stations", W("sites", "stations") + f"""
, st AS (SELECT station_id, station_name, {_SX} AS sx, {_SY} AS sy FROM stations),
pt AS (SELECT id, {_SX} AS px, {_SY} AS py FROM sites),
pr AS (SELECT id, station_id, station_name, sqrt((sx - px) * (sx - px) + (sy - py) * (sy - py)) AS d FROM pt, st)
SELECT id, station_id, station_name, CAST(rank AS INTEGER) AS rank, {R('d / 1000.0', 3)} AS distance_km
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, station_id) AS rank FROM pr) WHERE rank <= 2""")(
    lambda s, d: RL.nearest_stations(_t(s, d).sites, _t(s, d).stations, 2))

_ST_T = ("(CASE WHEN len > 0 THEN least(1.0, greatest(0.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) "
         "/ ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0.0 END)")
register("station_places", W("line_vertices", "stations") + _LINES_SQL + f"""
, ms AS (SELECT *, CAST(floor(len * 1e6 + 0.5) AS BIGINT) AS um FROM segs),
mp AS (SELECT *, CAST(SUM(um) OVER (PARTITION BY feature ORDER BY seq) - um AS DOUBLE) / 1e6 AS before_m,
              CAST(SUM(um) OVER (PARTITION BY feature) AS DOUBLE) / 1e6 AS total_m FROM ms),
pr AS (SELECT station_id, station_name, line_code, {_SX} AS px, {_SY} AS py, mp.* FROM stations JOIN mp ON line_id = line_code),
pt AS (SELECT *, {_ST_T} AS t FROM pr),
pd AS (SELECT *, sqrt((px - (x1 + t * (x2 - x1))) * (px - (x1 + t * (x2 - x1)))
                    + (py - (y1 + t * (y2 - y1))) * (py - (y1 + t * (y2 - y1)))) AS d FROM pt),
b AS (SELECT station_id, min(station_name) AS station_name, min(line_code) AS line_id, min(d) AS d,
             arg_min(before_m + t * len, (d, seq)) AS along_m, min(total_m) AS total_m FROM pd GROUP BY station_id)
SELECT station_id, station_name, line_id, {R('along_m / 1000.0', 3)} AS along_km,
       {R('along_m / nullif(total_m, 0)', 5)} AS fraction, {R('d / 1000.0', 3)} AS distance_km FROM b""")(
    lambda s, d: RL.station_places(_t(s, d).stations, _t(s, d).line_vertices, _lines(_t(s, d))))

# ----------------------------------------------------------------- reports
register("table_counts", W("sites", "squares", "line_vertices", "stations", "mart") + """
SELECT 'raw_antenna_sites' AS table_name, COUNT(*) AS row_count FROM sites
UNION ALL SELECT 'raw_coverage', COUNT(*) FROM squares
UNION ALL SELECT 'ref_railway_lines', COUNT(DISTINCT feature) FROM line_vertices
UNION ALL SELECT 'ref_railway_stations', COUNT(*) FROM stations
UNION ALL SELECT 'stg_coverage_simplified', COUNT(*) FROM squares
UNION ALL SELECT 'mart_coverage_by_commune', COUNT(*) FROM mart
UNION ALL SELECT 'ref_operators', 4 UNION ALL SELECT 'ref_technologies', 4""")(
    lambda s, d: RP.table_counts({
        "raw_antenna_sites": _t(s, d).sites, "raw_coverage": _t(s, d).coverage,
        "ref_railway_lines": _lines(_t(s, d)), "ref_railway_stations": _t(s, d).stations,
        "stg_coverage_simplified": _t(s, d).coverage,  # simplification keeps every row
        "mart_coverage_by_commune": _t(s, d).mart,
        "ref_operators": schema.ref_operators(s), "ref_technologies": schema.ref_technologies(s)}))

register("load_report", W("sites", "line_vertices", "stations") + _LINES_SQL + f"""
SELECT 'site_rows' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM sites
UNION ALL SELECT 'operators', CAST(COUNT(DISTINCT operator) AS DOUBLE) FROM sites
UNION ALL SELECT 'lines', CAST(COUNT(*) AS DOUBLE) FROM lines
UNION ALL SELECT 'total_km', {R('SUM(length_km)', 0)} FROM lines
UNION ALL SELECT 'stations', CAST(COUNT(*) AS DOUBLE) FROM stations""")(
    lambda s, d: RP.load_report(_t(s, d).sites, _lines(_t(s, d)), _t(s, d).stations))

_FROM = station_position(2, 0)
_TO = station_position(2, 8)
_FX, _FY = sql_lambert_xy(repr(_FROM[1]), repr(_FROM[0]))
_TX, _TY = sql_lambert_xy(repr(_TO[1]), repr(_TO[0]))


def _locate_sql(px: str, py: str, name: str) -> str:
    t = (f"(CASE WHEN l2 > 0 THEN least(1.0, greatest(0.0, (({px} - x1) * dx + ({py} - y1) * dy) / l2)) "
         f"ELSE 0.0 END)")
    return f"""{name} AS (
  SELECT feature, arg_min(before + {t} * len,
         (sqrt(({px} - (x1 + {t} * dx)) * ({px} - (x1 + {t} * dx)) + ({py} - (y1 + {t} * dy)) * ({py} - (y1 + {t} * dy))),
          seq)) / max(total) AS f
  FROM c2 GROUP BY feature)"""


register("route_segment", W("line_vertices", "stations") + _LINES_SQL + f"""
, sv AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2
         FROM segs WHERE line_id = '000002'),
ls AS (SELECT feature, list(len ORDER BY seq) AS lens FROM sv GROUP BY feature),
c2 AS (SELECT sv.*, list_reduce(list_prepend(0.0, lens[1:seq]), lambda a, b: a + b) AS before,
              list_reduce(list_prepend(0.0, lens), lambda a, b: a + b) AS total
       FROM sv JOIN ls USING (feature)),
{_locate_sql(_FX, _FY, 'f1')},
{_locate_sql(_TX, _TY, 'f2')},
co AS (SELECT feature, list([{R(_LON, 7)}, {R(_LAT, 7)}] ORDER BY seq) AS coords
       FROM line_vertices WHERE line_id = '000002' GROUP BY feature),
g AS (SELECT l.line_id, l.line_name, l.length_km, co.coords, len(co.coords) AS n,
             least(f1.f, f2.f) AS lo, greatest(f1.f, f2.f) AS hi
      FROM co JOIN f1 USING (feature) JOIN f2 USING (feature) JOIN lines l USING (feature)),
g2 AS (SELECT *, greatest(0, CAST(trunc(lo * (n - 1)) AS INTEGER)) AS s,
              least(n, CAST(trunc(hi * (n - 1)) AS INTEGER) + 1) AS e0 FROM g),
g3 AS (SELECT *, CASE WHEN e0 <= s THEN s + 1 ELSE e0 END AS e FROM g2),
g4 AS (SELECT *, CASE WHEN n > 1 THEN coords[s + 1:e] ELSE coords END AS sg FROM g3),
fin AS (SELECT line_id, line_name, {R(R('length_km', 1) + ' * (hi - lo)', 1)} AS length_km,
               sg AS out
        FROM g4)
SELECT line_id, line_name, length_km, idx, out[idx + 1][1] AS lon, out[idx + 1][2] AS lat
FROM (SELECT *, unnest(range(len(out))) AS idx FROM fin)""")(
    lambda s, d: RL.route_segment_points(RL.route_segment(_t(s, d).line_vertices, _lines(_t(s, d)), "000002",
                                                          *_FROM, *_TO)))

# ------------------------------------------------- report variants (tools)
register("route_coverage_ranked", ROUTE_COVERAGE_SQL.replace(
    "SELECT line_id, operator_code AS operator,",
    "SELECT line_id, operator_code AS operator, CAST(row_number() OVER (PARTITION BY line_id ORDER BY "
    f"{R('least(cov / nullif(total, 0) * 100, 100)', 1)} DESC NULLS LAST, operator_code) AS INTEGER) AS rank,", 1))(
    lambda s, d: C.ranked_route_coverage(_route_coverage(s, d)))

register("nearby_report", W("sites") + f"""
SELECT id, operator, technology, latitude, longitude, commune_code, department_code,
       {R(sql_planar_km('latitude', 'longitude', 46.5, 2.5), 2)} AS distance_km
FROM sites WHERE {sql_planar_km('latitude', 'longitude', 46.5, 2.5)} <= 50.0 AND technology = '4G'
ORDER BY distance_km, id LIMIT 20""")(
    lambda s, d: A.nearby_antennas(_t(s, d).sites, 46.5, 2.5, 50.0, "4G", 20))

register("route_extent", W("stations") + f"""
, p AS (SELECT station_name, {R(sql_mean_exact('latitude'), 6)} AS lat, {R(sql_mean_exact('longitude'), 6)} AS lon
        FROM stations WHERE station_name IN ('Gare 14', 'Gare 38') GROUP BY station_name)
SELECT min(lon) - 0.5 AS west, min(lat) - 0.3 AS south, max(lon) + 0.5 AS east, max(lat) + 0.3 AS north,
       COUNT(*) AS stations FROM p""")(
    lambda s, d: RL.route_extent(_t(s, d).stations, ["Gare 14", "Gare 38"]))

# ------------------------------------------------------------------- loads
from covgrid.plans import loads as LD  # noqa: E402
from covgrid.session import stage_path  # noqa: E402
from covgrid.sources import coverage_files as CF  # noqa: E402
from covgrid.sources import sinks  # noqa: E402


@lru_cache(maxsize=16)
def _loaded_coverage(s, d: str) -> DataFrame:
    """A delivery of geometry blobs, loaded; its b files loaded once more."""
    blobs = materialize(CF.encode_blobs(FX.delivery(_t(s, d).coverage)), "delivery")
    return LD.load_twice(blobs, blobs.filter(F.col("source_file").endswith("_b")), stage_path(s, "raw-coverage"))


register("coverage_load", W("squares") + """
SELECT quarter, technology, operator_code, concat_ws('_', quarter, operator_code, technology,
         CASE WHEN CAST(floor(id / 24) AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END) AS source_file,
       COUNT(*) AS geometry_count, CAST(SUM(CASE WHEN hole_hw > 0 THEN 2 ELSE 1 END) AS BIGINT) AS rings,
       CAST(SUM(CASE WHEN hole_hw > 0 THEN 10 ELSE 5 END) AS BIGINT) AS points,
       CAST(SUM(4 * hw * hw - 4 * hole_hw * hole_hw) AS BIGINT) AS area_m2, true AS dated
FROM squares GROUP BY ALL""")(
    lambda s, d: LD.coverage_load(_loaded_coverage(s, d)))

register("coverage_load_partition", W("squares") + """
SELECT id, operator_code, technology, quarter, CAST(CASE WHEN hole_hw > 0 THEN 2 ELSE 1 END AS INTEGER) AS rings,
       cx - hw AS bbox_xmin, cy - hw AS bbox_ymin, cx + hw AS bbox_xmax, cy + hw AS bbox_ymax
FROM squares WHERE quarter = '2025_T3' AND technology = '4G' AND operator_code IN ('OF', 'SFR')""")(
    lambda s, d: _loaded_coverage(s, d).filter("quarter = '2025_T3' AND technology = '4G' AND operator_code IN ('OF', 'SFR')")
    .select("id", "operator_code", "technology", "quarter", F.size("rings").alias("rings"), *G.geometry_bbox("rings")))

_WANTED = [("OF", "4G"), ("SFR", "2G"), ("ABSENT", "4G")]


@lru_cache(maxsize=16)
def _prepared(s, d: str) -> str:
    path = stage_path(s, "prepared")
    sinks.write_features(C.coverage_features(C.simplified_coverage(_t(s, d).coverage, C.TILE_TOLERANCE),
                                             schema.ref_operators(s), "all"), path, ["operator", "technology"])
    return path


register("prepared_features", "SELECT operator, technology, feature FROM (" + _features_sql(750.0, "") + ") WHERE " + " OR ".join(
    f"(operator = '{o}' AND technology = '{k}')" for o, k in _WANTED))(
    lambda s, d: LD.prepared_features(s, _prepared(s, d), _WANTED))


@lru_cache(maxsize=16)
def _loaded_railway(s, d: str) -> tuple[DataFrame, DataFrame]:
    t = _t(s, d)
    parted = t.line_vertices.withColumn("part", F.expr("CASE WHEN feature % 3 = 0 AND seq >= 23 THEN 1 ELSE 0 END"))
    names = t.line_vertices.select("line_id", "feature").distinct().select(
        "line_id", "feature", F.lit("").alias("line_name"), F.lit(0.0).alias("length_km"))
    routes = RL.route_geojson(parted, names).join(names.select("line_id", "feature"), "line_id")
    at = t.stations.select("*", E.round_half("longitude", 7).alias("lon"), E.round_half("latitude", 7).alias("lat"))
    paths = stage_path(s, "line-files"), stage_path(s, "station-files")
    for text, path in zip((FX.line_feature_texts(routes), FX.station_feature_texts(at)), paths):
        sinks.write_features(text, path, ["folder"])
    return LD.railway_load(*paths, s)


_KEPT_STATIONS = f"""
, kept AS (
  SELECT station_id, station_name, line_code, CASE WHEN k % 5 = 0 THEN 'None' ELSE commune END AS commune,
         CASE WHEN k % 6 = 0 THEN '' ELSE department END AS department, lat AS latitude, lon AS longitude
  FROM (SELECT *, CAST(station_id AS BIGINT) AS k, {R('latitude', 7)} AS lat, {R('longitude', 7)} AS lon FROM stations)
  WHERE k % 9 <> 0 AND k % 14 <> 0 AND k % 10 <> 0 AND k % 12 <> 0 AND lat BETWEEN 41 AND 52 AND lon BETWEEN -6 AND 10)
"""
register("station_load", W("stations") + _KEPT_STATIONS + "SELECT *, true AS dated FROM kept")(
    lambda s, d: _loaded_railway(s, d)[1].withColumn("dated", F.col("ingested_at").isNotNull()).drop("ingested_at"))

_LX, _LY = sql_lambert_xy("lon", "lat")
register("line_load", W("line_vertices", "stations") + _KEPT_STATIONS + f"""
, ll AS (SELECT CASE WHEN feature % 13 = 0 THEN '' ELSE line_id END AS line_id, feature, seq,
                CASE WHEN feature % 3 = 0 AND seq >= 23 THEN 1 ELSE 0 END AS part, {R(_LON, 7)} AS lon, {R(_LAT, 7)} AS lat
         FROM line_vertices WHERE feature % 7 <> 0 AND feature % 11 <> 0),
xy AS (SELECT *, {_LX} AS x, {_LY} AS y FROM ll),
sg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM xy WINDOW w AS (PARTITION BY feature, part ORDER BY seq)),
l AS (SELECT line_id, feature, max(part) + 1 AS parts, COUNT(*) AS vertices,
             {sql_fixed_sum('sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))', 6)} / 1000.0 AS length_km
      FROM sg GROUP BY line_id, feature),
names AS (SELECT line_code AS line_id, min(station_name) || ' — ' || max(station_name) AS label
          FROM kept WHERE station_name <> '' GROUP BY line_code HAVING COUNT(DISTINCT station_name) >= 2)
SELECT l.line_id, coalesce(n.label, '') AS line_name, CAST(parts AS BIGINT) AS parts, vertices, {R('length_km', 3)} AS length_km,
       true AS dated
FROM (SELECT *, unnest(range(CASE WHEN feature % 17 = 0 THEN 2 ELSE 1 END)) AS again FROM l) l LEFT JOIN names n USING (line_id)""")(
    lambda s, d: _loaded_railway(s, d)[0].select(
        "line_id", "line_name", "parts", "vertices", E.round_half("length_km", 3).alias("length_km"),
        F.col("ingested_at").isNotNull().alias("dated")))
