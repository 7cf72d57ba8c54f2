"""Scalar column expressions: rounding, projections, distances, grid keys.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen.  Each Spark helper has a twin that renders the same arithmetic as
SQL text; tests and oracle queries use the twins so both engines perform the
same IEEE steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Lambert-93 (EPSG:2154) on GRS80 -------------------------
LAMBERT_E = 0.08181919104281579
LAMBERT_N = 0.7256077650532683
LAMBERT_C = 11754255.426096007
LAMBERT_XS = 700000.0
LAMBERT_YS = 12655612.049875993
LAMBERT_LON0 = 3.0
# Degrees per km in the reference's planar distance approximation.
KM_PER_DEGREE = 111.0
# --------------------------------------------------------------------------

INVERSE_ITERATIONS = 6


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_half(x, k: int) -> Column:
    """Round half away from zero at ``k`` decimals in plain IEEE steps.

    Spark's ``round`` goes through BigDecimal and disagrees with C-style
    rounding on binary ties (1.005 -> 1.01 vs 1.0); this form is the same
    in every engine: sign(x) * floor(|x| * 10^k + 0.5) / 10^k.
    """
    x = _c(x)
    p = float(10 ** k)
    mag = F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)
    return F.when(x < 0, -mag).otherwise(mag)


def sql_round_half(expr: str, k: int) -> str:
    p = f"CAST({10 ** k} AS DOUBLE)"
    mag = f"(CAST(floor(abs({expr}) * {p} + 0.5) AS DOUBLE) / {p})"
    return f"(CASE WHEN ({expr}) < 0 THEN -{mag} ELSE {mag} END)"


def _spark_num(v: float) -> str:
    return f"{float(v)!r}D"


def lambert_xy(lon, lat) -> tuple[Column, Column]:
    """Forward Lambert-93: degrees -> metres, as two columns.  SQL-text
    inputs (column names, literals) build one SQL expression each, a single
    call to the JVM; Column inputs (e.g. lambda variables) build Columns."""
    if isinstance(lon, str) and isinstance(lat, str):
        x, y = sql_lambert_xy(lon, lat, _spark_num)
        return F.expr(x), F.expr(y)
    phi = F.radians(_c(lat))
    s = F.sin(phi)
    q = F.atanh(s) - F.lit(LAMBERT_E) * F.atanh(F.lit(LAMBERT_E) * s)
    r = F.lit(LAMBERT_C) * F.exp(F.lit(-LAMBERT_N) * q)
    g = F.lit(LAMBERT_N) * F.radians(_c(lon) - F.lit(LAMBERT_LON0))
    return F.lit(LAMBERT_XS) + r * F.sin(g), F.lit(LAMBERT_YS) - r * F.cos(g)


def sql_lambert_xy(lon: str, lat: str, num=repr) -> tuple[str, str]:
    e, n, c = num(LAMBERT_E), num(LAMBERT_N), num(LAMBERT_C)
    s = f"sin(radians({lat}))"
    q = f"(atanh({s}) - {e} * atanh({e} * {s}))"
    r = f"({c} * exp(-{n} * {q}))"
    g = f"({n} * radians({lon} - {num(LAMBERT_LON0)}))"
    return f"({num(LAMBERT_XS)} + {r} * sin({g}))", f"({num(LAMBERT_YS)} - {r} * cos({g}))"


def lambert_lonlat(x, y) -> tuple[Column, Column]:
    """Inverse Lambert-93: metres -> degrees, fixed-point iteration unrolled
    (SQL-text inputs build one SQL expression each, as in ``lambert_xy``)."""
    if isinstance(x, str) and isinstance(y, str):
        lon, lat = sql_lambert_lonlat(x, y, _spark_num)
        return F.expr(lon), F.expr(lat)
    dx = _c(x) - F.lit(LAMBERT_XS)
    dy = F.lit(LAMBERT_YS) - _c(y)
    r = F.sqrt(dx * dx + dy * dy)
    lon = F.lit(LAMBERT_LON0) + F.degrees(F.atan2(dx, dy) / F.lit(LAMBERT_N))
    big_l = -F.log(r / F.lit(LAMBERT_C)) / F.lit(LAMBERT_N)
    phi = F.lit(2.0) * F.atan(F.exp(big_l)) - F.lit(math.pi / 2)
    for _ in range(INVERSE_ITERATIONS):
        phi = F.lit(2.0) * F.atan(
            F.exp(big_l + F.lit(LAMBERT_E) * F.atanh(F.lit(LAMBERT_E) * F.sin(phi)))
        ) - F.lit(math.pi / 2)
    return lon, F.degrees(phi)


def sql_lambert_lonlat(x: str, y: str, num=repr) -> tuple[str, str]:
    e, n, c = num(LAMBERT_E), num(LAMBERT_N), num(LAMBERT_C)
    dx = f"({x} - {num(LAMBERT_XS)})"
    dy = f"({num(LAMBERT_YS)} - {y})"
    r = f"sqrt({dx} * {dx} + {dy} * {dy})"
    lon = f"({num(LAMBERT_LON0)} + degrees(atan2({dx}, {dy}) / {n}))"
    big_l = f"(-ln({r} / {c}) / {n})"
    two, half_pi = num(2.0), num(math.pi / 2)
    phi = f"({two} * atan(exp({big_l})) - {half_pi})"
    for _ in range(INVERSE_ITERATIONS):
        phi = f"({two} * atan(exp({big_l} + {e} * atanh({e} * sin({phi})))) - {half_pi})"
    return lon, f"degrees({phi})"


def planar_km(lat, lon, lat0: float, lon0: float) -> Column:
    """Distance in km on the reference's flat approximation (111 km/degree,
    longitude scaled by cos of the query latitude)."""
    dlat = _c(lat) - F.lit(float(lat0))
    dlon = (_c(lon) - F.lit(float(lon0))) * F.lit(math.cos(math.radians(lat0)))
    return F.lit(KM_PER_DEGREE) * F.sqrt(dlat * dlat + dlon * dlon)


def sql_planar_km(lat: str, lon: str, lat0: float, lon0: float) -> str:
    c = repr(math.cos(math.radians(lat0)))
    return (f"({KM_PER_DEGREE!r} * sqrt(({lat} - {float(lat0)!r}) * ({lat} - {float(lat0)!r}) + "
            f"(({lon} - {float(lon0)!r}) * {c}) * (({lon} - {float(lon0)!r}) * {c})))")


def seg_len(x1, y1, x2, y2) -> Column:
    dx = _c(x2) - _c(x1)
    dy = _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def cell(v, size: float) -> Column:
    return F.floor(_c(v) / F.lit(float(size))).cast("long")


def z_order(cx, cy) -> Column:
    """Place of a grid cell on the Z-shaped curve: the bits of both indices (16
    each, counted from -32768) alternate, so cells near each other on the curve
    are near each other on the map."""
    def spaced(v):
        v = F.pmod(_c(v) + F.lit(1 << 15), F.lit(1 << 16)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v
    return spaced(cx).bitwiseOR(F.shiftleft(spaced(cy), 1))


def cell_range(lo, hi, size: float) -> Column:
    """Array of grid indices covering [lo, hi]."""
    return F.sequence(cell(lo, size), cell(hi, size))


def fold_sum(arr: Column) -> Column:
    """Left fold sum of a double array: a fixed summation order, so the
    result does not depend on partitioning."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def web_mercator_tile(lon, lat, zoom) -> tuple[Column, Column]:
    """Slippy-map tile address at integer zoom (256-px tiles)."""
    n = F.pow(F.lit(2.0), _c(zoom).cast("double"))
    x = (_c(lon) + F.lit(180.0)) / F.lit(360.0) * n
    lat_r = F.radians(_c(lat))
    y = (F.lit(1.0) - F.log(F.tan(lat_r) + F.lit(1.0) / F.cos(lat_r)) / F.lit(math.pi)) / F.lit(2.0) * n
    return x, y


def fixed_sum(x, scale: int) -> Column:
    """Sum of ``x`` rounded to ``10^-scale`` units as exact integers, returned
    as a double: the same value whatever order rows reach the aggregate (a
    double sum differs in its last bits), with ordinary partial
    aggregation.  The sum is a decimal of 38 digits, so it does not overflow."""
    p = float(10 ** scale)
    units = F.floor(_c(x) * F.lit(p) + F.lit(0.5)).cast("long").cast("decimal(28,0)")
    return F.sum(units).cast("double") / F.lit(p)


def sql_fixed_sum(x: str, scale: int) -> str:
    p = f"CAST({10 ** scale} AS DOUBLE)"
    return f"(CAST(SUM(CAST(CAST(floor({x} * {p} + 0.5) AS BIGINT) AS DECIMAL(28,0))) AS DOUBLE) / {p})"


def mean_exact(x, scale: int = 9) -> Column:
    """Mean through an exact fixed-point sum (see ``fixed_sum``), so that
    rounding the mean afterwards does not flip on summation order."""
    return fixed_sum(x, scale) / F.count(_c(x))


def sql_mean_exact(x: str, scale: int = 9) -> str:
    return f"({sql_fixed_sum(x, scale)} / COUNT({x}))"
