import pytest
from pyspark.sql import functions as F

from covgrid.functions import expr as E


def test_forward_paris(spark):
    x, y = E.lambert_xy(F.lit(2.3522), F.lit(48.8566))
    (r,) = spark.range(1).select(x.alias("x"), y.alias("y")).collect()
    assert r["x"] == pytest.approx(652469.0227, abs=1e-3)
    assert r["y"] == pytest.approx(6862035.2594, abs=1e-3)


def test_round_trip(spark):
    df = spark.createDataFrame([(lat / 2.0, lon / 2.0) for lat in range(82, 105, 3) for lon in range(-12, 21, 4)],
                               "lat double, lon double")
    x, y = E.lambert_xy("lon", "lat")
    p = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lon2, lat2 = E.lambert_lonlat("x", "y")
    err = p.select(F.max(F.greatest(F.abs(lon2 - F.col("lon")), F.abs(lat2 - F.col("lat")))).alias("e")).first()["e"]
    assert err < 1e-9


def test_round_half_ieee(spark):
    r = spark.range(1).select(E.round_half(F.lit(1.005), 2).alias("a"), E.round_half(F.lit(0.285), 2).alias("b"),
                              E.round_half(F.lit(-2.5), 0).alias("c"), E.round_half(F.lit(2.25), 1).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1.0, 0.28, -3.0, 2.3)


def test_sql_twins_match_duckdb(spark):
    import duckdb
    lx, ly = E.sql_lambert_xy("2.3522", "48.8566")
    got = duckdb.sql(f"SELECT {lx}, {ly}").fetchall()[0]
    assert got == pytest.approx((652469.0227, 6862035.2594), abs=1e-3)
    assert duckdb.sql(f"SELECT {E.sql_round_half('1.005', 2)}").fetchall()[0][0] == 1.0
