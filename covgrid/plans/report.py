"""Summary reports: coverage stats, data summary, table counts, load checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.functions import expr as E


def coverage_stats(coverage: DataFrame, operators: DataFrame, technology: str = "4G") -> DataFrame:
    """Geometry count by operator, name, technology, quarter; unknown
    operators are kept (left join to the dimension)."""
    names = operators.select(F.col("code").alias("operator_code"), F.col("name").alias("operator_name"))
    return (
        coverage.filter(F.col("technology") == technology).select("operator_code", "technology", "quarter")
        .join(names, "operator_code", "left")
        .groupBy("operator_code", "operator_name", "technology", "quarter")
        .agg(F.count(F.lit(1)).alias("geometry_count"))
        .select(F.col("operator_code").alias("operator"), "operator_name", "technology", "geometry_count", "quarter")
        .orderBy(F.asc_nulls_last("operator"), "quarter")
    )


def data_summary(coverage: DataFrame, sites: DataFrame) -> DataFrame:
    """Polygons by operator/technology/quarter, sites by operator/technology
    and the site total, as one long table (kind, operator, technology,
    quarter, cnt)."""
    cov = (coverage.groupBy(F.col("operator_code").alias("operator"), "technology", "quarter")
           .agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("coverage")))
    ant = (sites.groupBy("operator", "technology").agg(F.count(F.lit(1)).alias("cnt"))
           .withColumn("quarter", F.lit(None).cast("string")).withColumn("kind", F.lit("antennas")))
    tot = sites.agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit("antennas_total").alias("kind"), F.lit(None).cast("string").alias("operator"),
        F.lit(None).cast("string").alias("technology"), F.lit(None).cast("string").alias("quarter"), "cnt")
    cols = ["kind", "operator", "technology", "quarter", "cnt"]
    return cov.select(cols).unionByName(ant.select(cols)).unionByName(tot.select(cols))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table, one job (a union of global counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def load_report(sites: DataFrame, lines: DataFrame, stations: DataFrame) -> DataFrame:
    """Load verification as (metric, value): site rows and distinct
    operators; line count, station count and summed km of lines (0 dp)."""
    def metric(df: DataFrame, name: str, agg) -> DataFrame:
        return df.agg(agg.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    return reduce(DataFrame.unionByName, [
        metric(sites, "site_rows", F.count(F.lit(1))),
        metric(sites, "operators", F.countDistinct("operator")),
        metric(lines, "lines", F.count(F.lit(1))),
        metric(lines, "total_km", E.round_half(F.sum("length_km"), 0)),
        metric(stations, "stations", F.count(F.lit(1))),
    ])


def dimension_lists(operators: DataFrame, technologies: DataFrame) -> DataFrame:
    """Operators ordered by name and technologies by generation, as one
    list (kind, position, code, label)."""
    from pyspark.sql import Window
    ops = operators.select(F.lit("operator").alias("kind"),
                           F.row_number().over(Window.orderBy("name", "code")).alias("position"),
                           "code", F.col("name").alias("label"))
    techs = technologies.select(F.lit("technology").alias("kind"),
                                F.row_number().over(Window.orderBy("generation", "code")).alias("position"),
                                "code", F.col("description").alias("label"))
    return ops.unionByName(techs).orderBy("kind", "position")


def seed_refs(existing: DataFrame, seed: DataFrame, key: str = "code") -> DataFrame:
    """Insert-or-ignore: the existing rows plus the seed rows whose key is
    not there yet (running it twice changes nothing)."""
    return existing.unionByName(seed.join(existing.select(key), key, "left_anti"))
