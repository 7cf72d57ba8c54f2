"""Commune mart: builder and the queries that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covgrid.functions import expr as E
from covgrid.operators.predicates import all_of, check_range


def mart_build(sites: DataFrame, quarter: str) -> DataFrame:
    """mart_coverage_by_commune from the antenna sites: antennas per commune
    x operator x technology.  No population or commune outline is ingested,
    so coverage_pct and the population columns stay null."""
    return (
        sites.filter(F.col("commune_code").isNotNull())
        .groupBy("commune_code", "commune_name", "department_code", "operator", "technology")
        .agg(F.count(F.lit(1)).cast("int").alias("antenna_count"))
        .select("commune_code", "commune_name", "department_code",
                F.col("operator").alias("operator_code"), "technology",
                F.lit(quarter).alias("quarter"),
                F.lit(None).cast("double").alias("coverage_pct"),
                F.lit(None).cast("int").alias("population_covered"),
                F.lit(None).cast("int").alias("total_population"),
                "antenna_count")
    )


def commune_coverage(mart: DataFrame, commune_code: str, technology: str = "4G") -> DataFrame:
    return (
        mart.filter((F.col("commune_code") == commune_code) & (F.col("technology") == technology))
        .select("commune_code", "commune_name", F.col("operator_code").alias("operator"), "technology",
                "coverage_pct", "antenna_count", F.col("total_population").alias("population"))
        .orderBy(F.desc_nulls_last("coverage_pct"), "operator")
    )


def top_communes(mart: DataFrame, department_code: str | None = None, limit: int = 10) -> DataFrame:
    """Communes with the most antennas over all technologies and quarters."""
    check_range("limit", limit, 1, 50)
    return (
        mart.filter(all_of(department_code=department_code))
        .groupBy("commune_code", "commune_name", "department_code")
        .agg(F.sum("antenna_count").cast("long").alias("total"))
        .withColumn("label", F.coalesce(
            F.concat("commune_name", F.lit(" ("), "department_code", F.lit(")")), "commune_code"))
        .orderBy(F.desc("total"), F.asc_nulls_last("commune_code")).limit(limit)
    )


def operator_ranking(mart: DataFrame, department_code: str, technology: str = "4G") -> DataFrame:
    """Operators of a department: mean coverage %, antennas, communes with
    coverage, rank and the gap between first and last mean."""
    per_op = (
        mart.filter((F.col("department_code") == department_code) & (F.col("technology") == technology))
        .groupBy("operator_code")
        .agg(E.round_half(F.avg("coverage_pct"), 1).alias("mean_coverage_pct"),
             F.sum("antenna_count").cast("long").alias("antennas"),
             F.countDistinct(F.when(F.col("coverage_pct") > 0, F.col("commune_code"))).alias("communes_covered"))
    )
    w_all = Window.partitionBy()  # bounded: one row per operator
    return per_op.select(
        F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_coverage_pct"), "operator_code")).alias("rank"),
        "operator_code", "mean_coverage_pct", "antennas", "communes_covered",
        E.round_half(F.max("mean_coverage_pct").over(w_all) - F.min("mean_coverage_pct").over(w_all), 1).alias("gap"),
    ).orderBy("rank")


def coverage_gaps(mart: DataFrame, commune_code: str, threshold: float = 80.0) -> DataFrame:
    """A commune's (operator, technology) rows under ``threshold`` percent,
    set against the mean of its department for the same pair."""
    commune = mart.filter(F.col("commune_code") == commune_code)
    dept_avg = (
        mart.join(commune.select("department_code").distinct(), "department_code", "left_semi")
        .groupBy("department_code", "operator_code", "technology")
        .agg(E.round_half(F.avg("coverage_pct"), 1).alias("department_mean_pct"))
    )
    return (
        commune.filter(F.col("coverage_pct") < threshold)
        .join(dept_avg, ["department_code", "operator_code", "technology"], "left")
        .select("commune_code", "operator_code", "technology", "coverage_pct", "department_mean_pct",
                E.round_half(F.col("coverage_pct") - F.col("department_mean_pct"), 1).alias("gap_vs_department"))
        .orderBy("technology", "operator_code")
    )


def least_covered(mart: DataFrame, department_code: str | None = None, technology: str = "4G",
                  limit: int = 10) -> DataFrame:
    """Communes with the lowest mean coverage for a technology."""
    return (
        mart.filter(all_of(department_code=department_code, technology=technology))
        .groupBy("commune_code", "commune_name")
        .agg(E.round_half(F.avg("coverage_pct"), 1).alias("mean_coverage_pct"))
        .orderBy(F.asc_nulls_last("mean_coverage_pct"), "commune_code").limit(limit)
    )


def contract_checks(mart: DataFrame) -> DataFrame:
    """Result-contract violations: coverage_pct outside 0..100, missing
    required fields (commune, operator, technology)."""
    return mart.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count(F.when((F.col("coverage_pct") < 0) | (F.col("coverage_pct") > 100), 1)).alias("pct_out_of_range"),
        F.count(F.when(F.col("commune_code").isNull() | F.col("operator_code").isNull()
                       | F.col("technology").isNull(), 1)).alias("missing_required"),
    )
