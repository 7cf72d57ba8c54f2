"""What the loads left behind: coverage by source file, lines and stations by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.operators import geometry as G
from covgrid.sources import coverage_files as CF
from covgrid.sources import geojson as GJ
from covgrid.sources.sinks import read_features_or_empty


def coverage_load(table: DataFrame) -> DataFrame:
    """Per source file of a loaded coverage table: geometries, rings, points, covered
    square metres (shells less holes, exact for whole coordinates) and whether
    every row carries its time of load."""
    part = ["quarter", "technology", "operator_code", "source_file"]
    rows = table.groupBy(*part).agg(
        F.count(F.lit(1)).alias("geometry_count"), F.sum(F.size("rings")).cast("long").alias("rings"),
        F.bool_and(F.col("ingested_at").isNotNull()).alias("dated"))
    # twice the area by edges; an edge row is small, so a large ring is spread
    twice = (G.edges(G.rings(table, *part)).groupBy("id", *part, "part", "ring")
             .agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).cast("decimal(28,0)")).alias("a"),
                  F.count(F.lit(1)).alias("n")))
    area = F.when(F.col("ring") == 0, F.abs("a")).otherwise(-F.abs("a"))
    sums = twice.groupBy(*part).agg((F.sum(area) / 2).cast("long").alias("area_m2"),
                                    F.sum(F.col("n") + 1).cast("long").alias("points"))
    return rows.join(sums, part, "left").select(
        *part, "geometry_count", "rings", F.coalesce("points", F.lit(0)).cast("long").alias("points"),
        F.coalesce("area_m2", F.lit(0)).cast("long").alias("area_m2"), "dated")


def load_twice(delivery: DataFrame, again: DataFrame, table_path: str) -> DataFrame:
    """Load a delivery of geometry blobs, then the files of ``again`` once more, and
    read the table back.  The second load replaces its own files only."""
    for rows in (delivery, again):
        CF.load_coverage(CF.parse_blobs(rows), table_path, rows.select("source_file"))
    return delivery.sparkSession.read.parquet(table_path)


def prepared_features(spark, path: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """The prepared features of some (operator, technology), one folder each; one that was
    never prepared adds no row."""
    out = None
    for operator, technology in wanted:
        rows = read_features_or_empty(spark, path, operator=operator, technology=technology).select(
            F.lit(operator).alias("operator"), F.lit(technology).alias("technology"), "feature")
        out = rows if out is None else out.unionByName(rows)
    return out


def railway_load(lines_path: str, stations_path: str, spark) -> tuple[DataFrame, DataFrame]:
    """Lines and stations read from newline-delimited features: (lines with their names,
    parts, vertices and length; stations)."""
    stations = GJ.station_features(GJ.read_features(spark, stations_path, seq=True))
    lines, vertices = GJ.line_features(GJ.read_features(spark, lines_path, seq=True))
    size = vertices.groupBy("line_id", "feature").agg(
        (F.max("part") + 1).cast("long").alias("parts"), F.count(F.lit(1)).alias("vertices"))
    return GJ.named_lines(lines, stations).join(size, ["line_id", "feature"], "left"), stations
