"""Writers: partitioned Parquet tables, GeoJSON feature lines, CSV exports.

Every writer is a distributed Spark write (one file per task), never a
driver-side collect; ``partitionBy`` gives readers partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.functions import expr as E
from covgrid.operators import geometry as G


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet table; with ``partition_by`` and overwrite mode only the
    partitions present in ``df`` are replaced (dynamic overwrite), so
    reloading one source file is idempotent."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_clustered_coverage(coverage: DataFrame, path: str, files: int, cell: float = 20_000.0) -> None:
    """Coverage with stored box columns, one folder per technology, its rows dealt to
    about ``files`` files by ranges of the Z-order curve of their box centres.  The
    Parquet statistics of a file (and of each row group, rows being sorted within
    it) then cover a small area, so a filter on the box columns skips the others."""
    boxed = coverage.select("*", *G.geometry_bbox("rings"))
    curve = E.z_order(E.cell((F.col("bbox_xmin") + F.col("bbox_xmax")) / 2, cell),
                      E.cell((F.col("bbox_ymin") + F.col("bbox_ymax")) / 2, cell))
    (boxed.withColumn("curve", curve).repartitionByRange(files, "technology", "curve")
     .sortWithinPartitions("technology", "curve")
     .write.mode("overwrite").partitionBy("technology").parquet(path))


def write_features(features: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """GeoJSON features, one per line (GeoJSON text sequence), optionally
    one folder per partition value (e.g. operator / technology)."""
    cols = [F.col("feature").alias("value")] + [F.col(c) for c in (partition_by or [])]
    w = features.select(*cols).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line per file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_features_or_empty(spark, path: str, **partition) -> DataFrame:
    """Prepared GeoJSON features for one partition; an absent partition
    gives an empty result instead of an error."""
    sub = "/".join(f"{k}={v}" for k, v in partition.items())
    full = f"{path.rstrip('/')}/{sub}" if sub else path
    try:
        return spark.read.text(full).select(F.col("value").alias("feature"))
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], "feature string")
        raise
