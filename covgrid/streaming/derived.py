"""Derived tables kept up to date per loaded file.

After a batch of files is loaded, only the partitions they belong to are computed
again from the raw table and replaced: simplified rows per source file, counts per
quarter, technology and operator.  Replacing is idempotent, so a batch replayed
after a failure gives the same tables, which equal a full rebuild after every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.operators import geometry as G
from covgrid.plans.coverage import SIMPLIFY_TOLERANCE
from covgrid.sources.sinks import write_table

GROUP = ["quarter", "technology", "operator_code"]


def simplified_rows(raw: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """Simplified geometry and the box of the raw one, with the row's source file."""
    boxed = raw.select("id", *GROUP, "source_file", "rings", *G.geometry_bbox("rings"))
    return G.simplify_geometries(boxed, tolerance)


def group_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("geometry_count"),
                                   F.countDistinct("source_file").alias("files"))


def refresh(files: DataFrame, table_path: str, simplified_path: str, counts_path: str,
            tolerance: float = SIMPLIFY_TOLERANCE) -> None:
    """Bring both derived tables up to date with the loaded ``files`` (quarter, technology,
    operator_code, source_file).  The joins are on partition columns of the raw table, so
    its other partitions are not read."""
    raw = files.sparkSession.read.parquet(table_path)
    touched = files.select(*GROUP, "source_file").distinct()
    write_table(simplified_rows(raw.join(touched, [*GROUP, "source_file"], "left_semi"), tolerance), simplified_path,
                [*GROUP, "source_file"])
    write_table(group_counts(raw.join(touched.select(*GROUP).distinct(), GROUP, "left_semi")), counts_path, GROUP)
