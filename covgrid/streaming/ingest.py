"""Incremental ingestion with Structured Streaming.

The reference appends each coverage file as it is loaded.  Here newly
landed GeoPackage files are picked up by a file-source stream (only the
path column is read, so file contents never pass through the stream
itself); each micro-batch parses its files with the distributed reader
and replaces the (quarter, technology, operator) partitions they belong
to.  The sink is idempotent, so a batch replayed after a failure gives the
same table, and the stream's progress lives in the shared checkpoint
folder.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covgrid import schema
from covgrid.session import ensure_checkpoint_dir
from covgrid.sources import coverage_files as CF
from covgrid.streaming import derived as DV

LOG = logging.getLogger(__name__)

# --- fixed values: coverage file name layout --------------------------------
FILE_NAME_RE = r"^(\d{4}_T\d)_couv_Metropole_([A-Z0-9]+)_(\dG)_data\.gpkg$"
# ------------------------------------------------------------------------------


def landed_files(paths: DataFrame, operator_codes: DataFrame) -> DataFrame:
    """(path, quarter, operator_code, technology, source_file) from file
    paths; names not following the layout are left out (see ``left_out``), an unknown operator
    keeps the code of its file name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    f = paths.select("path", name.alias("source_file"))
    f = f.select("path", "source_file",
                 F.regexp_extract("source_file", FILE_NAME_RE, 1).alias("quarter"),
                 F.regexp_extract("source_file", FILE_NAME_RE, 2).alias("file_code"),
                 F.regexp_extract("source_file", FILE_NAME_RE, 3).alias("technology")).filter(F.col("quarter") != "")
    codes = operator_codes.select("file_code", "operator_code")
    return f.join(codes, "file_code", "left").select(
        "path", "quarter", F.coalesce("operator_code", "file_code").alias("operator_code"), "technology", "source_file")


def left_out(paths: DataFrame) -> DataFrame:
    """The paths whose names do not follow the layout."""
    return paths.where(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(FILE_NAME_RE)).select("path")


def coverage_stream(spark: SparkSession, landing_dir: str, table_path: str, checkpoint: str | None = None,
                    available_now: bool = True, derived: tuple[str, str] | None = None):
    """Start the stream; returns the StreamingQuery.  With
    ``available_now`` it processes what has landed and stops.  ``derived`` names the paths of
    the simplified rows and of the counts that follow every batch (``streaming.derived``)."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/coverage-stream"
    paths = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "*.gpkg")
             .option("recursiveFileLookup", "true").load(landing_dir).select("path"))
    codes = schema.operator_codes(spark)

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        for r in left_out(batch).toLocalIterator():
            LOG.warning("not loaded, the name does not follow the layout: %s", r["path"])
        files = landed_files(batch, codes)
        if files.isEmpty():
            return
        CF.load_coverage(CF.read_geopackages(files), table_path, files)  # the write is done here
        if derived:
            DV.refresh(files, table_path, *derived)

    writer = paths.writeStream.foreachBatch(load_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def antenna_stats_stream(spark: SparkSession, sites_dir: str, query_name: str = "antenna_stats_live"):
    """Site counts by operator and technology kept up to date as site files
    land (streaming aggregation, complete output to an in-memory table)."""
    sites = spark.readStream.schema(schema.SITES_SCHEMA).parquet(sites_dir)
    counts = sites.groupBy("operator", "technology").agg(F.count(F.lit(1)).alias("site_count"))
    return (counts.writeStream.outputMode("complete").format("memory").queryName(query_name)
            .trigger(availableNow=True).start())
