"""Streaming ingestion of landed coverage files and live antenna counts."""

import glob
import os

from covgrid.schema import SITES_SCHEMA
from covgrid.streaming import derived, ingest
from test_sources import gpkg_blob, make_gpkg, sq, wkb_polygon


def test_coverage_stream_is_idempotent(spark, tmp_path):
    landing = tmp_path / "landing" / "2025_T3"
    landing.mkdir(parents=True)
    make_gpkg(str(landing / "2025_T3_couv_Metropole_BOUY_4G_data.gpkg"),
              [gpkg_blob(wkb_polygon([sq(i * 10.0, 0, 2)])) for i in range(5)])
    make_gpkg(str(landing / "2025_T3_couv_Metropole_SFR0_3G_data.gpkg"),
              [gpkg_blob(wkb_polygon([sq(0, i * 10.0, 2)])) for i in range(3)])
    (landing / "notes.gpkg").write_bytes(b"")  # name outside the layout: ignored
    table = str(tmp_path / "raw_coverage")
    q = ingest.coverage_stream(spark, str(tmp_path / "landing"), table, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    df = spark.read.parquet(table)
    got = {(r["operator_code"], r["technology"]): r["count"] for r in df.groupBy("operator_code", "technology").count().collect()}
    assert got == {("BYT", "4G"): 5, ("SFR", "3G"): 3}
    # restarting from the checkpoint with nothing new landed changes nothing
    q = ingest.coverage_stream(spark, str(tmp_path / "landing"), table, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 8


def test_antenna_stats_stream(spark, tmp_path):
    d = tmp_path / "sites"
    rows = [(i, "OF" if i % 2 else "SFR", 45.0, 2.0, "31003", "C", "31", "4G") for i in range(10)]
    spark.createDataFrame(rows, SITES_SCHEMA).write.parquet(str(d))
    q = ingest.antenna_stats_stream(spark, str(d), "live_counts_test")
    q.awaitTermination(120)
    got = {r["operator"]: r["site_count"] for r in spark.sql("SELECT * FROM live_counts_test").collect()}
    assert got == {"OF": 5, "SFR": 5}


def test_file_names_left_out_are_reported(spark):
    paths = spark.createDataFrame([("/x/2025_T3_couv_Metropole_BOUY_4G_data.gpkg",), ("/x/notes.gpkg",)], "path string")
    assert [r["path"] for r in ingest.left_out(paths).collect()] == ["/x/notes.gpkg"]


def test_derived_tables_follow_every_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table, stg, counts = (str(tmp_path / n) for n in ("raw", "stg", "counts"))

    def land(name, n, h):
        make_gpkg(str(landing / f"2025_T3_couv_Metropole_{name}_data.gpkg"),
                  [gpkg_blob(wkb_polygon([sq(i * 50_000.0, 0, h)])) for i in range(n)])

    def written(path):
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}

    def rows(df):
        return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())

    before = None
    for batch in ([("BOUY_4G", 4, 9_000.0), ("SFR0_3G", 3, 9_000.0)], [("BOUY_3G", 2, 8_000.0), ("OF_4G", 1, 10.0)], []):
        for file in batch:
            land(*file)
        ingest.coverage_stream(spark, str(landing), table, str(tmp_path / "ckpt"), derived=(stg, counts)).awaitTermination(180)
        raw = spark.read.parquet(table)
        assert rows(spark.read.parquet(stg)) == rows(derived.simplified_rows(raw))
        assert rows(spark.read.parquet(counts)) == rows(derived.group_counts(raw))
        now = {p: written(p) for p in (stg, counts)}
        for p in now if before else ():
            assert before[p].items() <= now[p].items()  # partitions of other files stay as they were
        before = now
    files = spark.read.parquet(table).select(*derived.GROUP, "source_file").distinct()
    derived.refresh(files, table, stg, counts)  # a replay
    assert rows(spark.read.parquet(stg)) == rows(derived.simplified_rows(spark.read.parquet(table)))
