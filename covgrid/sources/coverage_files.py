"""Coverage source files: naming, operator code mapping, GeoPackage reading
and the idempotent partitioned load.

Reading is a two-stage Spark job.  Stage 1 maps each file to row-id
chunks (one small SQLite query per file); the chunks are shuffled over all
tasks and stage 2 parses each chunk's geometries (GeoPackage binary header
+ WKB) into the nested ring form with numpy inside Arrow batches.  A file
of any size is therefore read by many tasks, and no geometry passes
through the driver.  Files must sit on storage every executor can read.
"""

from __future__ import annotations

import sqlite3
import struct
from itertools import groupby
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covgrid import schema
from covgrid.session import ship_package, task_slots
from covgrid.sources.sinks import write_table

CHUNK_ROWS = 16  # geometries per read task unit (a national polygon can hold 300k points)

# --- fixed values: GeoPackage binary header envelope sizes by indicator ----
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
SRS = 2154  # Lambert-93
# --------------------------------------------------------------------------


def source_files(spark: SparkSession, quarters: list[str], technologies: list[str],
                 root: str = "") -> DataFrame:
    """Expected source files for every quarter x operator x technology:
    (quarter, operator_code, file_code, technology, source_file, path)."""
    ops = schema.operator_codes(spark)
    grid = (ops.withColumn("quarter", F.explode(F.array(*[F.lit(x) for x in quarters])))
               .withColumn("technology", F.explode(F.array(*[F.lit(x) for x in technologies]))))
    name = F.format_string(schema.COVERAGE_FILE_PATTERN, "quarter", "file_code", "technology")
    return grid.select("quarter", "operator_code", "file_code", "technology", name.alias("source_file"),
                       F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("quarter"),
                                F.lit("/"), name).alias("path"))


# ------------------------------------------------------------------ parsing
def _wkb_polygons(buf: memoryview, pos: int, out: list) -> int:
    """Append (part, ring, xs, ys) for a WKB Polygon or MultiPolygon starting
    at ``pos``; returns the position after it."""
    order = "<" if buf[pos] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", buf, pos + 1)
    pos += 5
    has_z = bool(code & 0x80000000) or (code % 10000) // 1000 in (1, 3)
    has_m = bool(code & 0x40000000) or (code % 10000) // 1000 in (2, 3)
    base = (code & 0x0FFFFFFF) % 1000
    dims = 2 + has_z + has_m
    if base == 3:
        part = out[-1][0] + 1 if out else 0
        (nrings,) = struct.unpack_from(order + "I", buf, pos)
        pos += 4
        for r in range(nrings):
            (n,) = struct.unpack_from(order + "I", buf, pos)
            pos += 4
            pts = np.frombuffer(buf, dtype=np.dtype(order + "f8"), count=n * dims, offset=pos).reshape(n, dims)
            pos += 8 * n * dims
            out.append((part, r, pts[:, 0].copy(), pts[:, 1].copy()))
        return pos
    if base == 6:
        (npoly,) = struct.unpack_from(order + "I", buf, pos)
        pos += 4
        for _ in range(npoly):
            pos = _wkb_polygons(buf, pos, out)
        return pos
    raise ValueError(f"unsupported WKB geometry type {code}")


def gpkg_rings(blob: bytes) -> list:
    """Rings of a GeoPackage geometry blob: [(part, ring, xs, ys)]."""
    buf = memoryview(blob)
    if bytes(buf[:2]) != b"GP":
        raise ValueError("not a GeoPackage geometry")
    env = (buf[3] >> 1) & 0x07
    out: list = []
    _wkb_polygons(buf, 8 + ENVELOPE_BYTES[env], out)
    return out


def gpkg_blob(rings: list) -> bytes:
    """A GeoPackage blob of the rings [(part, ring, n x 2 points)], which are in order."""
    points = [p for _, _, p in rings if len(p)]
    box = np.concatenate(points) if points else None
    head = b"GP" + bytes([0, 1 | (2 if box is not None else 16)]) + struct.pack("<i", SRS)
    if box is not None:
        head += struct.pack("<4d", box[:, 0].min(), box[:, 0].max(), box[:, 1].min(), box[:, 1].max())
    parts = [list(group) for _, group in groupby(rings, key=lambda r: r[0])]
    body = [struct.pack("<BII", 1, 6, len(parts))]
    for part in parts:
        body.append(struct.pack("<BII", 1, 3, len(part)))
        for _, _, p in part:
            body += [struct.pack("<I", len(p)), np.ascontiguousarray(p, "<f8").tobytes()]
    return head + b"".join(body)


def _ring_column(geoms: list) -> pa.Array:
    """Arrow column of geometries given as lists of (part, ring, xs, ys)."""
    ring_off, pt_off, parts, ring_ids, xs, ys = [0], [0], [], [], [], []
    for g in geoms:
        for part, ring, x, y in g:
            parts.append(part)
            ring_ids.append(ring)
            xs.append(x)
            ys.append(y)
            pt_off.append(pt_off[-1] + len(x))
        ring_off.append(ring_off[-1] + len(g))
    cx = np.concatenate(xs) if xs else np.zeros(0)
    cy = np.concatenate(ys) if ys else np.zeros(0)
    pts = pa.ListArray.from_arrays(pa.array(pt_off, pa.int32()),
                                   pa.StructArray.from_arrays([pa.array(cx), pa.array(cy)], ["x", "y"]))
    rings = pa.StructArray.from_arrays([pa.array(parts, pa.int32()), pa.array(ring_ids, pa.int32()), pts],
                                       ["part", "ring", "pts"])
    return pa.ListArray.from_arrays(pa.array(ring_off, pa.int32()), rings)


def _ring_rows(column: pa.Array):
    """Per row of a ``rings`` column the list of (part, ring, n x 2 points)."""
    part, ring, pts = column.flatten().flatten()
    x, y = (c.to_numpy(zero_copy_only=False) for c in pts.flatten().flatten())
    part, ring = part.to_numpy(), ring.to_numpy()
    stops = np.cumsum(pc.list_value_length(pts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    for n in pc.list_value_length(column).fill_null(0).to_pylist():
        yield [(part[i], ring[i], np.stack([x[a:stops[i]], y[a:stops[i]]], 1))
               for i in range(at, at + n) for a in (stops[i - 1] if i else 0,)]
        at += n


def _open(path: str) -> sqlite3.Connection:
    """Read-only SQLite connection; accepts plain paths and file: URIs (as
    Spark's file sources report them).  Other schemes need a POSIX mount."""
    local = unquote(urlparse(path).path) if path.startswith("file:") else path
    return sqlite3.connect(f"file:{local}?mode=ro", uri=True)


def _feature_table(con: sqlite3.Connection, path: str) -> tuple[str, str]:
    """The one layer of a file; a file of several layers is refused, not read in part."""
    layers = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1, 2").fetchall()
    if len(layers) != 1:
        raise ValueError(f"{path} holds {len(layers)} layers, not one: {[name for name, _ in layers]}")
    return layers[0]


def _chunk_files(batches):
    for b in batches:
        rows = b.to_pylist()
        out = {"path": [], "lo": [], "hi": []}
        for r in rows:
            con = _open(r["path"])
            try:
                table, _ = _feature_table(con, r["path"])
                lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
            finally:
                con.close()
            if lo is None:
                continue
            for start in range(lo, hi + 1, CHUNK_ROWS):
                out["path"].append(r["path"])
                out["lo"].append(start)
                out["hi"].append(min(hi, start + CHUNK_ROWS - 1))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("lo", pa.int64()),
                                                                ("hi", pa.int64())]))


def _read_chunks(batches):
    for b in batches:
        for r in b.to_pylist():  # one chunk at a time: geometries are large
            fids, paths, geoms = [], [], []
            con = _open(r["path"])
            try:
                table, column = _feature_table(con, r["path"])
                cur = con.execute(f'SELECT rowid, "{column}" FROM "{table}" WHERE rowid BETWEEN ? AND ? '
                                  f'ORDER BY rowid', (r["lo"], r["hi"]))
                for fid, blob in cur:
                    fids.append(fid)
                    paths.append(r["path"])
                    geoms.append(gpkg_rings(blob) if blob is not None else [])
            finally:
                con.close()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(fids, pa.int64()), _ring_column(geoms)],
                                             names=["path", "fid", "rings"])


def parse_blobs(rows: DataFrame, blob: str = "geom") -> DataFrame:
    """``rows`` with the column of geometry blobs replaced by ``rings``: for
    coverage delivered as a table instead of files.  A null blob has no rings."""
    ship_package(rows.sparkSession)
    others = [f for f in rows.schema.fields if f.name != blob]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(blob)
            for lo in range(0, b.num_rows, CHUNK_ROWS):  # geometries are large
                part = b.slice(lo, CHUNK_ROWS)
                geoms = [gpkg_rings(v.as_py()) if v.is_valid else [] for v in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(b.num_columns) if i != at] + [_ring_column(geoms)],
                    names=[f.name for f in others] + ["rings"])

    return rows.mapInArrow(run, T.StructType([*others, schema.COVERAGE_SCHEMA["rings"]]))


def encode_blobs(coverage: DataFrame, blob: str = "geom") -> DataFrame:
    """The reverse of ``parse_blobs``: ``rings`` as GeoPackage geometry blobs
    (little-endian MultiPolygon, Lambert-93, box in the header)."""
    ship_package(coverage.sparkSession)
    others = [f for f in coverage.schema.fields if f.name != "rings"]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("rings")
            blobs = [gpkg_blob(geometry) for geometry in _ring_rows(b.column(at))]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns) if i != at] + [pa.array(blobs, pa.binary())],
                names=[f.name for f in others] + [blob])

    return coverage.mapInArrow(run, T.StructType([*others, T.StructField(blob, T.BinaryType())]))


def read_geopackages(files: DataFrame) -> DataFrame:
    """Coverage rows from GeoPackage files.

    files: path, quarter, operator_code, technology, source_file
    returns raw_coverage rows (id, quarter, operator_code, technology,
    usage, rings, source_file); id is a stable hash of (source_file, fid)."""
    ship_package(files.sparkSession)
    chunks = files.select("path").mapInArrow(_chunk_files, "path string, lo long, hi long")
    n = task_slots(files.sparkSession)
    geoms = chunks.repartition(n).mapInArrow(
        _read_chunks,
        "path string, fid long, rings array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>")
    return (geoms.join(files, "path")
            .select(F.xxhash64("source_file", "fid").alias("id"), "quarter", "operator_code", "technology",
                    F.lit("data").alias("usage"), "rings", "source_file"))


def load_coverage(coverage: DataFrame, table_path: str, files: DataFrame | None = None) -> DataFrame:
    """Write coverage rows partitioned by quarter / technology / operator /
    source file, replacing only the files being loaded (a reload does not
    duplicate rows, another file of the same quarter, technology and operator
    stays), and return the geometry count per source file.  ``files`` names
    the files being loaded; without it they are read off the rows once more.
    ``ingested_at`` is the time of the load."""
    write_table(coverage.withColumn("ingested_at", F.current_timestamp()), table_path, ["quarter", "technology", "operator_code", "source_file"])
    loaded = coverage.sparkSession.read.parquet(table_path)
    files = (coverage if files is None else files).select("source_file").distinct()
    return loaded.join(files, "source_file", "left_semi").groupBy("source_file").agg(
        F.count(F.lit(1)).alias("geometry_count"))
