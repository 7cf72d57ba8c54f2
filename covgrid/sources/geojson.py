"""GeoJSON readers for railway lines and stations.

A FeatureCollection document is not splittable, so each such file is read
by one task and its features are exploded and spread afterwards; for large
inputs prefer newline-delimited features (``seq=True``), which Spark splits
across tasks like any JSON-lines file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covgrid.functions import expr as E
from covgrid.operators import geometry as G

GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    # Raw JSON text: the nesting depends on the geometry type.
    T.StructField("coordinates", T.StringType()),
])
FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", GEOMETRY),
])
COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(FEATURE)),
])

POINT = T.ArrayType(T.DoubleType())
LINE = T.ArrayType(POINT)
MULTILINE = T.ArrayType(LINE)

# --- fixed values: filters of the reference loaders --------------------------
OPERATED_STATUS = "Exploitée"   # lines: `libelle` value kept
PASSENGER_FLAG = "O"            # stations: `voyageurs` value kept
METRO_LAT = (41.0, 52.0)        # stations kept inside this latitude range
METRO_LON = (-6.0, 10.0)        # and this longitude range
# ------------------------------------------------------------------------------

EQUAL_LINES = 4096  # equal lines of a sequence file numbered at a time


def read_features(spark: SparkSession, path: str, seq: bool = False) -> DataFrame:
    """Features with a key that is stable over evaluations and differs between
    files: (feature, properties, geometry).  In a collection the key is a hash
    of the file and the position in it; a line of a sequence file has no
    position, so its key is a hash of the file, of its content and of its number
    among equal lines of the file, which are counted before the shuffle."""
    if seq:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
        equal = lines.where(F.trim("value") != "").groupBy("file", "value").agg(F.count(F.lit(1)).alias("n"))
        # a line repeated very often is dealt out block by block, never as one array
        block = equal.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {EQUAL_LINES}"))).alias("b"))
        each = block.select("file", "value", F.explode(F.sequence(
            F.col("b") * EQUAL_LINES + 1, F.least("n", (F.col("b") + 1) * EQUAL_LINES))).alias("k"))
        key = F.when(F.col("k") == 1, F.xxhash64("file", "value")).otherwise(F.xxhash64("file", "value", "k"))
        return (each.select(key.alias("feature"), F.from_json("value", FEATURE).alias("f"))
                .select("feature", "f.properties", "f.geometry"))
    coll = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    f = coll.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("pos", "f"))
    return f.select(F.xxhash64("file", "pos").alias("feature"), "f.properties", "f.geometry")


def prop(name: str, col: str = "properties") -> Column:
    """A property as text the way Python's ``str(props.get(name, ''))``
    renders it: absent -> '', JSON null -> 'None'."""
    m = F.col(col)
    return F.when(F.map_contains_key(m, name), F.coalesce(m[name], F.lit("None"))).otherwise(F.lit(""))


def line_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operated railway lines: (lines, vertices).

    lines:    line_id, feature, line_name (''), length_km, ingested_at
    vertices: line_id, feature, part, seq, x, y   (Lambert-93 metres)
    Features without geometry or not operated are skipped; LineString and
    MultiLineString are both accepted."""
    f = features.filter(F.col("geometry").isNotNull() & (prop("libelle") == OPERATED_STATUS))
    coords = F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "MultiLineString", F.from_json(coords, MULTILINE))\
        .when(F.col("geometry.type") == "LineString", F.array(F.from_json(coords, LINE)))
    f = f.select(prop("code_ligne").alias("line_id"), "feature", parts.alias("parts")).filter(F.col("parts").isNotNull())
    p = f.select("line_id", "feature", F.posexplode("parts").alias("part", "pts"))
    v = p.select("line_id", "feature", "part", F.posexplode("pts").alias("seq", "c"))
    x, y = E.lambert_xy("c[0]", "c[1]")
    vertices = v.select("line_id", "feature", "part", "seq", x.alias("x"), y.alias("y"))
    lengths = G.line_lengths(G.segments(vertices, "merge"))
    lines = (f.select("line_id", "feature").join(lengths, ["line_id", "feature"], "left")
             .select("line_id", "feature", F.lit("").alias("line_name"),
                     F.coalesce("length_km", F.lit(0.0)).alias("length_km"),
                     F.current_timestamp().alias("ingested_at")))
    return lines, vertices


def station_features(features: DataFrame) -> DataFrame:
    """Passenger stations inside metropolitan France (ref_railway_stations)."""
    f = features.filter((F.col("geometry.type") == "Point") & (prop("voyageurs") == PASSENGER_FLAG))
    c = F.from_json("geometry.coordinates", POINT)
    f = f.select("*", c[0].alias("longitude"), c[1].alias("latitude"))
    f = f.filter(F.col("latitude").between(*METRO_LAT) & F.col("longitude").between(*METRO_LON))
    return f.select(prop("code_uic").alias("station_id"), prop("libelle").alias("station_name"),
                    prop("code_ligne").alias("line_code"), prop("commune").alias("commune"),
                    prop("departemen").alias("department"), "latitude", "longitude",
                    F.current_timestamp().alias("ingested_at"))


def named_lines(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """Set each line's name from its stations (update-from-join)."""
    return (lines.join(G.line_names(stations), "line_id", "left")
            .select("line_id", "feature", F.coalesce("label", "line_name").alias("line_name"), "length_km",
                    *[c for c in ("ingested_at",) if c in lines.columns]))
