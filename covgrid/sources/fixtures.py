"""Telecom and rail tables derived from the driver's generated tables.

The driver's data is a TPC-H-like star schema; the tables our queries need
(antenna sites, coverage polygons, railway lines and stations, the commune
mart) are derived from ``events``, ``part`` and ``supplier`` by integer
arithmetic, so every derived table grows with the scale factor.  The same
derivations exist as SQL text (``ORACLE_CTES``) for the oracle database.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sites(events: DataFrame) -> DataFrame:
    """raw_antenna_sites: one row per site x technology."""
    no_commune = "event_id % 50 = 0"
    dept = "lpad(CAST(user_id % 95 + 1 AS STRING), 2, '0')"
    return events.selectExpr(
        "event_id AS id",
        "CASE user_id % 4 WHEN 0 THEN 'OF' WHEN 1 THEN 'BYT' WHEN 2 THEN 'FREE' ELSE 'SFR' END AS operator",
        "42 + (event_id * 7919 % 8000) / CAST(1000 AS DOUBLE) AS latitude",
        "-4 + (event_id * 6841 % 11000) / CAST(1000 AS DOUBLE) AS longitude",
        f"CASE WHEN {no_commune} THEN NULL ELSE concat({dept}, "
        "lpad(CAST(event_id % 7 + 1 AS STRING), 3, '0')) END AS commune_code",
        f"CASE WHEN {no_commune} THEN NULL ELSE concat('Commune ', CAST(user_id % 95 + 1 AS STRING), "
        "'-', CAST(event_id % 7 + 1 AS STRING)) END AS commune_name",
        f"CASE WHEN {no_commune} THEN NULL ELSE {dept} END AS department_code",
        "CASE event_id % 4 WHEN 0 THEN '2G' WHEN 1 THEN '3G' WHEN 2 THEN '4G' ELSE '5G' END AS technology",
    )


def coverage_squares(part: DataFrame) -> DataFrame:
    """Coverage polygons as parameters: axis-aligned squares with an
    optional square hole (Lambert-93 metres)."""
    return part.selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 8 WHEN 0 THEN '2025_T2' ELSE '2025_T3' END AS quarter",
        "CASE p_partkey % 4 WHEN 0 THEN 'OF' WHEN 1 THEN 'BYT' WHEN 2 THEN 'FREE' ELSE 'SFR' END AS operator_code",
        "CASE CAST(floor(p_partkey / 4) AS BIGINT) % 3 WHEN 0 THEN '2G' WHEN 1 THEN '3G' ELSE '4G' END AS technology",
        "CAST(100000 + (p_partkey * 1035817 % 1100000) AS DOUBLE) AS cx",
        "CAST(6100000 + (p_partkey * 1136517 % 1000000) AS DOUBLE) AS cy",
        "CAST(3000 + 300 * p_size AS DOUBLE) AS hw",
        "CASE WHEN p_partkey % 5 = 0 THEN CAST(3000 + 300 * p_size AS DOUBLE) / 2 ELSE CAST(0 AS DOUBLE) END AS hole_hw",
    )


def _square_ring_sql(h: str) -> str:
    """Closed counter-clockwise square ring around (cx, cy), starting at the
    lower-left corner, as one SQL expression."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return "array(" + ", ".join(f"named_struct('x', cx + {dx} * {h}, 'y', cy + {dy} * {h})"
                                for dx, dy in corners) + ")"


def coverage(part: DataFrame) -> DataFrame:
    """raw_coverage in nested ring form (see schema.COVERAGE_SCHEMA)."""
    shell = f"named_struct('part', 0, 'ring', 0, 'pts', {_square_ring_sql('hw')})"
    hole = f"named_struct('part', 0, 'ring', 1, 'pts', {_square_ring_sql('hole_hw')})"
    return coverage_squares(part).selectExpr(
        "id", "quarter", "operator_code", "technology", "'data' AS usage",
        f"CASE WHEN hole_hw > 0 THEN array({shell}, {hole}) ELSE array({shell}) END AS rings",
        "concat_ws('_', quarter, operator_code, technology) AS source_file")


def shapes(part: DataFrame) -> DataFrame:
    """Polygons that are not convex: squares whose four sides are bent at their
    middle, out or in, by 1,000 to 8,000 m.  (id, operator_code, technology, rings)."""
    h = "(hw + 10000)"
    bend = lambda k: (f"(CASE WHEN (id + {k}) % 3 = 0 THEN -1 ELSE 1 END * "  # noqa: E731
                      f"element_at(array(1000, 3500, 6000, 8000), CAST((id + {k} * {k}) % 4 AS INT) + 1))")
    pts = [("cx - {h}", "cy - {h}"), ("cx", "cy - ({h} + {0})"), ("cx + {h}", "cy - {h}"), ("cx + {h} + {1}", "cy"),
           ("cx + {h}", "cy + {h}"), ("cx", "cy + {h} + {2}"), ("cx - {h}", "cy + {h}"), ("cx - ({h} + {3})", "cy"),
           ("cx - {h}", "cy - {h}")]
    ring = ", ".join("named_struct('x', {}, 'y', {})".format(*(v.format(*(bend(k) for k in range(4)), h=h) for v in p))
                     for p in pts)
    return coverage_squares(part).selectExpr(
        "id", "operator_code", "technology", f"array(named_struct('part', 0, 'ring', 0, 'pts', array({ring}))) AS rings")


def line_vertices(supplier: DataFrame) -> DataFrame:
    """Railway line vertices (line_id, feature, part, seq, x, y) in metres:
    45 vertices per supplier, zig-zagging so every segment moves in x and y."""
    v = supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(44))).alias("seq"))
    return v.selectExpr(
        "lpad(CAST(s_suppkey AS STRING), 6, '0') AS line_id",
        "s_suppkey AS feature",
        "0 AS part",
        "seq",
        "CAST(150000 + (s_suppkey * 78901 % 600000) + seq * 8000 AS DOUBLE) AS x",
        "CAST(6150000 + (s_suppkey * 64217 % 800000) + "
        "(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * seq * 3000 + (seq % 2) * 1200 AS DOUBLE) AS y",
    )


def stations(supplier: DataFrame) -> DataFrame:
    """ref_railway_stations: three stations per line, near the line."""
    s = supplier.select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))).alias("i"))
    return s.selectExpr(
        "lpad(CAST(s_suppkey * 10 + i AS STRING), 8, '0') AS station_id",
        "concat('Gare ', CAST((s_suppkey * 7 + i * 3) % 130 AS STRING)) AS station_name",
        "lpad(CAST(s_suppkey AS STRING), 6, '0') AS line_code",
        "concat('Commune ', CAST((s_suppkey * 7 + i * 3) % 130 AS STRING)) AS commune",
        "concat('Dept ', CAST(s_suppkey % 95 + 1 AS STRING)) AS department",
        "46.5 + (6150000 + (s_suppkey * 64217 % 800000) + (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) "
        "* i * 15000 - 6600000) / CAST(111200 AS DOUBLE) AS latitude",
        "3 + (150000 + (s_suppkey * 78901 % 600000) + i * 40000 - 700000) / CAST(76500 AS DOUBLE) AS longitude",
    )


def station_pairs(supplier: DataFrame) -> DataFrame:
    """Pairs of station names to travel between: every third on one line, every
    tenth to a name that no station has, the others anywhere."""
    return supplier.selectExpr(
        "s_suppkey AS pair_id", "concat('Gare ', CAST((s_suppkey * 7) % 130 AS STRING)) AS dep_station",
        "concat('Gare ', CAST(CASE WHEN s_suppkey % 10 = 0 THEN 999 WHEN s_suppkey % 3 = 0 THEN (s_suppkey * 7 + 12) % 130 "
        "ELSE (s_suppkey * 11 + 6) % 130 END AS STRING)) AS arr_station")

def line_feature_texts(routes: DataFrame) -> DataFrame:
    """Line features as GeoJSON text from ``routes(feature, line_id, geometry)``, as a
    delivery holds them: every 7th line is out of use, every 11th has no
    geometry, every 13th no code, every 17th comes twice.  Two folders."""
    rows = routes.select("*", F.explode(F.expr(
        "CASE WHEN feature % 17 = 0 THEN array(1, 2) ELSE array(1) END")).alias("copy"))
    return rows.selectExpr(
        "feature % 2 AS folder",
        "concat('{\"type\":\"Feature\",\"properties\":{', "
        "CASE WHEN feature % 13 = 0 THEN '' ELSE concat('\"code_ligne\":\"', line_id, '\",') END, "
        "'\"libelle\":\"', CASE WHEN feature % 7 = 0 THEN 'Neutralisée' ELSE 'Exploitée' END, "
        "'\"},\"geometry\":', CASE WHEN feature % 11 = 0 THEN 'null' ELSE geometry END, '}') AS feature")


def station_feature_texts(stations_df: DataFrame) -> DataFrame:
    """Station features as GeoJSON text: every 9th is no passenger station, every 12th
    lies overseas, every 14th has no geometry, every 10th is an area; every 5th has a null
    commune, every 6th no department.  Numbers count stations by their id."""
    k = "CAST(station_id AS BIGINT)"
    return stations_df.selectExpr(
        f"{k} % 2 AS folder",
        "concat('{\"type\":\"Feature\",\"properties\":{\"code_uic\":\"', station_id, '\",\"libelle\":\"', station_name, "
        f"'\",\"code_ligne\":\"', line_code, '\",\"commune\":', CASE WHEN {k} % 5 = 0 THEN 'null' ELSE concat('\"', commune, '\"') END, "
        f"CASE WHEN {k} % 6 = 0 THEN '' ELSE concat(',\"departemen\":\"', department, '\"') END, "
        f"',\"voyageurs\":\"', CASE WHEN {k} % 9 = 0 THEN 'N' ELSE 'O' END, '\"}},\"geometry\":', "
        f"CASE WHEN {k} % 14 = 0 THEN 'null' WHEN {k} % 10 = 0 THEN "
        "'{\"type\":\"Polygon\",\"coordinates\":[[[2,48],[3,48],[3,49],[2,48]]]}' "
        f"ELSE concat('{{\"type\":\"Point\",\"coordinates\":[', format_string('%.7f', lon), ',', "
        f"format_string('%.7f', CASE WHEN {k} % 12 = 0 THEN lat - 30 ELSE lat END), ']}}') END, '}}') AS feature")


def delivery(coverage_df: DataFrame) -> DataFrame:
    """Coverage as delivered: two files, a and b, for every quarter, operator and technology."""
    return coverage_df.withColumn("source_file", F.expr(
        "concat(source_file, CASE WHEN CAST(floor(id / 24) AS BIGINT) % 2 = 0 THEN '_a' ELSE '_b' END)"))


def fixture_mart(sites_df: DataFrame) -> DataFrame:
    """mart_coverage_by_commune as the test fixture defines it: the real
    antenna aggregate plus invented coverage_pct / population."""
    return (
        sites_df.filter(F.col("commune_code").isNotNull())
        .groupBy("commune_code", "commune_name", "department_code", "operator", "technology")
        .agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n"))
        .select(
            "commune_code", "commune_name", "department_code",
            F.col("operator").alias("operator_code"), "technology",
            F.lit("2025_T3").alias("quarter"),
            ((F.col("min_id") * 13) % 101).cast("double").alias("coverage_pct"),
            (F.lit(500) + (F.col("min_id") * 97) % 50000).cast("int").alias("total_population"),
            F.col("n").cast("int").alias("antenna_count"),
        )
    )


class Tables:
    """Derived tables of one scale-factor directory, built on first use
    (lazy DataFrames; nothing is read until a query runs)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def sites(self) -> DataFrame:
        return sites(self._read("events"))

    @cached_property
    def _supplier(self) -> DataFrame:
        return self._read("supplier")

    @cached_property
    def coverage(self) -> DataFrame:
        return coverage(self._read("part"))

    @cached_property
    def shapes(self) -> DataFrame:
        return shapes(self._read("part"))

    @cached_property
    def line_vertices(self) -> DataFrame:
        return line_vertices(self._supplier)

    @cached_property
    def stations(self) -> DataFrame:
        return stations(self._supplier)

    @cached_property
    def station_pairs(self) -> DataFrame:
        return station_pairs(self._supplier)

    @cached_property
    def mart(self) -> DataFrame:
        return fixture_mart(self.sites)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


# SQL twins of the derivations above, for the oracle database (DuckDB).
ORACLE_CTES = {
    "sites": """
SELECT event_id AS id,
       CASE user_id % 4 WHEN 0 THEN 'OF' WHEN 1 THEN 'BYT' WHEN 2 THEN 'FREE' ELSE 'SFR' END AS operator,
       42 + (event_id * 7919 % 8000) / CAST(1000 AS DOUBLE) AS latitude,
       -4 + (event_id * 6841 % 11000) / CAST(1000 AS DOUBLE) AS longitude,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat(lpad(CAST(user_id % 95 + 1 AS VARCHAR), 2, '0'), lpad(CAST(event_id % 7 + 1 AS VARCHAR), 3, '0')) END AS commune_code,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('Commune ', CAST(user_id % 95 + 1 AS VARCHAR), '-', CAST(event_id % 7 + 1 AS VARCHAR)) END AS commune_name,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE lpad(CAST(user_id % 95 + 1 AS VARCHAR), 2, '0') END AS department_code,
       CASE event_id % 4 WHEN 0 THEN '2G' WHEN 1 THEN '3G' WHEN 2 THEN '4G' ELSE '5G' END AS technology
FROM events""",
    "squares": """
SELECT p_partkey AS id,
       CASE p_partkey % 8 WHEN 0 THEN '2025_T2' ELSE '2025_T3' END AS quarter,
       CASE p_partkey % 4 WHEN 0 THEN 'OF' WHEN 1 THEN 'BYT' WHEN 2 THEN 'FREE' ELSE 'SFR' END AS operator_code,
       CASE CAST(floor(p_partkey / 4) AS BIGINT) % 3 WHEN 0 THEN '2G' WHEN 1 THEN '3G' ELSE '4G' END AS technology,
       CAST(100000 + (p_partkey * 1035817 % 1100000) AS DOUBLE) AS cx,
       CAST(6100000 + (p_partkey * 1136517 % 1000000) AS DOUBLE) AS cy,
       CAST(3000 + 300 * p_size AS DOUBLE) AS hw,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(3000 + 300 * p_size AS DOUBLE) / 2 ELSE CAST(0 AS DOUBLE) END AS hole_hw
FROM part""",
    "line_vertices": """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS line_id, s_suppkey AS feature, seq,
       CAST(150000 + (s_suppkey * 78901 % 600000) + seq * 8000 AS DOUBLE) AS x,
       CAST(6150000 + (s_suppkey * 64217 % 800000) + (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * seq * 3000 + (seq % 2) * 1200 AS DOUBLE) AS y
FROM (SELECT s_suppkey, unnest(range(45)) AS seq FROM supplier)""",
    "stations": """
SELECT lpad(CAST(s_suppkey * 10 + i AS VARCHAR), 8, '0') AS station_id,
       concat('Gare ', CAST((s_suppkey * 7 + i * 3) % 130 AS VARCHAR)) AS station_name,
       lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS line_code,
       concat('Commune ', CAST((s_suppkey * 7 + i * 3) % 130 AS VARCHAR)) AS commune,
       concat('Dept ', CAST(s_suppkey % 95 + 1 AS VARCHAR)) AS department,
       46.5 + (6150000 + (s_suppkey * 64217 % 800000) + (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * i * 15000 - 6600000) / CAST(111200 AS DOUBLE) AS latitude,
       3 + (150000 + (s_suppkey * 78901 % 600000) + i * 40000 - 700000) / CAST(76500 AS DOUBLE) AS longitude
FROM (SELECT s_suppkey, unnest([0, 4, 8]) AS i FROM supplier)""",
    "station_pairs": """
SELECT s_suppkey AS pair_id, concat('Gare ', CAST((s_suppkey * 7) % 130 AS VARCHAR)) AS dep_station,
       concat('Gare ', CAST(CASE WHEN s_suppkey % 10 = 0 THEN 999 WHEN s_suppkey % 3 = 0 THEN (s_suppkey * 7 + 12) % 130 ELSE (s_suppkey * 11 + 6) % 130 END AS VARCHAR)) AS arr_station
FROM supplier""",
    "mart": """
SELECT commune_code, commune_name, department_code, operator AS operator_code, technology,
       '2025_T3' AS quarter,
       CAST((MIN(id) * 13) % 101 AS DOUBLE) AS coverage_pct,
       CAST(500 + (MIN(id) * 97) % 50000 AS INTEGER) AS total_population,
       CAST(COUNT(*) AS INTEGER) AS antenna_count
FROM sites WHERE commune_code IS NOT NULL
GROUP BY commune_code, commune_name, department_code, operator, technology""",
}


def oracle_with(*names: str) -> str:
    """``WITH`` prefix defining the named derived tables (dependencies
    first) for an oracle query."""
    order = ["sites", "squares", "line_vertices", "stations", "station_pairs", "mart"]
    need = set(names)
    if "mart" in need:
        need.add("sites")
    parts = [f"{n} AS ({ORACLE_CTES[n]})" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
