"""Table schemas and the small fixed dimension tables.

Every function takes a SparkSession and returns a DataFrame; nothing here
holds global state.  The dimension tables are a handful of rows each,
so Spark broadcasts them by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the reference's seed data and lookup) -------
# Operators: code, display name, colour.
OPERATORS = [
    ("BYT", "Bouygues Telecom", "#003DA5"),
    ("FREE", "Free Mobile", "#CD1719"),
    ("OF", "Orange", "#FF6600"),
    ("SFR", "SFR", "#E4002B"),
]
# Technologies: code, generation, description.
TECHNOLOGIES = [
    ("2G", 2, "GSM - Voix et SMS"),
    ("3G", 3, "UMTS - Internet mobile basique"),
    ("4G", 4, "LTE - Haut débit mobile"),
    ("5G", 5, "5G NR - Très haut débit mobile"),
]
TECH_CODES = ["2G", "3G", "4G", "5G"]
# Source operator name -> coverage file code -> database code.
OPERATOR_FILE_CODES = [
    ("bouygues", "BOUY", "BYT"),
    ("free", "FREE", "FREE"),
    ("orange", "OF", "OF"),
    ("sfr", "SFR0", "SFR"),
]
# Coverage source file name pattern: quarter, file operator code, technology.
COVERAGE_FILE_PATTERN = "%s_couv_Metropole_%s_%s_data.gpkg.7z"
# French department code -> name (101 entries; codes absent here fall back
# to the code itself).
DEPARTMENT_NAMES = [
    ("01", "Ain"), ("02", "Aisne"), ("03", "Allier"), ("04", "Alpes-de-Haute-Provence"),
    ("05", "Hautes-Alpes"), ("06", "Alpes-Maritimes"), ("07", "Ardèche"), ("08", "Ardennes"),
    ("09", "Ariège"), ("10", "Aube"), ("11", "Aude"), ("12", "Aveyron"),
    ("13", "Bouches-du-Rhône"), ("14", "Calvados"), ("15", "Cantal"), ("16", "Charente"),
    ("17", "Charente-Maritime"), ("18", "Cher"), ("19", "Corrèze"), ("21", "Côte-d'Or"),
    ("22", "Côtes-d'Armor"), ("23", "Creuse"), ("24", "Dordogne"), ("25", "Doubs"),
    ("26", "Drôme"), ("27", "Eure"), ("28", "Eure-et-Loir"), ("29", "Finistère"),
    ("2A", "Corse-du-Sud"), ("2B", "Haute-Corse"), ("30", "Gard"), ("31", "Haute-Garonne"),
    ("32", "Gers"), ("33", "Gironde"), ("34", "Hérault"), ("35", "Ille-et-Vilaine"),
    ("36", "Indre"), ("37", "Indre-et-Loire"), ("38", "Isère"), ("39", "Jura"),
    ("40", "Landes"), ("41", "Loir-et-Cher"), ("42", "Loire"), ("43", "Haute-Loire"),
    ("44", "Loire-Atlantique"), ("45", "Loiret"), ("46", "Lot"), ("47", "Lot-et-Garonne"),
    ("48", "Lozère"), ("49", "Maine-et-Loire"), ("50", "Manche"), ("51", "Marne"),
    ("52", "Haute-Marne"), ("53", "Mayenne"), ("54", "Meurthe-et-Moselle"), ("55", "Meuse"),
    ("56", "Morbihan"), ("57", "Moselle"), ("58", "Nièvre"), ("59", "Nord"),
    ("60", "Oise"), ("61", "Orne"), ("62", "Pas-de-Calais"), ("63", "Puy-de-Dôme"),
    ("64", "Pyrénées-Atlantiques"), ("65", "Hautes-Pyrénées"), ("66", "Pyrénées-Orientales"),
    ("67", "Bas-Rhin"), ("68", "Haut-Rhin"), ("69", "Rhône"), ("70", "Haute-Saône"),
    ("71", "Saône-et-Loire"), ("72", "Sarthe"), ("73", "Savoie"), ("74", "Haute-Savoie"),
    ("75", "Paris"), ("76", "Seine-Maritime"), ("77", "Seine-et-Marne"), ("78", "Yvelines"),
    ("79", "Deux-Sèvres"), ("80", "Somme"), ("81", "Tarn"), ("82", "Tarn-et-Garonne"),
    ("83", "Var"), ("84", "Vaucluse"), ("85", "Vendée"), ("86", "Vienne"),
    ("87", "Haute-Vienne"), ("88", "Vosges"), ("89", "Yonne"), ("90", "Territoire de Belfort"),
    ("91", "Essonne"), ("92", "Hauts-de-Seine"), ("93", "Seine-Saint-Denis"),
    ("94", "Val-de-Marne"), ("95", "Val-d'Oise"), ("971", "Guadeloupe"), ("972", "Martinique"),
    ("973", "Guyane"), ("974", "La Réunion"), ("976", "Mayotte"),
]
# Sample seeder: communes (code, name, department, latitude, longitude).
SAMPLE_COMMUNES = [
    ("31555", "Toulouse", "31", 43.6047, 1.4442),
    ("75056", "Paris", "75", 48.8566, 2.3522),
    ("69123", "Lyon", "69", 45.7640, 4.8357),
    ("13055", "Marseille", "13", 43.2965, 5.3698),
    ("33063", "Bordeaux", "33", 44.8378, -0.5792),
    ("44109", "Nantes", "44", 47.2184, -1.5536),
    ("67482", "Strasbourg", "67", 48.5734, 7.7521),
    ("59350", "Lille", "59", 50.6292, 3.0573),
]
SAMPLE_OPERATORS = ["OF", "BYT", "FREE", "SFR"]
# --------------------------------------------------------------------------

OPERATORS_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("color", T.StringType(), True),
])
TECHNOLOGIES_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("generation", T.IntegerType(), True),
    T.StructField("description", T.StringType(), True),
])
DEPARTMENTS_SCHEMA = T.StructType([
    T.StructField("department_code", T.StringType(), False),
    T.StructField("department_name", T.StringType(), False),
])

SITES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("operator", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("commune_code", T.StringType()),
    T.StructField("commune_name", T.StringType()),
    T.StructField("department_code", T.StringType()),
    T.StructField("technology", T.StringType()),
])

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

# Coverage polygons in nested form: one row per geometry, rings as arrays of
# points; ``ring`` 0 is a shell, >0 a hole, ``part`` numbers polygons of a
# multipolygon.  Lambert-93 metres.
RING = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("ring", T.IntegerType()),
    T.StructField("pts", T.ArrayType(XY)),
])
COVERAGE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("operator_code", T.StringType()),
    T.StructField("technology", T.StringType()),
    T.StructField("usage", T.StringType()),
    T.StructField("rings", T.ArrayType(RING)),
    T.StructField("source_file", T.StringType()),
])

# Railway lines: one row per feature, parts as arrays of points (metres).
LINES_SCHEMA = T.StructType([
    T.StructField("line_id", T.StringType()),
    T.StructField("feature", T.LongType()),
    T.StructField("line_name", T.StringType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(XY))),
    T.StructField("length_km", T.DoubleType()),
])

STATIONS_SCHEMA = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("line_code", T.StringType()),
    T.StructField("commune", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])


def ref_operators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OPERATORS, OPERATORS_SCHEMA)


def ref_technologies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TECHNOLOGIES, TECHNOLOGIES_SCHEMA)


def ref_departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEPARTMENT_NAMES, DEPARTMENTS_SCHEMA)


def operator_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        OPERATOR_FILE_CODES, "source_name string, file_code string, operator_code string")
