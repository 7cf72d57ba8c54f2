"""Every registered query against its SQL oracle (DuckDB) at sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("COVGRID_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_against_oracle(spark, con, key):
    s = entry.queries()[key](spark, SF).toPandas()
    o = con.execute(entry.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert _rows(s) == _rows(o)


def test_every_query_has_an_oracle():
    assert set(entry.catalog.QUERIES) == set(entry.catalog.ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["line_id", "operator", "operator_name", "total_length_km", "covered_length_km",
                          "coverage_pct"]
    assert df.count() > 0


def test_entry_from_another_directory(tmp_path):
    """Python workers must import the package even when the driver was
    started elsewhere (the package is shipped with addPyFile)."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "import __spark_entry__ as e\n"
            "print('ROWS', e.entry(spark).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
