"""Each query that has SQL gives the rows of that SQL on DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tagloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(spark, oracle, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(oracle.execute(registry.oracle_sql()[name]).df())


def test_entry_point_works_without_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tagloom.llm'] = None\ntry:\n import tagloom.llm\nexcept ImportError: pass\nimport __spark_entry__ as e; assert 'tag_statistics_filtered' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
