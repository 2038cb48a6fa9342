"""Every query with SQL against DuckDB at the smallest scale, if the data is there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.compare import compare

FOLDER = Path("/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in sorted(FOLDER.glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_names():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], SQL[name], str(FOLDER)).startswith("same")
