"""Every registered query against its DuckDB counterpart, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = duck.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    expected = sorted(str(tuple(row[k] for k in at)) for row in found.fetchall())
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(str(tuple(row)) for row in df.select(*columns).collect()) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
