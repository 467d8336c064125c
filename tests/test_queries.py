"""Every query of the registry gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from millrace import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    other = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [other.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    assert ours == theirs


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
