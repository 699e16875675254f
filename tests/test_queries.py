"""Registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

import quire.plans  # noqa: F401
from quire.plans import registry

DATA = Path("/root/testdata/sf0.001")
duckdb, pandas = pytest.importorskip("duckdb"), pytest.importorskip("pandas")


def canonical(frame):
    columns = sorted(frame.columns)

    def value(v):
        if not isinstance(v, str | list | dict) and pandas.isna(v):
            return ""
        return str(v) if isinstance(v, str | bool) else f"{float(v):.6f}" if not isinstance(v, list | dict) else str(v)

    rows = frame[columns].astype(object).to_numpy().tolist()
    return columns, sorted(tuple(value(v.item() if hasattr(v, "item") else v) for v in row) for row in rows)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    assert canonical(registry.QUERIES[name](spark, str(DATA)).toPandas()) == canonical(connection.sql(registry.ORACLES[name]).df())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
