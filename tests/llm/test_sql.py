"""Registered queries of the corpus operators against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

from quire.llm import queries
from tests.test_queries import canonical

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(k for k, v in queries.ORACLES.items() if v))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    assert canonical(queries.QUERIES[name](spark, str(DATA)).toPandas()) == canonical(connection.sql(queries.ORACLES[name]).df())
