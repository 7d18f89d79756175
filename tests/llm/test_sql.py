"""The training-data queries that have SQL give what DuckDB gives."""

import duckdb
import pytest

from tallgrass.llm import registry
from tests.test_queries import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = registry.queries()[name](spark, small)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(names, want.fetchall())
