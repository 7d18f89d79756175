"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from tallgrass.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


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
