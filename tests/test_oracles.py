"""Every query with a DuckDB counterpart, on the smallest tables."""

import duckdb
import pytest

from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "documents", "lineitem", "part", "orders", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(plain(v) for v in row) for row in frame.select(*columns).collect()), key=str)
    order = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in order) for row in want.fetchall()), key=str)
