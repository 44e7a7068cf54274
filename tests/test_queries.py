"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in registry.ORACLE_SQL:
        got = sql.sql(registry.ORACLE_SQL[name])
        at = [got.columns.index(c) for c in sorted(df.columns)]
        assert sorted(got.columns) == sorted(df.columns)
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
