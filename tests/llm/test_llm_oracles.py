"""Registered queries with SQL against DuckDB on the small table, value by value."""

import duckdb
import pytest

from ledgerlens.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    got = [r.asDict() for r in catalog.queries()[name](spark, SF).collect()]
    key = (lambda r: repr([r[n] for n in names]))
    assert sorted(got[0]) == names and sorted(map(key, got)) == sorted(map(key, want))


def test_every_dealt_query_is_registered():
    names = catalog.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
