"""A small slice of the correctness gate: registered queries against their
DuckDB oracle on the smallest test tables (exact values, order-insensitive)."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
FAST = ["safe_ratio", "fixed_width_bucket", "row_kurtosis", "one_hot_agg", "conditional_agg",
        "two_level_weighted_agg", "agg_mode", "factorize", "rank_min", "auc_exact", "stratified_kfold",
        "winsor_to_null", "feature_mart", "dfs_depth1", "infinite_to_null", "missing_target_lift"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _rows(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return order, sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    s_cols, s_rows = _rows(df.columns, df.collect())
    d_cols, d_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows
