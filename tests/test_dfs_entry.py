"""Feature synthesis on a tiny tree; driver contract smoke test."""

import math

import pandas as pd

from ledgerlens.operators.dfs import EntitySet, synthesize


def test_dfs_depth2_names_and_values(spark):
    cust = spark.createDataFrame([(1,), (2,)], "cid long")
    orders = spark.createDataFrame([(10, 1, 5.0, "x"), (11, 1, 7.0, "y"), (12, 2, 1.0, "x")],
                                   "oid long, cid long, amt double, st string")
    lines = spark.createDataFrame([(10, 1.0), (10, 3.0), (11, 2.0)], "oid long, q double")
    es = (EntitySet().add("c", cust, "cid").add("o", orders, "oid").add("l", lines, None)
          .relate("c", "cid", "o", "cid").relate("o", "oid", "l", "oid"))
    out = {r["cid"]: r.asDict() for r in synthesize(es, "c", 2).collect()}
    assert out[1]["COUNT(o)"] == 2 and out[1]["SUM(o.amt)"] == 12.0
    assert out[1]["MEAN(o.SUM(l.q))"] == 3.0            # (4 + 2) / 2
    assert out[2]["MEAN(o.SUM(l.q))"] is None           # no line at all: absent after the left join
    assert out[1]["NUM_UNIQUE(o.st)"] == 2 and out[1]["MODE(o.st)"] == "x"
    assert out[2]["STD(o.amt)"] is None
    skew = pd.Series([5.0, 7.0]).skew()
    assert out[1]["SKEW(o.amt)"] is None and math.isnan(skew)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "c_custkey" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 114


def test_direct_parent_features_end_on_cycles(spark):
    from ledgerlens.operators.dfs import EntitySet, synthesize
    es = EntitySet()
    es.add("shop", spark.createDataFrame([(1, 10.0, 7), (2, 20.0, 8)], "shop_id int, size double, city int"), "shop_id")
    es.add("sale", spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, None, 9.0), (4, 9, 1.0)], "sale_id int, shop int, paid double"), "sale_id")
    es.add("visit", spark.createDataFrame([(1,), (1,), (2,)], "shop int"), None)
    es.add("city", spark.createDataFrame([(7, "x"), (8, "y")], "city_id int, name string"), "city_id")
    es.relate("shop", "shop_id", "sale", "shop").relate("shop", "shop_id", "visit", "shop").relate("city", "city_id", "shop", "city")
    rows = {r["sale_id"]: r.asDict() for r in synthesize(es, "sale", 2).collect()}
    assert set(rows[1]) == {"sale_id", "shop", "paid", "shop.size", "shop.COUNT(visit)", "shop.city.name"}
    assert rows[1]["shop.size"] == 10.0 and rows[1]["shop.COUNT(visit)"] == 2 and rows[1]["shop.city.name"] == "x"
    assert rows[3]["shop.size"] is None and rows[4]["shop.COUNT(visit)"] is None and len(rows) == 4
    assert "shop.city.name" not in synthesize(es, "sale", 1).columns
    es.relate("sale", "sale_id", "city", "city_id")          # a cycle
    assert synthesize(es, "sale", 4).count() == 4
