"""Encoders, profiles, unions."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import profile as P


def _cats(spark):
    return spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "a")], "id int, c string")


def test_one_hot_with_and_without_nan_column(spark):
    df = _cats(spark)
    enc, names = E.one_hot(df, ["c"], nan_column=True)
    assert names == ["c_a", "c_b", "c_nan"]
    rows = enc.orderBy("id").collect()
    assert [(r["c_a"], r["c_b"], r["c_nan"]) for r in rows] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)]
    _, names = E.one_hot(df, ["c"])
    assert names == ["c_a", "c_b"]


def test_factorize_frequency_and_align(spark):
    df = _cats(spark)
    f = {r["id"]: r["c_code"] for r in E.factorize(df, "c", "id").collect()}
    assert f == {0: 0, 1: 1, 2: -1, 3: 0}
    q = {r["id"]: r["c_freq"] for r in E.frequency_encode(df, "c").collect()}
    assert q == {0: 0, 1: 1, 2: None, 3: 0}
    aligned = E.align_columns(df.select("id", F.lit(1).alias("x")), ["id", "x", "y"])
    assert aligned.columns == ["id", "x", "y"] and aligned.first()["y"] == 0


def test_winsor_guards(spark):
    rows = [(float(i % 29), float(i % 30), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, u double")
    bounds = P.winsor_bounds(df, ["a", "b", "u"])
    assert bounds["a"] is None          # 29 distinct values
    assert bounds["b"] is not None      # 30 distinct values
    assert bounds["u"] is None          # all unique (an id)
    out = P.winsor_to_null(df, bounds)
    lo, hi = bounds["b"]
    assert all((r["b"] is None) == (not (lo < rr[1] < hi)) for r, rr in zip(out.collect(), rows))


def test_missing_profiles(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.0, None), (3, None, None)], "k int, a double, s string")
    prof = {r["column_name"]: r for r in C.missing_rate_profile(df).collect()}
    assert prof["a"]["n_missing"] == 2 and abs(prof["s"]["missing_rate"] - 2 / 3) < 1e-12
    assert C.drop_sparse_columns(df, 0.5).columns == ["k"]
    train, test = df.where("k < 3"), df.where("k = 3")
    nc = {r["column_name"]: r["drop"] for r in C.null_compat_profile(train, test).collect()}
    assert nc == {"k": 0, "a": 0, "s": 0}


def test_union_train_test_missing_label(spark):
    from ledgerlens.functions.rowwise import row_missing_count
    train = spark.createDataFrame([(1, 1.0, 1)], "id int, x double, TARGET int")
    test = spark.createDataFrame([(2, None)], "id int, x double")
    u = train.unionByName(test, allowMissingColumns=True)
    u = u.withColumn("miss", C.row_missing_count(u.columns))
    rows = {r["id"]: r for r in u.collect()}
    assert rows[2]["TARGET"] is None and rows[2]["miss"] == 1 and rows[1]["miss"] == 0
    assert row_missing_count(["x"]) is not None


def test_fit_one_hot_many_matches_single_fits(spark):
    a = spark.createDataFrame([("x", "p"), ("y", None)], "c string, d string")
    b = spark.createDataFrame([("z",), ("x",)], "c string")
    m1, m2 = E.fit_one_hot_many([(a, ["c", "d"], True), (b, ["c"], False)])
    assert m1.levels == E.fit_one_hot(a, ["c", "d"], True).levels
    assert m2.levels == {"c": ["x", "z"]} and m1.names == ["c_x", "c_y", "c_nan", "d_p", "d_nan"]


def test_optimal_cuts_equal_every_way_to_cut():
    from itertools import combinations

    import numpy as np
    rng = np.random.default_rng(3)
    for case in range(60):
        n, k = int(rng.integers(1, 12)), int(rng.integers(1, 6))
        x = np.sort(rng.choice(np.arange(1000), n, replace=False)) / 997.0
        w = rng.integers(1, 5, n)

        def cost(cuts, x=x, w=w, n=n):
            runs = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
            return sum(float((w[r] * (x[r] - np.average(x[r], weights=w[r])) ** 2).sum()) for r in runs)

        got = E.optimal_cuts(list(x), list(w), k)
        ways = [(0, *c) for c in combinations(range(1, n), min(k, n) - 1)]
        assert len(got) == min(k, n) and got[0] == 0 and got == sorted(set(got))
        assert cost(got) <= min(map(cost, ways)) + 1e-9, case


def test_rate_clusters_bounds_and_edges(spark):
    rows = [(c, t) for c, ones in {"a": 0, "b": 1, "c": 8, "d": 9, "e": 9}.items() for t in [1] * ones + [0] * (10 - ones)]
    df = spark.createDataFrame([*rows, ("z", None), (None, 1)], "c string, TARGET int")
    got = {r["c"]: r["cluster_id"] for r in E.target_rate_clusters(df, "c", k=2).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 1, None: 1}
    many = {r["c"]: r["cluster_id"] for r in E.target_rate_clusters(df, "c", k=9).collect()}
    assert many == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 3, None: 4}
    with pytest.raises(ValueError):
        E.target_rate_clusters(df, "c", max_rates=2)
    assert E.target_rate_clusters(df.where("false"), "c").count() == 0
