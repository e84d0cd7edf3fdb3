"""Distributed ranks/AUC/folds against brute force."""

import hashlib
import itertools

from pyspark.sql import functions as F

from ledgerlens.operators import folds as FO
from ledgerlens.operators import rank as RK


def test_rank_methods_with_ties_and_buckets(spark):
    vals = [1, 1, 2, 2, 2, 3, None]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, x int")
    for method, expect in (("min", [1, 1, 3, 3, 3, 6, None]), ("average", [1.5, 1.5, 4, 4, 4, 6, None]),
                           ("dense", [1, 1, 2, 2, 2, 3, None]), ("max", [2, 2, 5, 5, 5, 6, None])):
        out = RK.rank(df, "x", "r", method=method, buckets=7).orderBy("id").collect()
        assert [r["r"] for r in out] == expect, method


def test_row_number_across_buckets(spark):
    vals = [(i, (i * 7919) % 101) for i in range(300)]
    df = spark.createDataFrame(vals, "id int, h int")
    out = RK.row_number(df, ["h", "id"], "rn", buckets=7).collect()
    expect = {row: i + 1 for i, row in enumerate(sorted(vals, key=lambda t: (t[1], t[0])))}
    assert all(expect[(r["id"], r["h"])] == r["rn"] for r in out)


def _brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def test_auc_exact_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.35, 1), (0.8, 1), (0.1, 1), (0.9, 0), (0.5, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    auc = RK.auc_exact(df, "s", "y").first()["auc"]
    assert abs(auc - _brute_auc(rows)) < 1e-12
    flipped = df.withColumn("y", 1 - F.col("y"))
    assert abs(RK.auc_exact(flipped, "s", "y").first()["auc"] - (1 - auc)) < 1e-12


def test_stable_hash_matches_md5(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 123, 99999)], "id long")
    got = {r["id"]: r["h"] for r in df.select("id", FO.stable_hash("id").alias("h")).collect()}
    for i, h in got.items():
        assert h == int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16)


def test_folds_disjoint_exhaustive_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)], "id long, y int")
    k = FO.kfold_assign(df, "id", 5).collect()
    assert len(k) == 500 and {r["fold"] for r in k} == set(range(5))
    s = FO.stratified_kfold(df, "id", "y", 5, buckets=7).collect()
    assert len(s) == 500 and len({r["id"] for r in s}) == 500
    for y in (0, 1):
        sizes = [sum(1 for r in s if r["y"] == y and r["fold"] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_topk_threshold_drops_ties_at_threshold(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 3.0), ("d", 3.0), ("e", 1.0)], "f string, v double")
    kept = df.where(RK.kth_largest_threshold(df, "v", 3)).collect()
    assert sorted(r["f"] for r in kept) == ["a", "b"]


def test_roc_corners_equal_the_full_second_difference(spark):
    """Straight stretches that run over several range buckets lose their inner points only."""
    import numpy as np
    from ledgerlens.operators.rank import roc_curve_points
    r = np.random.default_rng(3)
    y = np.concatenate([np.ones(40), r.integers(0, 2, 60), np.zeros(50)]).astype(int)
    score = np.concatenate([np.arange(150, 110, -1), r.integers(50, 110, 60), np.arange(49, -1, -1)]).astype(float)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)] + [(None, 1), (3.0, None)], "s double, y int")
    got = sorted((x.threshold, x.fpr, x.tpr) for x in roc_curve_points(df, "s", "y", drop_intermediate=True).collect())
    t = np.unique(score)[::-1]
    tp, fp = (np.array([((score >= v) & (y == k)).sum() for v in t]) for k in (1, 0))
    keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True]
    want = sorted(zip(t[keep], fp[keep] / fp[-1], tp[keep] / tp[-1]))
    assert len(want) < len(t) - 60 and np.allclose(got, want)
