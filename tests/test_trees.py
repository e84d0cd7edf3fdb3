"""Boosting and extremely randomised trees against plain Python over the same rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import trees as T


def table(spark, n=240, missing=True):
    r = np.random.default_rng(7)
    rows = []
    for i in range(n):
        a, b = float(r.integers(0, 30)), float(r.normal())
        lost = missing and r.random() < 0.2
        y = None if i % 12 == 11 else int((a > 17) ^ (r.random() < 0.1) if not lost else r.random() < 0.8)
        rows.append((i, y, None if lost else a, b if i % 5 else float("nan") if i % 2 else None))
    return rows, spark.createDataFrame(rows, "id long, y int, a double, b double").repartition(3)


def naive_boost(rows, edges, base, rounds, rate, depth, l2, min_child):
    """Level by level with all splits taken (no limit of leaves): margins by id."""
    def place(x, e):
        return -1 if x is None or math.isnan(x) else sum(x > v for v in e)
    bins = {i: [place(x, e) for x, e in zip(xs, edges)] for i, _, *xs in rows}
    f = {i: base for i, *_ in rows}
    for _ in range(rounds):
        p = {i: 1 / (1 + math.exp(-v)) for i, v in f.items()}
        g = {i: p[i] - y for i, y, *_ in rows if y is not None}
        node = {i: 1 for i in f}
        for level in range(depth):
            for n in range(1 << level, 2 << level):
                inside = [i for i in g if node[i] == n]
                if not inside:
                    continue
                h = {i: p[i] * (1 - p[i]) for i in inside}
                whole = sum(g[i] for i in inside) ** 2 / (sum(h.values()) + l2)
                best = (1e-12, None)
                for c, e in enumerate(edges):
                    for lost in (True, False):
                        for b in range(len(e)):
                            left = [i for i in inside if (bins[i][c] <= b if lost else 0 <= bins[i][c] <= b)]
                            right = set(inside) - set(left)
                            hl, hr = sum(h[i] for i in left), sum(h[i] for i in right)
                            if hl >= min_child and hr >= min_child:
                                gain = sum(g[i] for i in left) ** 2 / (hl + l2) + sum(g[i] for i in right) ** 2 / (hr + l2) - whole
                                if gain > best[0] + 1e-9:
                                    best = (gain, (c, b, lost))
                if best[1]:
                    c, b, lost = best[1]
                    for i in node:
                        if node[i] == n:
                            node[i] = 2 * n if (bins[i][c] <= b if lost else 0 <= bins[i][c] <= b) else 2 * n + 1
        for n in set(node.values()):
            inside = [i for i in g if node[i] == n]
            v = -sum(g[i] for i in inside) / (sum(p[i] * (1 - p[i]) for i in inside) + l2)
            for i in node:
                if node[i] == n:
                    f[i] += rate * v
    return f


def test_two_rounds_equal_plain_python(spark):
    rows, df = table(spark)
    model = T.fit_boosted(df, "id", "y", ["a", "b"], rounds=2, leaves=4, depth=2, rate=0.3, n_bins=6)
    assert model.best == 2 and any(s[1][2] is False for t in model.trees for s in t[0].items())     # missing values go right somewhere
    want = naive_boost(rows, model.edges, model.base, 2, 0.3, 2, 1.0, 1.0)
    got = {r.id: r.score for r in model.transform(df).collect()}
    for i, f in want.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-f)), abs=1e-6)


def test_boosting_is_independent_of_partitions_and_stops_early(spark):
    _, df = table(spark, 400)
    held = F.col("id") % 3 == 0
    kw = dict(held_out=held, rounds=25, leaves=8, depth=4, rate=0.8, n_bins=8, patience=2)
    one, two = (T.fit_boosted(x, "id", "y", ["a", "b"], **kw) for x in (df, df.repartition(7, "b")))
    assert one.trees == two.trees
    assert len(one.trees) < 25 and one.best == len(one.trees) - 2
    assert one.history[one.best - 1] == min(one.history)


def test_leaves_are_limited_and_one_class_is_refused(spark):
    _, df = table(spark)
    model = T.fit_boosted(df, "id", "y", ["a", "b"], rounds=1, leaves=3, depth=4, n_bins=6)
    assert len(model.trees[0][0]) <= 2
    with pytest.raises(ValueError):
        T.fit_boosted(df.where("y = 1 or y is null"), "id", "y", ["a"])


def test_extra_trees_leaves_and_scores(spark):
    rows, df = table(spark)
    model = T.fit_extra_trees(df, "y", ["a", "b"], n_trees=4, depth=3, seed=9)
    again = T.fit_extra_trees(df.repartition(5), "y", ["a", "b"], n_trees=4, depth=3, seed=9)
    assert model.splits == again.splits and len({tuple(sorted(s.items())) for s in model.splits}) > 1
    got = {r.id: r.s for r in df.select("id", model.score().alias("s")).collect()}
    place = {}
    for t in range(4):
        for i, _, *x in rows:
            n = 1
            while n in model.splits[t]:
                c, cut = model.splits[t][n]
                n = 2 * n if x[c] is not None and x[c] <= cut else 2 * n + 1
            place[t, i] = n
        for n in {place[t, i] for i, *_ in rows}:
            ys = [y for i, y, *_ in rows if y is not None and place[t, i] == n]
            assert model.values[t][n] == pytest.approx(sum(ys) / len(ys))
    for i, *_ in rows:
        assert got[i] == pytest.approx(sum(model.values[t][place[t, i]] for t in range(4)) / 4)
    with pytest.raises(ValueError):
        T.fit_extra_trees(df, "y", ["a"], n_trees=1000, depth=10)
