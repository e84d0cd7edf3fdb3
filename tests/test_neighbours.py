"""Exact neighbours against brute force: many cells, copies, ties, missing values; AllKNN votes."""

import numpy as np
import pytest

from ledgerlens.operators import neighbours as N


def brute(rows, k):
    out = {}
    for i, _, x in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j, lab) for j, lab, y in rows if j != i)
        out[i] = d[:k]
    return out


def make(spark, rows, dims):
    cols = ", ".join(f"f{c} double" for c in range(dims))
    return spark.createDataFrame([(i, lab, *x) for i, lab, x in rows], f"id long, label int, {cols}").repartition(3), [f"f{c}" for c in range(dims)]


@pytest.mark.parametrize("kind", ["grid", "copies", "wide"])
def test_nearest_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "SAMPLE", 64)
    monkeypatch.setattr(N, "ASKING", 20)
    r = np.random.default_rng(4)
    if kind == "grid":          # ties everywhere
        x = r.integers(0, 6, (300, 3)).astype(float)
    elif kind == "copies":      # a third of the rows in one point
        x = r.normal(0, 3, (300, 2))
        x[:100] = x[0]
    else:
        x = r.normal(0, 1, (300, 3)) * [1, 100, 1e4]
    rows = [(int(i), int(i % 3 == 0), tuple(map(float, v))) for i, v in zip(r.permutation(300), x)]
    df, feats = make(spark, rows, x.shape[1])
    got = {q.id: [(c.d2, c.id, c.label) for c in q.near] for q in N.nearest(df, "id", "label", feats, 3).collect()}
    want = brute(rows, 3)
    assert got.keys() == want.keys()
    for i in want:
        assert [c[1:] for c in got[i]] == [c[1:] for c in want[i]]
        assert np.allclose([c[0] for c in got[i]], [c[0] for c in want[i]])


def test_missing_features_and_few_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, None), (3, 0, float("nan")), (4, 1, 2.0)], "id long, label int, f0 double")
    got = {q.id: [c.id for c in q.near] for q in N.nearest(df, "id", "label", ["f0"], 3).collect()}
    assert got == {1: [4], 4: [1]}
    assert N.nearest(df.limit(0), "id", "label", ["f0"], 2).count() == 0
    assert N.nearest(df.where("id = 1"), "id", "label", ["f0"], 2).first()["near"] == []


def test_all_knn_votes(spark):
    line = [(0, 0, 0.0), (1, 0, 1.0), (2, 0, 2.1), (3, 1, 3.0), (4, 0, 3.8), (5, 0, 10.0), (6, 0, 11.0), (7, 0, 12.5), (8, 0, None), (9, None, 3.1)]
    df = spark.createDataFrame(line, "id long, label int, f0 double")
    kept = lambda **kw: {r.id for r in N.all_knn(df, "id", "label", ["f0"], **kw).collect()}
    # one neighbour: 2 and 4 sit next to 3; two and three: what is left agrees but for 0 and 1
    assert kept(k=1) == {0, 1, 3, 5, 6, 7, 8, 9}
    assert kept(k=2) == {3, 5, 6, 7, 8, 9}
    assert kept(k=2, vote="mode") == {0, 1, 3, 5, 6, 7, 8, 9}
    with pytest.raises(ValueError):
        N.all_knn(df, "id", "label", ["f0"], vote="none")
