"""Bracketed exact percentiles against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import brackets as K
from ledgerlens.operators import profile as P

PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 6000
    cols = {"smooth": rng.normal(size=n), "hot": np.where(rng.random(n) < .4, 7.0, rng.random(n) * 20),
            "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5), "ids": np.arange(n) * 1.5}
    rows = [tuple(float(cols[c][i]) for c in cols) + (None, int(i % 50)) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", none double, whole int"), cols


@pytest.mark.parametrize("accuracy", [2000, 20, 4])
def test_percentiles_equal_numpy(frame, accuracy):
    df, cols = frame
    got = K.bracketed_quantiles(df, [*cols, "none"], PROBS, accuracy=accuracy)
    assert got["none"].values is None and got["none"].n == 0
    for c, v in cols.items():
        assert got[c].values == pytest.approx(list(np.quantile(v, PROBS)), abs=1e-12), c


def test_only_bracket_values_are_ranked(frame, monkeypatch):
    df, _ = frame
    seen = []
    real = K.prefix_sums
    monkeypatch.setattr(K, "prefix_sums", lambda counts, *a, **k: seen.append(counts.count()) or real(counts, *a, **k))
    K.bracketed_quantiles(df, ["smooth"], [0.5])
    K.bracketed_quantiles(df, ["one"], PROBS)          # equal ends: nothing to rank
    assert len(seen) == 1 and seen[0] <= 6000 * 0.01


def test_poor_sketch_costs_work_not_the_result(frame, monkeypatch):
    df, cols = frame
    real = F.percentile_approx
    # a sketch that answers far from what it was asked: the counts reject its brackets
    monkeypatch.setattr(K.F, "percentile_approx", lambda x, asked, acc: F.transform(real(x, asked, acc), lambda v: F.lit(1e9)))
    got = K.bracketed_quantiles(df, ["smooth", "hot"], [0.5])
    for c in ("smooth", "hot"):
        assert got[c].values == pytest.approx([float(np.median(cols[c]))], abs=1e-12)


def test_guards_nan_and_empty(frame, spark):
    df, _ = frame
    b = P.winsor_bounds(df, ["smooth", "hot", "few", "one", "ids", "none", "whole"])
    assert b["hot"] is not None and b["whole"] is not None
    assert b["smooth"] is None and b["ids"] is None        # all values differ
    assert b["few"] is None and b["one"] is None and b["none"] is None
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "a double")
    q = K.bracketed_quantiles(nan, ["a"], [0.0, 1.0])["a"].values
    assert q[0] == 1.0 and math.isnan(q[1])
    empty = df.where("false")
    assert K.bracketed_quantiles(empty, ["smooth"], [0.5])["smooth"].values is None
    assert P.winsor_bounds(empty, ["smooth"]) == {"smooth": None}
