"""Row-wise statistics against pandas axis=1 reductions."""

import math

import pandas as pd

from ledgerlens.functions import rowwise as R

ROWS = [
    [0.0] * 20,
    [1.0] + [0.0] * 19,
    [1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0],
    [1.0, 2.0, None] + [None] * 17,
    [3.0, None, 5.0, 10.0, -1.0] + [None] * 15,
]
COLS = [f"c{i}" for i in range(20)]


def _frame(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)],
                                 "id int, " + ", ".join(f"{c} double" for c in COLS))


def _close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) < 1e-9


def test_row_stats_match_pandas(spark):
    df = _frame(spark)
    out = df.select("id", R.row_kurtosis(COLS).alias("k"), R.row_mean(COLS).alias("m"),
                    R.row_std(COLS).alias("s"), R.row_median(COLS).alias("med"),
                    R.row_sum(COLS).alias("sum"), R.row_min(COLS).alias("mn"),
                    R.row_missing_count(COLS).alias("miss")).orderBy("id").collect()
    pdf = pd.DataFrame(ROWS, columns=COLS, dtype=float)
    kurt = pdf.kurtosis(axis=1)
    for i, r in enumerate(out):
        expected_k = kurt[i]
        if pdf.iloc[i].count() < 4:
            expected_k = None
        assert _close(expected_k, r["k"]), (i, expected_k, r["k"])
        assert _close(pdf.iloc[i].mean(), r["m"])
        assert _close(pdf.iloc[i].std(), r["s"])
        assert _close(pdf.iloc[i].median(), r["med"])
        assert _close(pdf.iloc[i].sum(), r["sum"])
        assert _close(pdf.iloc[i].min(), r["mn"])
        assert r["miss"] == int(pdf.iloc[i].isna().sum())


def test_constant_row_kurtosis_is_zero(spark):
    r = _frame(spark).select(R.row_kurtosis(COLS).alias("k")).first()
    assert r["k"] == 0.0
