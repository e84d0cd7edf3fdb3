"""Row-wise (horizontal) statistics over a list of columns.

All are closed-form expressions over the listed columns, so a row never
leaves the JVM.  Missing values are skipped the way pandas ``axis=1``
reductions skip NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import ColumnOrName, col


def _d(c: ColumnOrName) -> Column:
    return col(c).cast("double")


def row_count(cols: Sequence[ColumnOrName]) -> Column:
    """Number of non-missing values."""
    return sum((col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_missing_count(cols: Sequence[ColumnOrName]) -> Column:
    return sum((col(c).isNull().cast("int") for c in cols), F.lit(0))


def row_sum(cols: Sequence[ColumnOrName]) -> Column:
    """Sum with missing values as 0 (``nansum``)."""
    return sum((F.coalesce(_d(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    """Mean of the non-missing values; NULL when all are missing."""
    return F.try_divide(row_sum(cols), row_count(cols))


def _centered_power_sum(cols, mean: Column, p: int) -> Column:
    return sum((F.coalesce(F.pow(_d(c) - mean, F.lit(p)), F.lit(0.0)) for c in cols), F.lit(0.0))


def row_var(cols: Sequence[ColumnOrName], ddof: int = 1) -> Column:
    n = row_count(cols)
    m = row_mean(cols)
    ss = sum((F.coalesce((_d(c) - m) * (_d(c) - m), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > ddof, ss / (n - F.lit(ddof)))


def row_std(cols: Sequence[ColumnOrName], ddof: int = 1) -> Column:
    return F.sqrt(row_var(cols, ddof))


def row_kurtosis(cols: Sequence[ColumnOrName]) -> Column:
    """Bias-corrected sample excess kurtosis (G2); 0 for a constant row,
    NULL for fewer than four values."""
    n = row_count(cols).cast("double")
    m = row_mean(cols)
    m2 = _centered_power_sum(cols, m, 2) / n
    m4 = _centered_power_sum(cols, m, 4) / n
    g2 = m4 / (m2 * m2) - F.lit(3.0)
    big_g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, F.lit(None)).when(m2 == 0, F.lit(0.0)).otherwise(big_g2)


def _non_null_sorted(cols) -> Column:
    return F.sort_array(F.filter(F.array(*[_d(c) for c in cols]), lambda v: v.isNotNull()))


def row_median(cols: Sequence[ColumnOrName]) -> Column:
    """Median of the non-missing values (mean of the middle two)."""
    arr = _non_null_sorted(cols)
    n = F.size(arr)
    lo = F.element_at(arr, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(arr, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lo + hi) / 2)


def row_min(cols: Sequence[ColumnOrName]) -> Column:
    return F.least(*[_d(c) for c in cols])


def row_max(cols: Sequence[ColumnOrName]) -> Column:
    return F.greatest(*[_d(c) for c in cols])


def row_weighted_sum(cols: Sequence[ColumnOrName], weights: Sequence[float]) -> Column:
    """sum(w_i * x_i), missing as 0."""
    return sum((F.coalesce(_d(c), F.lit(0.0)) * F.lit(float(w)) for c, w in zip(cols, weights)),
               F.lit(0.0))
