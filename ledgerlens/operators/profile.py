"""Column statistics: imputation, scaling, label statistics, histograms,
correlations, winsorising.

Fit steps are one ``agg`` each (all columns at once, partial aggregation);
their result is one row of scalars that goes back into the plan as
literals.  Apply steps are a single ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import _long


def _fit_scalars(df: DataFrame, exprs) -> dict:
    return df.agg(*exprs).first().asDict()


# ------------------------------------------------------------- imputation ---

@dataclass
class MeanImputer:
    means: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])).alias(c)
                           if c in self.means else F.col(c) for c in df.columns])


def fit_mean_imputer(df: DataFrame, columns: Sequence[str]) -> MeanImputer:
    vals = _fit_scalars(df, [F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return MeanImputer(vals)


# ---------------------------------------------------------------- scaling ---

@dataclass
class ZScore:
    stats: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.stats:
                m, s = self.stats[c]
                out.append(F.try_divide(F.col(c).cast("double") - F.lit(m), F.lit(s)).alias(c + suffix))
                if suffix:
                    out.insert(len(out) - 1, F.col(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


def fit_zscore(df: DataFrame, columns: Sequence[str]) -> ZScore:
    """Population mean / std (ddof 0), as in the reference's numpy code."""
    exprs = []
    for c in columns:
        x = F.col(c).cast("double")
        exprs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    v = _fit_scalars(df, exprs)
    return ZScore({c: (v[f"{c}__m"], v[f"{c}__s"]) for c in columns})


@dataclass
class RobustScale:
    stats: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            F.try_divide(F.col(c).cast("double") - F.lit(self.stats[c][0]), F.lit(self.stats[c][1])).alias(c)
            if c in self.stats else F.col(c) for c in df.columns])


def fit_robust_scale(df: DataFrame, columns: Sequence[str], exact: bool = True) -> RobustScale:
    """(x - median) / (q75 - q25); exact percentiles by default, approximate
    (``percentile_approx``) at scale."""
    if exact:
        from .brackets import bracketed_quantiles
        v = {c: q.values for c, q in bracketed_quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    else:
        v = _fit_scalars(df, [F.percentile_approx(F.col(c).cast("double"), F.array(
            F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000)).alias(c) for c in columns])
    stats = {}
    for c in columns:
        q = v[c]
        if q is None or q[0] is None:
            stats[c] = (None, None)
        else:
            iqr = q[2] - q[0]
            stats[c] = (q[1], iqr if iqr != 0 else None)
    return RobustScale(stats)


# ------------------------------------------------------- label statistics ---

def crosstab_pivot(df: DataFrame, column: str, label: str = "TARGET", values=(0, 1)) -> DataFrame:
    """Value x label contingency table, one column per label value."""
    exprs = [F.count_if(F.col(label) == F.lit(v)).alias(f"{label}_{v}") for v in values]
    return df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(column).agg(*exprs)


def missing_target_lift(df: DataFrame, columns: Sequence[str], label: str = "TARGET",
                        min_gap: float = 0.02) -> DataFrame:
    """Per column: label rate where it is missing vs present and the number
    of missing rows; keeps columns whose rates differ by more than
    ``min_gap`` and that have rows on both sides.  One pass."""
    lab = df.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    exprs = []
    for c in columns:
        miss = F.col(c).isNull()
        exprs += [F.avg(F.when(miss, y)).alias(f"{c}__rate_missing"),
                  F.avg(F.when(~miss, y)).alias(f"{c}__rate_present"),
                  F.count_if(miss).alias(f"{c}__n_missing"),
                  F.count_if(~miss).alias(f"{c}__n_present")]
    long = _long(lab.agg(*exprs), columns, ["rate_missing", "rate_present", "n_missing", "n_present"])
    gap = F.abs(F.col("rate_missing") - F.col("rate_present"))
    return (long.where((F.col("n_missing") > 0) & (F.col("n_present") > 0) & (gap > min_gap))
            .withColumn("gap", gap))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    src = df.where(F.col(column).isNotNull()) if dropna else df
    return src.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def class_histogram(df: DataFrame, column: str, label: str, lo: float, hi: float,
                    n_bins: int) -> DataFrame:
    """Histogram of a column per class on fixed bins (the data under a
    per-class density plot): ``(label, bin, n_rows)``."""
    x = F.col(column).cast("double")
    b = F.least(F.greatest(F.floor((x - lo) / ((hi - lo) / n_bins)), F.lit(0)), F.lit(n_bins - 1))
    return (df.where(x.isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(label), b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows")))


def column_kind(df: DataFrame, max_levels: int = 15, exact: bool = True) -> DataFrame:
    """'categorical' if the column is a string or has fewer than
    ``max_levels`` distinct values, else 'continuous' — over the whole
    column (deterministic), one pass."""
    cnt = F.countDistinct if exact else F.approx_count_distinct
    v = df.agg(*[cnt(F.col(c)).alias(f"{c}__n_distinct") for c in df.columns])
    long = _long(v, df.columns, ["n_distinct"])
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    kind = F.when(F.col("column_name").isin(strings) | (F.col("n_distinct") < max_levels),
                  F.lit("categorical")).otherwise(F.lit("continuous"))
    return long.withColumn("kind", kind)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, one aggregate: ``(a, b, corr)``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    exprs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}__corr")
             for a, b in pairs]
    long = _long(df.agg(*exprs), [f"{a}|{b}" for a, b in pairs], ["corr"])
    return long.select(F.split("column_name", r"\|").getItem(0).alias("a"),
                       F.split("column_name", r"\|").getItem(1).alias("b"), "corr")


def winsor_bounds(df: DataFrame, columns: Sequence[str], lower: float = 0.001,
                  upper: float = 0.999, min_distinct: int = 30, exact: bool = True) -> dict:
    """Percentile bounds per column, or None for columns with fewer than
    ``min_distinct`` distinct values or all values distinct (ids).

    Exact mode brackets the percentiles (``brackets``).  The guards mostly follow from
    those passes; only columns they leave open (few landmarks, or no repeated
    value met) have their distinct values counted."""
    out = {}
    if exact:
        from .brackets import bracketed_quantiles, distinct_and_repeats
        found = bracketed_quantiles(df, columns, [lower, upper])
        unsure = [c for c, q in found.items() if q.n and (q.n_distinct_at_least < min_distinct or not q.has_repeats)]
        counted = distinct_and_repeats(df, unsure)
        for c, q in found.items():
            enough, repeats = ((counted[c][0] >= min_distinct, counted[c][1]) if c in counted
                               else (True, q.has_repeats))
            out[c] = tuple(q.values) if q.n and enough and repeats else None
        return out
    exprs = []
    for c in columns:
        x = F.col(c).cast("double")
        exprs += [F.percentile_approx(x, F.array(F.lit(lower), F.lit(upper)), F.lit(10000)).alias(f"{c}__q"),
                  F.approx_count_distinct(x).alias(f"{c}__nd"), F.count(x).alias(f"{c}__n")]
    v = _fit_scalars(df, exprs)
    for c in columns:
        nd, n, q = v[f"{c}__nd"], v[f"{c}__n"], v[f"{c}__q"]
        out[c] = None if (nd < min_distinct or nd == n or q is None) else (q[0], q[1])
    return out


def winsor_to_null(df: DataFrame, bounds: dict) -> DataFrame:
    """Values outside the open interval (lo, hi) -> NULL."""
    out = []
    for c in df.columns:
        b = bounds.get(c)
        if b is None:
            out.append(F.col(c))
        else:
            x = F.col(c)
            out.append(F.when((x > F.lit(b[0])) & (x < F.lit(b[1])), x).alias(c))
    return df.select(*out)
