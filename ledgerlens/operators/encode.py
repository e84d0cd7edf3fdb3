"""Categorical encoders with an explicit ``fit``.

The set of output columns depends on the data (one column per category), so
vocabularies are learned once in a ``fit`` action — a distributed distinct
with a hard cap on the number of levels — and kept in a small model object.
After that every plan is static and train/test get identical columns.
Lookup tables built from a vocabulary are bounded by that cap, which is what
makes broadcasting them safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import bounded_broadcast

MAX_LEVELS = 10_000


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() == "string" and f.name not in exclude]


@dataclass
class OneHotModel:
    """Sorted vocabulary per column; ``nan_column`` adds ``<col>_nan``."""

    levels: dict[str, list[str]]
    nan_column: bool = False
    sep: str = "_"
    names: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.names = []
        for c, vals in self.levels.items():
            self.names += [f"{c}{self.sep}{v}" for v in vals]
            if self.nan_column:
                self.names.append(f"{c}{self.sep}nan")

    def dummy_exprs(self) -> list[Column]:
        """0/1 dummy columns (a missing value is 0 in every value column)."""
        out = []
        for c, vals in self.levels.items():
            for v in vals:
                out.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                           .alias(f"{c}{self.sep}{v}"))
            if self.nan_column:
                out.append(F.col(c).isNull().cast("int").alias(f"{c}{self.sep}nan"))
        return out

    def transform(self, df: DataFrame, keep_source: bool = False) -> DataFrame:
        rest = [F.col(c) for c in df.columns if keep_source or c not in self.levels]
        return df.select(*rest, *self.dummy_exprs())

    def agg_exprs(self, funcs: Sequence[str] = ("mean",), prefix: str = "") -> list[Column]:
        """Dummy aggregates folded into a group-by: the dummies are never
        materialised on the detail table."""
        out = []
        for c, vals in self.levels.items():
            cases = [(v, F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)))
                     for v in vals]
            if self.nan_column:
                cases.append(("nan", F.col(c).isNull().cast("double")))
            for v, x in cases:
                for f in funcs:
                    if f == "mean":
                        e = F.avg(x)
                    elif f == "sum":
                        e = F.sum(x)
                    elif f == "max":
                        e = F.max(x)
                    elif f == "min":
                        e = F.min(x)
                    elif f == "std":
                        e = F.stddev_samp(x)
                    elif f == "var":
                        e = F.var_samp(x)
                    elif f == "median":  # a 0/1 column: the buffer holds two values
                        e = F.percentile(x, F.lit(0.5))
                    else:
                        raise ValueError(f)
                    out.append(e.alias(f"{prefix}{c}{self.sep}{v}_{f.upper()}"))
        return out


def fit_one_hot(df: DataFrame, columns: Sequence[str] | None = None, nan_column: bool = False,
                max_levels: int = MAX_LEVELS) -> OneHotModel:
    """Learn sorted levels of each categorical column in one distributed
    distinct.  ``max_levels`` is the caller's bound on the output's width: a
    column beyond it raises (use ``frequency_encode`` or ``factorize``, which
    have no limit)."""
    columns = list(columns) if columns is not None else categorical_columns(df)
    if not columns:
        return OneHotModel({}, nan_column)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                for c in columns]))
    cap = max_levels * len(columns)
    rows = (df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
            .distinct().limit(cap + 1).collect())
    if len(rows) > cap:
        raise ValueError("too many categorical levels for one-hot encoding")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        levels[r["c"]].append(r["v"])
    for c in columns:
        if len(levels[c]) > max_levels:
            raise ValueError(f"column {c} has more than {max_levels} levels")
        levels[c].sort()
    return OneHotModel(levels, nan_column)


def fit_one_hot_many(requests: Sequence[tuple[DataFrame, Sequence[str], bool]],
                     max_levels: int = MAX_LEVELS) -> list[OneHotModel]:
    """Fit several vocabularies (possibly over different tables) in one
    distributed distinct job: ``[(df, columns, nan_column), ...]``."""
    from functools import reduce
    parts = []
    for i, (df, cols, _) in enumerate(requests):
        pairs = F.explode(F.array(*[F.struct(F.lit(f"{i}:{c}").alias("c"), F.col(c).cast("string").alias("v"))
                                    for c in cols]))
        parts.append(df.select(pairs.alias("p")).select("p.c", "p.v"))
    n_cols = sum(len(cols) for _, cols, _ in requests)
    cap = max_levels * n_cols
    rows = (reduce(DataFrame.unionByName, parts).where(F.col("v").isNotNull())
            .distinct().limit(cap + 1).collect())
    if len(rows) > cap:
        raise ValueError("too many categorical levels for one-hot encoding")
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["c"], []).append(r["v"])
    models = []
    for i, (_, cols, nan) in enumerate(requests):
        levels = {c: sorted(found.get(f"{i}:{c}", [])) for c in cols}
        for c, vals in levels.items():
            if len(vals) > max_levels:
                raise ValueError(f"column {c} has more than {max_levels} levels")
        models.append(OneHotModel(levels, nan))
    return models


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, nan_column: bool = False):
    """``(encoded frame, new column names)``."""
    model = fit_one_hot(df, columns, nan_column)
    return model.transform(df), model.names


def align_columns(df: DataFrame, reference_columns: Sequence[str], fill=0) -> DataFrame:
    """Give ``df`` exactly the reference columns (left align): missing
    columns are filled, extra columns dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in reference_columns])


def _lookup_join(df: DataFrame, table: DataFrame, key: str, max_rows: int = MAX_LEVELS,
                 check: bool = False) -> DataFrame:
    """Left join of a per-level lookup table.  With ``check`` the table is
    counted and broadcast when it has at most ``max_rows`` rows; otherwise
    the join is planned as a shuffle join that AQE turns into a broadcast
    only after measuring the table at run time."""
    return df.join(bounded_broadcast(table, max_rows) if check else table, key, "left")


def factorize(df: DataFrame, column: str, order_col: str, out: str | None = None) -> DataFrame:
    """Integer codes in order of first appearance (smallest ``order_col``, ties
    by value); missing -> -1.  Codes are distributed row numbers, so the
    number of levels is not limited."""
    from .rank import row_number
    out = out or f"{column}_code"
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order_col).alias("__first"))
    codes = row_number(firsts, ["__first", column], "__code").select(column, (F.col("__code") - 1).cast("int").alias(out))
    joined = _lookup_join(df, codes, column)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def frequency_encode(df: DataFrame, column: str, out: str | None = None,
                     cap: int | None = None) -> DataFrame:
    """Position in the value counts (0 = most frequent; ties by value);
    positions beyond ``cap``, when given, are ``cap``.  Missing stays missing.
    Positions are distributed row numbers over one row per level."""
    from .rank import row_number
    out = out or f"{column}_freq"
    counts = (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg((-F.count(F.lit(1))).alias("__order")))
    code = F.col("__code") - 1
    if cap is not None:
        code = F.least(code, F.lit(cap))
    table = row_number(counts, ["__order", column], "__code").select(column, code.cast("int").alias(out))
    return _lookup_join(df, table, column)


def category_stat_encode(df: DataFrame, category: str, value: str, out: str,
                         stat: str = "median", fit_on: DataFrame | None = None) -> DataFrame:
    """Per-category statistic of ``value`` mapped back onto every row
    (groupBy with map-side combine + a bounded broadcast join)."""
    src = (fit_on if fit_on is not None else df).where(F.col(category).isNotNull())
    v = F.col(value).cast("double")
    if stat == "median":
        # exact and distributed: a category holding most rows is not one task
        from .rank import exact_quantiles
        table = exact_quantiles(src, value, [0.5], [category], names=[out]).drop("n_distinct", "n")
    else:
        e = {"mean": F.avg(v), "max": F.max(v), "min": F.min(v)}[stat]
        table = src.groupBy(category).agg(e.alias(out))
    # one row per category: counted, then broadcast when small, so the
    # (large) row side keeps its partitioning
    return _lookup_join(df, table, category, check=True)


def target_rate_by_category(df: DataFrame, category: str, target: str = "TARGET") -> DataFrame:
    """Mean and count of the label per category over labelled rows."""
    lab = df.where(F.col(target).isNotNull())
    return lab.groupBy(category).agg(F.avg(F.col(target).cast("double")).alias("target_mean"),
                                     F.count(F.lit(1)).alias("n_rows"))


def optimal_cuts(values: Sequence[float], weights: Sequence[float], k: int) -> list[int]:
    """Starts of the ``k`` runs of rising ``values`` with the least weighted squared
    distance to their run's mean (dynamic programme over the last run's start, a
    row of numpy work for each end).  Costs are compared at 12 places of the widest
    spread; among equal ones the smallest last start counts, then the smallest before it."""
    x, w = np.asarray(values, dtype=float), np.asarray(weights, dtype=float)
    n, k = len(x), min(k, len(x))
    if not n:
        return []
    x = x - np.average(x, weights=w)                    # squares about the mean lose no digits
    sw, sx, sq = (np.concatenate([[0.0], np.cumsum(t)]) for t in (w, w * x, w * x * x))
    tick = max(sq[-1], 1e-300) * 1e-12

    def run_cost(starts: np.ndarray, end: int) -> np.ndarray:
        total = sx[end] - sx[starts]
        return sq[end] - sq[starts] - total * total / (sw[end] - sw[starts])

    best = np.array([0.0] + [run_cost(np.array([0]), e)[0] for e in range(1, n + 1)])
    last = [np.zeros(n + 1, dtype=np.int64)]
    for runs in range(2, k + 1):
        cost, start = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for end in range(runs, n + 1):
            starts = np.arange(runs - 1, end)
            c = np.round((best[starts] + run_cost(starts, end)) / tick) * tick
            at = int(np.argmin(c))                       # the first of equal costs
            cost[end], start[end] = c[at], starts[at]
        best = cost
        last.append(start)
    cuts, end = [], n
    for start in reversed(last):
        end = int(start[end])
        cuts.append(end)
    return cuts[::-1]


def target_rate_clusters(df: DataFrame, category: str, target: str = "TARGET", k: int = 4,
                         max_rates: int = MAX_LEVELS) -> DataFrame:
    """Cluster categories by their label rate, optimally: of all ways to cut the
    sorted rates into ``k`` runs the one with the least squared distance to the runs'
    means, each category counting once.  Returns ``(category, target_mean,
    cluster_id)``, clusters numbered by rising rate; equal rates are never parted,
    and fewer than ``k`` different rates are a cluster each.

    The driver gets (rate, categories) pairs, at most ``max_rates`` (more raise), and
    the clusters go back as ``k - 1`` bounds."""
    rates = target_rate_by_category(df, category, target).select(category, "target_mean")
    shared = (rates.groupBy("target_mean").agg(F.count(F.lit(1)).alias("n")).orderBy("target_mean")
              .limit(max_rates + 1).collect())          # bounded
    if len(shared) > max_rates:
        raise ValueError(f"more than {max_rates} different rates of {category}")
    cuts = optimal_cuts([r["target_mean"] for r in shared], [r["n"] for r in shared], k)
    above = [(F.col("target_mean") >= F.lit(shared[i]["target_mean"])).cast("int") for i in cuts[1:]]
    return rates.withColumn("cluster_id", sum(above, F.lit(0)).cast("int"))


def target_rate_cluster_encode(df: DataFrame, category: str, target: str = "TARGET", k: int = 4,
                               out: str = "cluster_id") -> DataFrame:
    """Every row (labelled or not) with its category's cluster and one 0/1
    column per cluster; a category without labelled rows has no cluster."""
    table = target_rate_clusters(df, category, target, k).select(category, F.col("cluster_id").alias(out))
    rows = _lookup_join(df, table, category)
    return rows.select("*", *[F.coalesce((F.col(out) == i).cast("int"), F.lit(0)).alias(f"{out}_{i}") for i in range(k)])
