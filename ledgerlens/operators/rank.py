"""Global ranks, AUC and ROC without a single-partition window.

A global ``Window.orderBy`` moves every row to one task.  Instead:

1. collapse to one row per distinct ordering value (``groupBy``, with
   map-side combine, so a hot value costs one row);
2. range-partition the collapsed rows by (part, ordering value): a partition
   is a bucket, and there are as many as the session's shuffle partitions;
3. per-bucket totals (one row per bucket and part) give each bucket's offset
   by a window over those few rows;
4. inside each bucket a partitioned window adds the running count.

``rank = offset + running count before + 1`` is exact; the same prefix sums
give average ranks (ties), the Mann-Whitney AUC and the ROC points.  There is
no other path for small inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(counts: DataFrame, order_cols: Sequence[str], weights: Sequence[str],
                parts: Sequence[str] = (), buckets: int | None = None, previous: Sequence[str] = ()) -> DataFrame:
    """For each row add ``{w}_before`` (sum of ``w`` over rows of the same
    ``parts`` that sort strictly before it by ``order_cols``) and
    ``{w}_total`` (sum over the part).  Rows must be unique per
    (parts, order_cols).  Columns in ``previous`` also give ``{c}_previous``,
    their value in the row just before (NULL in a part's first row): a bucket's
    last row is handed to the next bucket of the part.

    ``buckets`` defaults to the session's shuffle partitions.  A hot part is
    spread over the buckets its values fall into; offsets are a window over
    per-(part, bucket) totals."""
    from ..session import shared_dir
    parts, order_cols, weights = list(parts), list(order_cols), list(weights)
    spark = counts.sparkSession
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the collapsed table is read twice and its bucket numbers must not
    # change: materialise it once in the shared checkpoint folder
    shared_dir(spark)
    b = (counts.repartitionByRange(n_buckets, *[F.col(f"`{c}`") for c in (*parts, *order_cols)])
         .withColumn("__b", F.spark_partition_id()).checkpoint(eager=True))
    key = F.struct(*[F.col(f"`{c}`") for c in order_cols])
    totals = b.groupBy(*parts, "__b").agg(*[F.sum(w).alias(w) for w in weights],
                                          *[F.max_by(F.col(c), key).alias(f"__last_{c}") for c in previous])
    before_b = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    offsets = totals.select(
        *parts, "__b",
        *[F.coalesce(F.sum(w).over(before_b), F.lit(0)).cast("double").alias(f"__off_{w}") for w in weights],
        *[F.sum(w).over(whole).cast("double").alias(f"{w}_total") for w in weights],
        *[F.lag(f"__last_{c}").over(Window.partitionBy(*parts).orderBy("__b")).alias(f"__last_{c}") for c in previous])
    if not parts:
        offsets = F.broadcast(offsets)  # one row per bucket
    win = (Window.partitionBy(*parts, "__b").orderBy(*order_cols)
           .rowsBetween(Window.unboundedPreceding, -1))
    joined = b.join(offsets, [*parts, "__b"])
    return joined.select(
        *[F.col(c) for c in b.columns if c != "__b"],
        *[(F.col(f"__off_{w}") + F.coalesce(F.sum(w).over(win), F.lit(0))).alias(f"{w}_before")
          for w in weights],
        *[F.col(f"{w}_total") for w in weights],
        *[F.coalesce(F.lag(c).over(Window.partitionBy(*parts, "__b").orderBy(*order_cols)), F.col(f"__last_{c}"))
          .alias(f"{c}_previous") for c in previous])


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                    groups: Sequence[str] = (), names: Sequence[str] | None = None, **kw) -> DataFrame:
    """Exact percentiles with linear interpolation (the rule of Spark's
    ``percentile``) per group, without holding a group's values in one
    task: values are collapsed to (group, value, count), positioned with
    distributed prefix sums, and only the rows at the wanted positions are
    aggregated."""
    groups = list(groups)
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = (df.where(v.isNotNull()).groupBy(*groups, v.alias("__v"))
              .agg(F.count(F.lit(1)).alias("__cnt")))
    ps = prefix_sums(counts, ["__v"], ["__cnt"], groups, **kw)
    before, cnt, total = F.col("__cnt_before"), F.col("__cnt"), F.col("__cnt_total")

    def holds(i: Column) -> Column:
        return (before <= i) & (i < before + cnt)

    exprs, finals = [], []
    for j, p in enumerate(probs):
        pos = (total - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        exprs += [F.max(F.when(holds(lo), F.col("__v"))).alias(f"__lo{j}"),
                  F.max(F.when(holds(hi), F.col("__v"))).alias(f"__hi{j}"),
                  F.max(pos).alias(f"__pos{j}")]
        lv, hv, ps_ = F.col(f"__lo{j}"), F.col(f"__hi{j}"), F.col(f"__pos{j}")
        finals.append(F.when((F.floor(ps_) == F.ceil(ps_)) | (lv == hv), lv)
                      .otherwise((F.ceil(ps_) - ps_) * lv + (ps_ - F.floor(ps_)) * hv).alias(names[j]))
    # the collapsed rows also give the distinct and total counts for free
    exprs += [F.count(F.lit(1)).alias("n_distinct"), F.max(total).cast("long").alias("n")]
    agg = ps.groupBy(*groups).agg(*exprs) if groups else ps.agg(*exprs)
    return agg.select(*groups, *finals, "n_distinct", "n")


def multi_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    groups: Sequence[str] = (), **kw) -> DataFrame:
    """Exact quantiles of several columns in one distributed pass: the
    columns are unpivoted to ``(groups, column_name, value)`` and the column
    name becomes part of the group.  Returns ``(groups, column_name, q0..)``."""
    groups = list(groups)
    long = df.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("__x"))
        for c in columns])).alias("__s")).select(*groups, "__s.column_name", "__s.__x")
    return exact_quantiles(long, "__x", probs, [*groups, "column_name"], **kw)


def distributed_mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest value:
    (key, value) counts, then ``min_by`` per key — both with partial
    aggregation, so a hot key never gathers its values in one task."""
    keys = list(keys)
    c = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
         .agg(F.count(F.lit(1)).alias("__n")))
    return c.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("__n"), F.col(value))).alias(out))


def rank(df: DataFrame, column: str, out: str, method: str = "min", ascending: bool = True,
         parts: Sequence[str] = (), **kw) -> DataFrame:
    """pandas-style rank of ``column`` (1-based; NULL for missing values).
    method: ``min`` | ``max`` | ``average`` | ``dense``."""
    parts = list(parts)
    v = F.col(column) if ascending else -F.col(column)
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(*parts, v.alias("__v")).agg(F.count(F.lit(1)).alias("__cnt"))
              .withColumn("__one", F.lit(1)))
    ps = prefix_sums(counts, ["__v"], ["__cnt", "__one"], parts, **kw)
    if method == "min":
        r = F.col("__cnt_before") + 1
    elif method == "max":
        r = F.col("__cnt_before") + F.col("__cnt")
    elif method == "average":
        r = F.col("__cnt_before") + (F.col("__cnt") + 1) / 2.0
    elif method == "dense":
        r = F.col("__one_before") + 1
    else:
        raise ValueError(method)
    table = ps.select(*parts, F.col("__v"), r.cast("double").alias(out))
    # one row per distinct value: a shuffle join (AQE broadcasts it when it
    # measures small, and splits the partition of a hot value); missing
    # scores have no rank and never meet in a join partition
    known = df.where(F.col(column).isNotNull()).withColumn("__v", v).join(table, [*parts, "__v"], "left").drop("__v")
    missing = df.where(F.col(column).isNull()).withColumn(out, F.lit(None).cast("double"))
    return known.unionByName(missing)


def rank_columns(df: DataFrame, key: str, columns: Sequence[str], method: str = "min", **kw) -> DataFrame:
    """``key`` and the rank of every column, in one pass: one unpivot to
    (key, column, value), one ranking with the column as the part, one pivot
    back per key (``key`` must be unique)."""
    cols = list(columns)
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "__column", "__value")
    ranked = rank(long, "__value", "__rank", method=method, parts=["__column"], **kw)
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("__column") == c, F.col("__rank"))).alias(c) for c in cols])


def row_number(df: DataFrame, order_cols: Sequence[str], out: str, parts: Sequence[str] = (),
               **kw) -> DataFrame:
    """1-based position in a total order (``order_cols`` must be unique per
    part).  Distributed; no single-task window."""
    src = df.withColumn("__one", F.lit(1))
    ps = prefix_sums(src, order_cols, ["__one"], parts, **kw)
    return ps.withColumn(out, (F.col("__one_before") + 1).cast("long")) \
        .drop("__one", "__one_before", "__one_total")


def auc_exact(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties counted half (Mann-Whitney U)."""
    c = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("__pos"),
                             F.sum((F.col(label) != 1).cast("long")).alias("__neg")))
    ps = prefix_sums(c, [score], ["__neg"])
    return ps.agg(
        (F.sum(F.col("__pos") * (F.col("__neg_before") + F.col("__neg") / 2.0))
         / (F.sum("__pos") * F.sum("__neg"))).alias("auc"),
        F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"))


def roc_curve_points(df: DataFrame, score: str, label: str, drop_intermediate: bool = False) -> DataFrame:
    """One ROC point per distinct score used as threshold (score >= t):
    ``(threshold, fpr, tpr)``.

    With ``drop_intermediate`` a point goes if the step that leads to it equals
    the step to the next lower threshold, so it lies inside a straight stretch;
    the points of the highest and the lowest threshold stay."""
    c = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("__pos"),
                             F.sum((F.col(label) != 1).cast("long")).alias("__neg")))
    if drop_intermediate:
        c = c.withColumn("__step", F.struct("__pos", "__neg"))
    ps = prefix_sums(c, [score], ["__pos", "__neg"], previous=["__step"] if drop_intermediate else [])
    tp = F.col("__pos_total") - F.col("__pos_before")
    fp = F.col("__neg_total") - F.col("__neg_before")
    if drop_intermediate:
        ps = ps.where(F.col("__step_previous").isNull() | (F.col("__step_previous") != F.col("__step"))
                      | ((tp == F.col("__pos")) & (fp == F.col("__neg"))))
    return ps.select(F.col(score).cast("double").alias("threshold"),
                     (fp / F.col("__neg_total")).alias("fpr"),
                     (tp / F.col("__pos_total")).alias("tpr"))


def min_max_scale(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) with the global extremes from one aggregate."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    return df.withColumn(out, F.try_divide(x - F.lit(lo), F.lit(hi) - F.lit(lo)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Distributed top-k (per-partition top-k then merge)."""
    return df.orderBy(*order).limit(k)


def kth_largest_threshold(df: DataFrame, column: str, k: int) -> Column:
    """Select strictly greater than the (k+1)-th largest value (ties at the
    threshold are all dropped); the threshold is one value from a top-k."""
    vals = df.select(column).orderBy(F.desc(column)).limit(k + 1).collect()
    thr = vals[k][0] if len(vals) > k else None
    return F.col(column) > F.lit(thr) if thr is not None else F.lit(True)
