"""Cleaning and column-profile operators.

Whole-table profiles (missing rates, sentinel hits, null compatibility) are
one ``agg`` pass over all columns — a single job with partial aggregation —
whose one-row result is unpivoted to a long ``(column_name, ...)`` table.
Only that small profile reaches the driver when a column list has to be
decided (``drop_sparse_columns``, ``null_compatible_columns``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import infinite_to_null as _inf_to_null
from ..functions.rowwise import row_missing_count as _row_missing


def filter_ne_nullsafe(df: DataFrame, column: str, value: Any) -> DataFrame:
    """``df[df.c != v]`` keeping rows where c is missing."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def split_labelled(df: DataFrame, target: str = "TARGET") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())


def select_by_pattern(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                      keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains every ``include`` substring and none of
    the ``exclude`` substrings (plus ``keep``)."""
    cols = [c for c in df.columns
            if c in keep or (all(s in c for s in include) and not any(s in c for s in exclude))]
    return df.select(*cols)


def _long(one_row: DataFrame, names: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Unpivot a one-row frame with columns ``{name}__{value}``."""
    structs = [F.struct(F.lit(n).alias("column_name"),
                        *[F.col(f"`{n}__{v}`").alias(v) for v in value_cols]) for n in names]
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_rate_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, n_missing, missing_rate)`` in one pass."""
    columns = list(columns) if columns is not None else df.columns
    n = F.count(F.lit(1))
    exprs = []
    for c in columns:
        miss = F.count_if(F.col(c).isNull())
        exprs += [miss.alias(f"{c}__n_missing"), (miss / n).alias(f"{c}__missing_rate")]
    return _long(df.agg(*exprs), columns, ["n_missing", "missing_rate"])


def drop_sparse_columns(df: DataFrame, max_rate: float, inclusive: bool = True,
                        keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose missing rate is ``>= max_rate`` (``>`` when not
    inclusive).  The profile is one row per column on the driver."""
    prof = missing_rate_profile(df, [c for c in df.columns if c not in keep]).collect()
    bad = {r["column_name"] for r in prof
           if (r["missing_rate"] >= max_rate if inclusive else r["missing_rate"] > max_rate)}
    return df.select(*[c for c in df.columns if c not in bad])


def null_compat_profile(train: DataFrame, *others: DataFrame,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: nulls in train and in each other frame, and whether the
    column must go (no null in train but some elsewhere)."""
    columns = list(columns) if columns is not None else train.columns
    frames = [train, *others]
    counts = [f.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
              for f in frames]
    values = [f"nulls_{i}" for i in range(len(frames))]
    rows = [(c, *[int(r[c]) for r in counts]) for c in columns]
    long = train.sparkSession.createDataFrame(
        rows, "column_name string, " + ", ".join(f"{v} bigint" for v in values))
    other_nulls = sum((F.col(v) for v in values[1:]), F.lit(0))
    return long.withColumn("drop", ((F.col("nulls_0") == 0) & (other_nulls > 0)).cast("int"))


def null_compatible_columns(train: DataFrame, *others: DataFrame) -> list[str]:
    prof = null_compat_profile(train, *others).where("drop = 0").select("column_name").collect()
    keep = {r[0] for r in prof}
    return [c for c in train.columns if c in keep]


def sentinel_scan(df: DataFrame, value: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that contain ``value`` and how often: ``(column_name, n_hits)``."""
    columns = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if f.dataType.typeName() in
        ("integer", "long", "double", "float", "short", "decimal")]
    one = df.agg(*[F.count_if(F.col(c) == F.lit(value)).alias(f"{c}__n_hits") for c in columns])
    return _long(one, columns, ["n_hits"]).where("n_hits > 0")


def missing_flags(columns: Sequence[str], suffix: str = "_NAN") -> list[Column]:
    return [F.col(c).isNull().cast("int").alias(f"{c}{suffix}") for c in columns]


def row_missing_count(columns: Sequence[str], exclude: Sequence[str] = ("TARGET",)) -> Column:
    """Missing values per row; the label is excluded so unlabelled rows are
    not counted one higher."""
    return _row_missing([c for c in columns if c not in exclude])


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset))


def infinite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """±inf and NaN -> NULL in every (or the listed) floating column, one select."""
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[_inf_to_null(c).alias(c) if c in targets else F.col(c) for c in df.columns])
