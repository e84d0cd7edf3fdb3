"""Deterministic splits, folds, bags and re-weighting.

Membership comes from a hash of the row id, never from ``rand()`` or row
order, so it is reproducible across runs, partitionings and executor
losses.  The hash is the first 32 bits of ``md5(id)`` (portable: the same
number in any SQL engine with md5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import row_number


def stable_hash(c: str | Column, salt: str = "") -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    if salt:
        x = F.concat(x, F.lit(salt))
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint")


def hash_bucket(c: str | Column, k: int, salt: str = "") -> Column:
    return F.pmod(stable_hash(c, salt), F.lit(k)).cast("int")


def holdout_split(df: DataFrame, id_col: str, test_pct: int = 30, salt: str = "") -> DataFrame:
    """``is_holdout`` = 1 for about ``test_pct`` % of the ids."""
    return df.withColumn("is_holdout", (F.pmod(stable_hash(id_col, salt), F.lit(100)) < test_pct).cast("int"))


def kfold_assign(df: DataFrame, id_col: str, k: int = 5, salt: str = "") -> DataFrame:
    return df.withColumn("fold", hash_bucket(id_col, k, salt))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, **kw) -> DataFrame:
    """Per label, rows ordered by (hash, id) are dealt round-robin into k
    folds: folds are disjoint, exhaustive, within one row of equal size and
    class-balanced.  The per-label order is a distributed row number."""
    src = df.withColumn("__h", stable_hash(id_col))
    rn = row_number(src, ["__h", id_col], "__rn", parts=[label], **kw)
    return rn.withColumn("fold", F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__h", "__rn")


def bag_assign(df: DataFrame, id_col: str, n_bags: int = 11, salt: str = "") -> DataFrame:
    """Disjoint bags by id hash (each bag trains one model)."""
    return df.withColumn("bag", hash_bucket(id_col, n_bags, salt))


def downsample_majority(df: DataFrame, id_col: str, label: str, keep_pct: int,
                        majority_value=0, salt: str = "") -> DataFrame:
    """Keep every minority row and about ``keep_pct`` % of the majority
    class (by id hash: deterministic)."""
    keep = (F.col(label) != F.lit(majority_value)) | \
           (F.pmod(stable_hash(id_col, salt), F.lit(100)) < keep_pct)
    return df.where(keep)


def class_weight_column(label: str, positive_weight: float, out: str = "weight") -> Column:
    return F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)).alias(out)
