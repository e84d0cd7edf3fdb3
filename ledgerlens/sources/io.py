"""Scans and sinks.

Scans are plain ``spark.read`` calls with declared schemas for text formats
(no inference pass over the data), so Catalyst can prune columns and push
filters into the Parquet reader.  Sinks write Parquet (or CSV for the
submission file) into the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def scan_table(spark: SparkSession, d: str, name: str, fmt: str = "parquet",
               schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """Read ``{d}/{name}.{fmt}``.  CSV needs a schema (never inferred)."""
    path = os.path.join(d, f"{name}.{fmt}")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("declare a schema for CSV scans")
        return spark.read.schema(schema).option("header", header).csv(path)
    return spark.read.format(fmt).load(path)


def scan_limit(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by a key (deterministic, unlike a bare limit).
    Planned as a distributed top-k (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def multi_file_scan(spark: SparkSession, paths: Sequence[str], value_cols: Sequence[str] = ()) -> DataFrame:
    """One scan over many files, each row tagged with its file name."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select(F.col("_metadata.file_name").alias("file_name"), *value_cols)


def csv_scan(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, header: bool = True) -> DataFrame:
    """Scan of CSV files, folders or globs with a declared schema; without a
    header the schema's order names the columns.  Wrong rows fail the scan."""
    return (spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
            .csv(paths if isinstance(paths, str) else list(paths)))


def csv_glob(spark: SparkSession, pattern: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """Every file or folder matching ``*.csv`` in one scan, each row keyed by
    the name of its file (``file_name``; of a folder's parts, the folder's)."""
    df = csv_scan(spark, pattern, schema, header)
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, r"([^/]+\.csv)(?:/[^/]*)?$", 1).alias("file_name"), "*")


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    df.write.mode("overwrite").option("header", header).csv(path)
    return path


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after checking that ``df`` has at most
    ``max_rows`` rows; a bigger side is returned as is (shuffle join)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def write_table(df: DataFrame, path: str, bucket_key: str | None = None,
                partitions: int | None = None) -> str:
    """Parquet sink; with ``bucket_key`` rows of a key lie in one file, sorted, so that
    filters on the key prune.  Spark doesn't know the layout; joins without a shuffle
    need ``save_mart``."""
    w = df
    if bucket_key is not None:
        w = df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism,
                           bucket_key).sortWithinPartitions(bucket_key)
    w.write.mode("overwrite").parquet(path)
    return path


def sink_roundtrip(spark: SparkSession, df: DataFrame, name: str, bucket_key: str | None = None) -> DataFrame:
    """Write a feature table to the shared folder and read it back; cuts the
    lineage for downstream stages."""
    path = write_table(df, scratch_path(spark, name), bucket_key)
    return spark.read.parquet(path)


def _mart_ddl(name: str, fields: str, key: str, buckets: int, path: str) -> str:
    where = path.replace("'", "\\'")
    return (f"CREATE TABLE `{name}` ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {buckets} BUCKETS LOCATION '{where}'")


def save_mart(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Store a feature table as ``buckets`` sorted bucket files under ``path`` and its layout beside
    them.  Tables stored with the same number of buckets join on the key without a shuffle, in this
    session or a later one (``open_mart``).

    One task writes one bucket (the rows are clustered by the same hash that names the bucket), so
    every bucket is one sorted file; choose ``buckets`` so that one holds about 1 GB.  Marts have one
    row per key, so no bucket is hot.  The folder must be new: the layout of an existing one is never
    changed under its readers."""
    spark = df.sparkSession
    name = "mart_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")          # the catalog's entry only: the table is external
    (df.repartition(buckets, key).write.format("parquet").mode("errorifexists")
     .bucketBy(buckets, key).sortBy(key).option("path", f"{path}/data").saveAsTable(name))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    (spark.range(1).select(F.lit(name).alias("name"), F.lit(fields).alias("fields"), F.lit(key).alias("key"),
                           F.lit(buckets).alias("buckets")).coalesce(1).write.mode("errorifexists").json(f"{path}/layout"))
    return path


def open_mart(spark: SparkSession, path: str) -> DataFrame:
    """A table stored by ``save_mart``, with its buckets known to Spark.  A session that doesn't have
    it in its catalog yet registers it from the stored layout."""
    m = spark.read.schema("name string, fields string, key string, buckets int").json(f"{path}/layout").first()
    if m is None:
        raise FileNotFoundError(f"no stored mart in {path}")
    if not spark.catalog.tableExists(m["name"]):
        spark.sql(_mart_ddl(m["name"], m["fields"], m["key"], m["buckets"], f"{path}/data"))
    return spark.table(m["name"])


def join_marts(root: DataFrame, marts: Sequence[DataFrame], key: str) -> DataFrame:
    """The root with every mart's columns, in one left chain; sort-merge joins that read stored
    marts bucket by bucket (a broadcast would copy what already lies together)."""
    out = root.hint("merge")
    for m in marts:
        out = out.join(m.hint("merge"), key, "left")
    return out


def submission_frame(df: DataFrame, id_col: str, score_col: str, places: int | None = 8,
                     id_name: str | None = None, score_name: str | None = None) -> DataFrame:
    """``(id bigint, score double)``; optionally rounded like ``%.8f``."""
    s = F.col(score_col).cast("double")
    if places is not None:
        s = F.round(s, places)
    return df.select(F.col(id_col).cast("bigint").alias(id_name or id_col),
                     s.alias(score_name or score_col))


def write_submission(df: DataFrame, path: str) -> str:
    """CSV sink of a ``submission_frame`` (with header)."""
    return write_csv(df, path)


def parse_vector_line(lines: DataFrame, value_col: str = "value", sep: str = ",",
                      key_cols: Sequence[str] = ()) -> DataFrame:
    """A comma-joined line of floats -> ``(key..., position, weight)`` rows
    (position = 0-based index in the line)."""
    exploded = lines.select(*key_cols, F.posexplode(F.split(F.col(value_col), sep)).alias("position", "token"))
    return exploded.select(*key_cols, F.col("position").cast("int"),
                           F.trim("token").cast("double").alias("weight"))


def sample_rows(df: DataFrame, n: int, key: str, salt: str = "") -> DataFrame:
    """Deterministic sample of ``n`` rows: the smallest stable hashes of the
    key (a distributed top-k, not a scan of everything on one task)."""
    from ..operators.folds import stable_hash
    return df.withColumn("__h", stable_hash(key, salt)).orderBy("__h", key).limit(n).drop("__h")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, n_rows, n_cols)`` for each table; one count per table."""
    from functools import reduce
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows",
                     F.lit(len(df.columns)).cast("int").alias("n_cols"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
