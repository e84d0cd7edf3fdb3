"""Registry of this subpackage's queries, and helpers they share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``, with DuckDB SQL for the same rows if there is any."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate table to the shared folder and read it back
    (lineage is cut, and a lost executor costs a read, not a recomputation)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Within it, the shuffle files of a query go as soon as the query has ended; else they stay on disk until
    the driver happens to collect its garbage.  For steps whose tables are stored or collected, each once."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before) if before is not None else spark.conf.unset(_SWEEP)


def give_back() -> None:
    """Returns what is free in this process to the system.  Spark keeps a Python worker after its task, and
    several of them share an executor's memory with each other and the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # glibc
        trim(0)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join between two Python steps: joined by a shuffle, however small it is.  Steps
    that no shuffle parts run in one task and take a Python worker each, and Spark keeps both from then on."""
    return df.hint("merge")


BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows: whole texts are
    long, and a default batch of ten thousand takes hundreds of MB on both sides.
    The session's batch size is lowered, never raised."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``arrow_map`` over a function that yields one dict of columns at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        give_back()
        for b in batches:
            if b.num_rows:
                for cols in fn(b):
                    arrays = [cols[f.name] for f in target]
                    arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, type=f.type)
                              for a, f in zip(arrays, target)]
                    arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target)]
                    yield pa.RecordBatch.from_arrays(arrays, names=target.names)
                b = cols = arrays = None
        give_back()

    return arrow_map(df, run, schema)
