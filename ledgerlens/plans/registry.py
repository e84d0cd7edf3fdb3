"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    its DuckDB oracle (omitted for non-SQL operators: rows-only check)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(c: Column | str, places: int = 6) -> Column:
    """Round a noisy double for the oracle comparison."""
    return F.round((F.col(f"`{c}`") if isinstance(c, str) else c).cast("double"), places)


def round_columns(df: DataFrame, cols, places: int = 6) -> DataFrame:
    cols = set(cols)
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def sql_rnd(expr: str, alias: str, places: int = 6) -> str:
    return f'round(CAST({expr} AS DOUBLE), {places}) AS "{alias}"'


def round_map(df: DataFrame, places: dict) -> DataFrame:
    """One select rounding each listed column to its own number of places."""
    return df.select(*[rnd(c, places[c]).alias(c) if c in places else F.col(f"`{c}`") for c in df.columns])
