"""Stored marts: bucketed tables that join on their key without a shuffle."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path
from ledgerlens.sources import io as IO


def _stored(spark, n, name, buckets=4):
    df = spark.range(n).select((F.col("id") * 3).cast("int").alias("k"), F.col("id").cast("string").alias(name),
                               F.when(F.col("id") % 2 == 0, F.col("id").cast("decimal(12,2)")).alias(f"{name}'s"))
    return IO.save_mart(df, scratch_path(spark, name), "k", buckets), df


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_of_stored_marts_has_no_exchange(spark):
    paths = [_stored(spark, n, name) for n, name in ((500, "a"), (300, "b"), (0, "c"))]
    a, b, c = (IO.open_mart(spark, p) for p, _ in paths)
    joined = IO.join_marts(a, [b, c], "k")
    assert "Exchange" not in _plan(joined) and _plan(joined).count("Bucketed: true") == 3
    plain = paths[0][1].join(paths[1][1], "k", "left").join(paths[2][1], "k", "left")
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))
    per_key = a.groupBy("k").agg(F.max("a").alias("m"))
    assert "Exchange" not in _plan(per_key)


def test_a_later_session_registers_the_layout(spark):
    path, df = _stored(spark, 40, "later")
    name = spark.read.json(f"{path}/layout").first()["name"]
    spark.sql(f"DROP TABLE `{name}`")                  # a new session's catalog is empty
    again = IO.open_mart(spark, path)
    assert again.schema.simpleString() == df.schema.simpleString()
    assert sorted(again.collect()) == sorted(df.collect())
    other = IO.open_mart(spark, _stored(spark, 60, "other")[0])
    assert "Exchange" not in _plan(IO.join_marts(again, [other], "k"))


def test_a_stored_mart_is_never_overwritten(spark):
    path, df = _stored(spark, 10, "kept")
    with pytest.raises(Exception, match="(?i)exist"):
        IO.save_mart(df.limit(1), path, "k", 4)
    assert IO.open_mart(spark, path).count() == 10
