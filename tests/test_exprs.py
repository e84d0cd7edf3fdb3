"""Scalar NULL/inf rules on hand frames."""

from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X


def col_values(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_safe_ratio_nulls_every_zero_division(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 1.0), (2, -1.0, 0.0), (3, 0.0, 0.0),
                                (4, None, 1.0), (5, 1.0, None)], "id int, a double, b double")
    out = df.select("id", X.safe_ratio("a", "b").alias("r"))
    assert col_values(out, "r") == [None, 2.0, None, None, None, None]
    out = df.select("id", X.shifted_ratio("a", "b").alias("r"))
    assert col_values(out, "r") == [1.0, 1.0, -1.0, 0.0, None, None]


def test_sentinel_null_and_flag(spark):
    df = spark.createDataFrame([(0, 365243), (1, -100), (2, None)], "id int, d int")
    out = df.select("id", X.sentinel_to_null("d", 365243).alias("v"), X.sentinel_flag("d", 365243).alias("f"))
    assert col_values(out, "v") == [None, -100, None]
    assert col_values(out, "f") == [1, 0, None]


def test_clamp_zero_maps_missing_to_zero(spark):
    df = spark.createDataFrame([(0, 3), (1, -2), (2, 0), (3, None)], "id int, x int")
    assert col_values(df.select("id", X.clamp_zero("x").alias("c")), "c") == [3, 0, 0, 0]


def test_fixed_width_bucket_half_open_edges(spark):
    vals = [49999.0, 50000.0, 74999.0, 75000.0, 325000.0, None]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, x double")
    out = df.select("id", X.fixed_width_bucket("x", 50000, 25000, 12, null_label="12").alias("b"),
                    X.fixed_width_bucket("x", 50000, 25000, 12).alias("k"))
    assert col_values(out, "b") == ["0", "1", "1", "2", "12", "12"]
    assert col_values(out, "k") == ["0", "1", "1", "2", "12", None]


def test_flags_soft_and_hard(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, None), (2, None, None)], "id int, a double, b double")
    out = df.select("id", X.threshold_dummy("a", ">", 1.5).alias("t"), X.equal_flag("a", "b").alias("e"),
                    X.isin_flag("a", [2.0]).alias("i"), X.any_flag("a", "b").alias("o"),
                    X.zero_flag(F.col("a") - 1).alias("z"))
    assert col_values(out, "t") == [0, 1, None]
    assert col_values(out, "e") == [1, 0, 0]
    assert col_values(out, "i") == [0, 1, 0]
    assert col_values(out, "o") == [1, 1, 0]
    assert col_values(out, "z") == ["0", "1", None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(0, -3), (1, 1), (2, 7), (3, None)], "id int, x int")
    out = df.select("id", X.clip("x", lo=-1, hi=3).alias("c"), X.cap_else("x", 2, 3).alias("k"),
                    X.tri_bucket("x", 0, 5).alias("t"))
    assert col_values(out, "c") == [-1, 1, 3, None]
    assert col_values(out, "k") == [-3, 1, 3, None]
    assert col_values(out, "t") == ["0", "1", "2", None]


def test_dict_map_fallbacks(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "id int, c string")
    out = df.select("id", X.dict_map("c", {"a": "A"}).alias("n"),
                    X.dict_map("c", {"a": "A"}, fallback="identity").alias("i"),
                    X.collapse_categories("c", ["a"]).alias("k"))
    assert col_values(out, "n") == ["A", None, None]
    assert col_values(out, "i") == ["A", "b", None]
    assert col_values(out, "k") == ["a", "others", None]
    strict = df.select("id", X.dict_map("c", {"a": "A", "b": "B"}, fallback="error").alias("s"))
    assert col_values(strict, "s") == ["A", "B", None]


def test_infinite_to_null(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("inf")), (2, float("-inf")), (3, float("nan"))],
                               "id int, x double")
    assert col_values(df.select("id", X.infinite_to_null("x").alias("x")), "x") == [1.0, None, None, None]


def test_recency_scaled_needs_negative_days(spark):
    df = spark.createDataFrame([(0, 10.0, -4), (1, 10.0, 0), (2, 10.0, 3)], "id int, x double, d int")
    assert col_values(df.select("id", X.recency_scaled("x", "d").alias("r")), "r") == [5.0, None, None]
