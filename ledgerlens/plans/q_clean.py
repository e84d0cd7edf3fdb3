"""Filters, predicates, projections and column profiles (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import clean as C
from ..sources.io import scan_table
from . import bindings as B
from .registry import query

W = B.with_ctes
LN = {"lines_n": B.SQL_LINES_NULLS}
NULL_COLS = ["DISC", "TAX", "Q_R", "LATE"]


@query("filter_ne_nullsafe", """SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS PRIO FROM orders
WHERE NULLIF(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'""")
def filter_ne_nullsafe(spark, d):
    o = scan_table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("PRIO"))
    return C.filter_ne_nullsafe(o, "PRIO", "1-URGENT")


@query("split_labelled", W("""SELECT c_custkey, TARGET, 'train' AS part FROM a WHERE TARGET IS NOT NULL
UNION ALL SELECT c_custkey, TARGET, 'test' AS part FROM a WHERE TARGET IS NULL""", a=B.SQL_APPLICANTS))
def split_labelled(spark, d):
    a = B.applicants(spark, d).select("c_custkey", "TARGET")
    train, test = C.split_labelled(a)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("drop_columns", W("SELECT c_custkey, c_nationkey, c_acctbal, n_name, TARGET FROM a",
                         a=B.SQL_APPLICANTS))
def drop_columns(spark, d):
    return B.applicants(spark, d).drop("c_mktsegment", "n_regionkey")


@query("select_by_pattern", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem""")
def select_by_pattern(spark, d):
    li = scan_table(spark, d, "lineitem")
    return C.select_by_pattern(li, include=["l_"], exclude=["flag", "status"])


def _union_per_column(cols, fmt):
    return "\nUNION ALL ".join(fmt.format(c=c) for c in cols)


@query("missing_rate_profile", W(_union_per_column(
    NULL_COLS, "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
               "count(*) FILTER (WHERE {c} IS NULL) / count(*) AS missing_rate FROM lines_n"), **LN))
def missing_rate_profile(spark, d):
    return C.missing_rate_profile(B.lines_nulls(spark, d), NULL_COLS)


# at every scale factor Q_R (~67 %) and LATE (~43 %) are >= 40 % missing
@query("drop_sparse_columns", W("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag,
l_linestatus, DISC, TAX FROM lines_n""", **LN))
def drop_sparse_columns(spark, d):
    return C.drop_sparse_columns(B.lines_nulls(spark, d), 0.4, inclusive=True)


_NC = {
    "X_TEST_ONLY": "CASE WHEN TARGET IS NULL AND c_acctbal < -500 THEN NULL ELSE c_acctbal END",
    "X_BOTH": "CASE WHEN c_acctbal < 500 THEN NULL ELSE c_nationkey END",
    "c_acctbal": "c_acctbal",
}


@query("null_compat_columns", W(_union_per_column(
    list(_NC), "SELECT '{c}' AS column_name, count(*) FILTER (WHERE TARGET IS NOT NULL AND {c} IS NULL) AS nulls_0, "
               "count(*) FILTER (WHERE TARGET IS NULL AND {c} IS NULL) AS nulls_1, "
               "CAST(count(*) FILTER (WHERE TARGET IS NOT NULL AND {c} IS NULL) = 0 AND "
               "count(*) FILTER (WHERE TARGET IS NULL AND {c} IS NULL) > 0 AS INTEGER) AS drop FROM x"),
    a=B.SQL_APPLICANTS, x="SELECT TARGET, " + ", ".join(f"{v} AS {k}" for k, v in _NC.items()) + " FROM a"))
def null_compat_columns(spark, d):
    a = B.applicants(spark, d)
    x = a.select("TARGET", F.when(F.col("TARGET").isNull() & (F.col("c_acctbal") < -500), None)
                 .otherwise(F.col("c_acctbal")).alias("X_TEST_ONLY"),
                 F.when(F.col("c_acctbal") < 500, None).otherwise(F.col("c_nationkey")).alias("X_BOTH"),
                 "c_acctbal")
    train, test = C.split_labelled(x)
    return C.null_compat_profile(train, test, columns=list(_NC))


@query("sentinel_to_null", W("""SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 50.0) AS QTY_CLEAN,
CAST(Q_R = 50.0 AS INTEGER) AS Q_R_IS_SENTINEL FROM lines_n""", **LN))
def sentinel_to_null(spark, d):
    x = B.lines_nulls(spark, d)
    return x.select("l_orderkey", "l_linenumber",
                    X.sentinel_to_null("l_quantity", 50.0).alias("QTY_CLEAN"),
                    X.sentinel_flag("Q_R", 50.0).alias("Q_R_IS_SENTINEL"))


@query("sentinel_flag", W("""SELECT l_orderkey, l_linenumber, CAST(l_quantity = 50.0 AS INTEGER) AS QTY_50,
CAST(Q_R = 50.0 AS INTEGER) AS Q_R_50 FROM lines_n""", **LN))
def sentinel_flag(spark, d):
    x = B.lines_nulls(spark, d)
    return x.select("l_orderkey", "l_linenumber", X.sentinel_flag("l_quantity", 50.0).alias("QTY_50"),
                    X.sentinel_flag("Q_R", 50.0).alias("Q_R_50"))


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


@query("sentinel_scan", "SELECT * FROM (" + _union_per_column(
    _LI_NUM, "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = 50) AS n_hits FROM lineitem")
    + ") WHERE n_hits > 0")
def sentinel_scan(spark, d):
    return C.sentinel_scan(scan_table(spark, d, "lineitem"), 50)


@query("missing_flags", W("SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS {c}_NAN" for c in NULL_COLS) + " FROM lines_n", **LN))
def missing_flags(spark, d):
    return B.lines_nulls(spark, d).select("l_orderkey", "l_linenumber", *C.missing_flags(NULL_COLS))


@query("row_missing_count", W("SELECT l_orderkey, l_linenumber, " + " + ".join(
    f"CAST({c} IS NULL AS INTEGER)" for c in NULL_COLS) + " AS n_missing FROM lines_n", **LN))
def row_missing_count(spark, d):
    x = B.lines_nulls(spark, d).withColumn(
        "TARGET", F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.lit(1)))
    return x.select("l_orderkey", "l_linenumber",
                    C.row_missing_count(NULL_COLS + ["TARGET"]).alias("n_missing"))


@query("outlier_to_null", W("""SELECT o_orderkey,
CAST(CASE WHEN AMT_PRICE > 400000 THEN NULL ELSE AMT_PRICE END AS DOUBLE) AS AMT_PRICE_CLEAN,
CASE WHEN DAYS_DECISION < -2000 OR DAYS_DECISION > -10 THEN NULL ELSE DAYS_DECISION END AS DAYS_CLEAN,
CASE WHEN DAYS_DECISION < -100 THEN DAYS_DECISION END AS DAYS_BELOW
FROM l""", l=B.SQL_LOANS))
def outlier_to_null(spark, d):
    lo = B.loans(spark, d)
    return lo.select("o_orderkey",
                     X.outlier_to_null("AMT_PRICE", above=400000).cast("double").alias("AMT_PRICE_CLEAN"),
                     X.outlier_to_null("DAYS_DECISION", above=-10, below=-2000).alias("DAYS_CLEAN"),
                     X.outlier_to_null("DAYS_DECISION", keep_strictly_below=-100).alias("DAYS_BELOW"))


@query("equal_flag", W("""SELECT l_orderkey, l_linenumber, coalesce(CAST(DISC = TAX AS INTEGER), 0) AS DISC_EQ_TAX
FROM lines_n""", **LN))
def equal_flag(spark, d):
    return B.lines_nulls(spark, d).select("l_orderkey", "l_linenumber",
                                          X.equal_flag("DISC", "TAX").alias("DISC_EQ_TAX"))


@query("isin_flag", """SELECT l_orderkey, l_linenumber,
coalesce(CAST(l_quantity IN (10, 20, 30, 40, 50) AS INTEGER), 0) AS QTY_ROUND FROM lineitem""")
def isin_flag(spark, d):
    li = scan_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.isin_flag("l_quantity", [10.0, 20.0, 30.0, 40.0, 50.0]).alias("QTY_ROUND"))


@query("any_flag", W("""SELECT l_orderkey, l_linenumber,
CAST((coalesce(l_returnflag = 'R', false) OR coalesce(TAX <> 0, false) OR coalesce(l_linenumber = 1, false)) AS INTEGER) AS ANY_FLAG
FROM lines_n""", **LN))
def any_flag(spark, d):
    x = B.lines_nulls(spark, d).select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("a"),
        F.col("TAX").alias("b"), (F.col("l_linenumber") == 1).cast("int").alias("c"))
    return x.select("l_orderkey", "l_linenumber", X.any_flag("a", "b", "c").alias("ANY_FLAG"))


@query("pair_flag", """SELECT l_orderkey, l_linenumber,
CAST(l_returnflag = 'N' AND l_linestatus = 'O' AS INTEGER) AS BOTH_Y,
CAST(l_quantity - l_linenumber = 1 AND l_quantity <> 1 AS INTEGER) AS ONE_MORE FROM lineitem""")
def pair_flag(spark, d):
    li = scan_table(spark, d, "lineitem")
    ya = F.when(F.col("l_returnflag") == "N", "Y").otherwise("N")
    yb = F.when(F.col("l_linestatus") == "O", "Y").otherwise("N")
    return li.select("l_orderkey", "l_linenumber", ya.alias("A"), yb.alias("B"), "l_quantity") \
        .select("l_orderkey", "l_linenumber", X.both_equal_flag("A", "B", "Y").alias("BOTH_Y"),
                X.diff_one_flag("l_quantity", "l_linenumber").alias("ONE_MORE"))


@query("tri_bucket", W("""SELECT l_orderkey, l_linenumber,
CASE WHEN LATE IS NULL THEN NULL WHEN LATE < -1000 THEN '0' WHEN LATE < 0 THEN '1' ELSE '2' END AS LATE_BUCKET,
CASE WHEN DISC IS NULL THEN NULL WHEN DISC - 0.05 > -0.03 AND DISC - 0.05 < 0 THEN 1 ELSE 0 END AS DISC_NEAR
FROM lines_n""", **LN))
def tri_bucket(spark, d):
    x = B.lines_nulls(spark, d)
    return x.select("l_orderkey", "l_linenumber", X.tri_bucket("LATE", -1000, 0).alias("LATE_BUCKET"),
                    X.open_interval_flag(F.col("DISC") - 0.05, -0.03, 0).alias("DISC_NEAR"))


@query("drop_null_rows", W("SELECT l_orderkey, l_linenumber, DISC, TAX FROM lines_n "
                           "WHERE DISC IS NOT NULL AND TAX IS NOT NULL", **LN))
def drop_null_rows(spark, d):
    x = B.lines_nulls(spark, d).select("l_orderkey", "l_linenumber", "DISC", "TAX")
    return C.drop_null_rows(x, ["DISC", "TAX"])


@query("infinite_to_null", """SELECT l_orderkey, l_linenumber,
CASE WHEN isinf(l_quantity * 1e307) THEN NULL ELSE l_quantity * 1e307 END AS A,
CASE WHEN isinf(l_quantity * -5e306) THEN NULL ELSE l_quantity * -5e306 END AS B,
l_tax AS C FROM lineitem""")
def infinite_to_null(spark, d):
    li = scan_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 1e307).alias("A"),
        (F.col("l_quantity") * -5e306).alias("B"), F.col("l_tax").alias("C"))
    return C.infinite_to_null(li)
