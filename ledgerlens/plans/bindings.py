"""Role bindings of the credit-risk data model onto the test tables.

=================  ==========================================================
role               test binding
=================  ==========================================================
applicant (root)   ``customer`` joined to ``nation``; ``TARGET`` is NULL for
                   the "unlabelled" applicants (negative balance: no outcome
                   yet), else ``c_mktsegment = 'BUILDING'``
loan (child, PK)   ``orders``: status F/O/P gives the approved/refused/
                   active subsets, ``DAYS_DECISION`` a negative day offset
balance line       ``lineitem`` with the root key attached from ``orders``;
(grandchild)       ``MONTHS_BALANCE = -l_linenumber``
sparse child       ``events`` (``user_id`` -> ``c_custkey``; most applicants
                   have none)
=================  ==========================================================

Money columns are read as ``DECIMAL(12,2)`` so sums and means are exact and
independent of partitioning.  Each Spark builder has a DuckDB twin
(``SQL_*``, a CTE body) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import bounded_broadcast, scan_table

# Fixed values of the bindings (must be equal on the Spark and SQL side).
ANCHOR_DATE = "2001-08-02"
MONEY = "decimal(12,2)"  # up to 10^10 with cents: sums run over exact long units
UNLABELLED_BALANCE_BELOW = 0
POSITIVE_SEGMENT = "BUILDING"


def applicants(spark: SparkSession, d: str) -> DataFrame:
    c = scan_table(spark, d, "customer")
    n = scan_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    target = (F.when(F.col("c_acctbal") < UNLABELLED_BALANCE_BELOW, F.lit(None))
              .otherwise((F.col("c_mktsegment") == POSITIVE_SEGMENT).cast("int")))
    # nation is a dimension table: broadcast after a row-count check, so
    # the applicant table is not shuffled for this join; a left join, since
    # the root keeps applicants of unknown nations
    return (c.join(bounded_broadcast(n, 10_000), c.c_nationkey == n.n_nationkey, "left")
            .select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name",
                    "n_regionkey", target.cast("int").alias("TARGET")))


SQL_APPLICANTS = f"""SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, n_name, n_regionkey,
  CASE WHEN c_acctbal < {UNLABELLED_BALANCE_BELOW} THEN NULL
       ELSE CAST(c_mktsegment = '{POSITIVE_SEGMENT}' AS INTEGER) END AS TARGET
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""


def loans(spark: SparkSession, d: str) -> DataFrame:
    o = scan_table(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast(MONEY).alias("AMT_PRICE"),
        F.datediff(F.to_date("o_orderdate"), F.lit(ANCHOR_DATE).cast("date")).alias("DAYS_DECISION"))


SQL_LOANS = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  CAST(o_totalprice AS DECIMAL(18,2)) AS AMT_PRICE,
  CAST(CAST(o_orderdate AS DATE) - DATE '{ANCHOR_DATE}' AS INTEGER) AS DAYS_DECISION
  FROM orders"""


def balance_lines(spark: SparkSession, d: str) -> DataFrame:
    """Balance lines keyed by their loan only (no root key)."""
    li = scan_table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        "l_quantity",
        F.col("l_extendedprice").cast(MONEY).alias("AMT_EXT"),
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.datediff(F.to_date("l_shipdate"), F.lit(ANCHOR_DATE).cast("date")).alias("DAYS_SHIP"))


def loan_owner(spark: SparkSession, d: str) -> DataFrame:
    """``(l_orderkey, o_custkey)``: which applicant a loan belongs to."""
    return scan_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Balance lines with the root key attached (join on the loan key)."""
    bl = balance_lines(spark, d)
    return bl.join(loan_owner(spark, d), "l_orderkey").select(
        "l_orderkey", "o_custkey", *[c for c in bl.columns if c != "l_orderkey"])


SQL_LINES = f"""SELECT l_orderkey, o_custkey, l_linenumber, -l_linenumber AS MONTHS_BALANCE,
  l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS AMT_EXT, l_discount, l_tax,
  l_returnflag, l_linestatus,
  CAST(CAST(l_shipdate AS DATE) - DATE '{ANCHOR_DATE}' AS INTEGER) AS DAYS_SHIP
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def activity(spark: SparkSession, d: str) -> DataFrame:
    e = scan_table(spark, d, "events")
    return e.select(F.col("user_id").alias("c_custkey"), "event_id", "event_type",
                    F.col("value").cast(MONEY).alias("AMT_VALUE"))


SQL_ACTIVITY = """SELECT user_id AS c_custkey, event_id, event_type,
  CAST(value AS DECIMAL(18,2)) AS AMT_VALUE FROM events"""


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH name AS (sql), ... body`` for the oracle queries."""
    if not ctes:
        return body
    parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


def lines_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Balance lines with manufactured missing values (the test tables have
    none): zero discount/tax, quantity outside returned lines, ship offset of
    the first three lines."""
    li = scan_table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
        F.nullif("l_discount", F.lit(0.0)).alias("DISC"),
        F.nullif("l_tax", F.lit(0.0)).alias("TAX"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("Q_R"),
        F.when(F.col("l_linenumber") > 3, F.datediff(F.to_date("l_shipdate"),
                                                     F.lit(ANCHOR_DATE).cast("date"))).alias("LATE"))


SQL_LINES_NULLS = f"""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
  NULLIF(l_discount, 0.0) AS DISC, NULLIF(l_tax, 0.0) AS TAX,
  CASE WHEN l_returnflag = 'R' THEN l_quantity END AS Q_R,
  CASE WHEN l_linenumber > 3 THEN CAST(CAST(l_shipdate AS DATE) - DATE '{ANCHOR_DATE}' AS INTEGER) END AS LATE
  FROM lineitem"""


# Deterministic per-applicant model scores (the "submission files" of the
# blending/ranking operators), derived from the customer table.
SCORE_NAMES = ["LGB", "XGB", "CGB", "ET", "RF"]


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    a = applicants(spark, d)
    k, nk, bal = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    seg = (F.col("c_mktsegment") == POSITIVE_SEGMENT).cast("double")
    s1 = F.pmod(k * 7919, F.lit(1000)).cast("double") / 1000.0
    s2 = (bal + 1000.0) / 11000.0
    s3 = F.pmod(k * 104729 + nk, F.lit(997)).cast("double") / 997.0
    s4 = seg * 0.3 + s1 * 0.7
    s5 = seg * 0.5 + s3 * 0.5
    return a.select("c_custkey", "TARGET", s1.alias("LGB"), s2.alias("XGB"), s3.alias("CGB"),
                    s4.alias("ET"), s5.alias("RF"))


SQL_SCORES = f"""SELECT c_custkey, TARGET,
  CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS LGB,
  (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS XGB,
  CAST((c_custkey * 104729 + c_nationkey) % 997 AS DOUBLE) / 997.0::DOUBLE AS CGB,
  CAST(c_mktsegment = '{POSITIVE_SEGMENT}' AS DOUBLE) * 0.3::DOUBLE + CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE * 0.7::DOUBLE AS ET,
  CAST(c_mktsegment = '{POSITIVE_SEGMENT}' AS DOUBLE) * 0.5::DOUBLE + CAST((c_custkey * 104729 + c_nationkey) % 997 AS DOUBLE) / 997.0::DOUBLE * 0.5::DOUBLE AS RF
  FROM ({SQL_APPLICANTS})"""


# Row-wise features of one balance line: integral values and 0/1 flags, with
# the missing values of ``lines_nulls``.  No pivot: every line is one row.
LINE_VALUES = ["V1", "V2", "V3", "V4", "V5", "V6"]
LINE_FLAGS = ["F1", "F2", "F3", "F4", "F5"]


def line_wide(spark: SparkSession, d: str) -> DataFrame:
    li = scan_table(spark, d, "lineitem")
    late = F.datediff(F.to_date("l_shipdate"), F.lit(ANCHOR_DATE).cast("date"))

    def flag(c):
        return c.cast("int")

    return li.select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("SHIP_YEAR"),
        F.col("l_quantity").cast("double").alias("V1"),
        F.nullif(F.round(F.col("l_discount") * 100), F.lit(0.0)).alias("V2"),
        F.nullif(F.round(F.col("l_tax") * 100), F.lit(0.0)).alias("V3"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("double")).alias("V4"),
        F.when(F.col("l_linenumber") > 3, late.cast("double")).alias("V5"),
        F.floor("l_extendedprice").cast("double").alias("V6"),
        flag(F.col("l_returnflag") == "R").alias("F1"), flag(F.col("l_linestatus") == "O").alias("F2"),
        flag(F.col("l_quantity") > 25).alias("F3"),
        F.when(F.col("l_linenumber") > 3, flag(F.col("l_discount") > 0.05)).alias("F4"),
        flag(F.col("l_tax") > 0.04).alias("F5"))


SQL_LINE_WIDE = f"""SELECT l_orderkey, l_linenumber, year(CAST(l_shipdate AS DATE)) AS SHIP_YEAR,
  CAST(l_quantity AS DOUBLE) AS V1, NULLIF(round(l_discount * 100), 0.0) AS V2, NULLIF(round(l_tax * 100), 0.0) AS V3,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) END AS V4,
  CASE WHEN l_linenumber > 3 THEN CAST(CAST(l_shipdate AS DATE) - DATE '{ANCHOR_DATE}' AS DOUBLE) END AS V5,
  CAST(floor(l_extendedprice) AS DOUBLE) AS V6,
  CAST(l_returnflag = 'R' AS INTEGER) AS F1, CAST(l_linestatus = 'O' AS INTEGER) AS F2,
  CAST(l_quantity > 25 AS INTEGER) AS F3, CASE WHEN l_linenumber > 3 THEN CAST(l_discount > 0.05 AS INTEGER) END AS F4,
  CAST(l_tax > 0.04 AS INTEGER) AS F5 FROM lineitem"""


IMPORTANCE_FEATURES = ["l_quantity", "DISC", "TAX", "Q_R", "LATE", "NONE_F"]


def importance_long(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """``(feature, fold, importance)``: a per-fold importance table derived
    from the balance lines (importance = distinct values of the feature in
    the fold; ``NONE_F`` is never present, so its importance is 0)."""
    from ..operators.folds import kfold_assign
    x = lines_nulls(spark, d).withColumn(
        "NONE_F", F.when(F.col("l_quantity") > 100, F.col("l_quantity")))
    x = kfold_assign(x, "l_orderkey", k)
    long = x.select("fold", *[F.col(c).cast("double").alias(c) for c in IMPORTANCE_FEATURES]) \
        .unpivot(["fold"], IMPORTANCE_FEATURES, "feature", "value")
    return long.groupBy("feature", "fold").agg(F.countDistinct("value").cast("double").alias("importance"))


def sql_importance_long(k: int = 5) -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in IMPORTANCE_FEATURES)
    return (f"SELECT feature, CAST(fold AS INTEGER) AS fold, CAST(count(DISTINCT value) AS DOUBLE) AS importance FROM "
            f"(UNPIVOT (SELECT ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT % {k} AS fold, {cols} "
            f"FROM (SELECT *, CASE WHEN l_quantity > 100 THEN l_quantity END AS NONE_F FROM ({SQL_LINES_NULLS}))) "
            f"ON {', '.join(IMPORTANCE_FEATURES)} INTO NAME feature VALUE value) GROUP BY feature, fold")
