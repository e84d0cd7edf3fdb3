"""The flagship plan: one wide row per applicant, with five child blocks.

root (applicants)                        1 row / key
  ⟕ previous loans   conditional aggregate: all + approved + refused
  ⟕ bureau           balance lines -> loan -> applicant: all + active + closed
  ⟕ POS              two-level, row-weighted, with dummies
  ⟕ installments     algebraic aggregate of derived payment columns
  ⟕ credit card      every numeric column x the same functions
  ⟕ activity         sparse child aggregate + no-child flag

The balance lines are shuffled once, by loan: one aggregate per loan holds the
partial sums of all four blocks that read them (``agg.MidPass``).  Joined to
the loans, one more aggregate per applicant yields the five blocks together,
so lines and loans are each read once for features.  The root and the sparse
child join on keys that their aggregates are already partitioned by.
Vocabularies for the dummy aggregates are fitted first (bounded, cached in
the model object; pass a stored model to skip that scan), so the plan itself
is static.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import agg as A
from ..operators.encode import OneHotModel, category_stat_encode, fit_one_hot_many
from . import bindings as B

KEY = "c_custkey"

# Aggregate specs of the mart (fixed values of the plan).
LOAN_SPEC = [
    ("AMT_PRICE", ["min", "max", "mean", "sum"]),
    ("DAYS_DECISION", ["min", "max", "mean", "var"]),
    ("PRICE_PER_DAY", ["mean", "max"]),
]
LINE_SPEC = [
    ("MONTHS_BALANCE", ["max", "min", "size"]),
    ("l_quantity", ["sum", "max"]),
    ("AMT_EXT", ["sum", "max", "min"]),
    ("DAYS_SHIP", ["min", "max"]),
]
# per loan, from its balance lines; then per applicant
BALANCE_SPEC = [("MONTHS_BALANCE", ["min", "max", "size"])]
BUREAU_SPEC = [
    ("BAL_MONTHS_BALANCE_MIN", ["min"]), ("BAL_MONTHS_BALANCE_MAX", ["max"]), ("BAL_MONTHS_BALANCE_SIZE", ["mean", "sum"]),
    ("DAYS_DECISION", ["min", "max", "mean"]), ("AMT_PRICE", ["max", "mean", "sum"]),
]
INSTAL_SPEC = [
    ("l_linenumber", ["max", "mean", "sum"]), ("DPD", ["max", "mean", "sum"]), ("DBD", ["max", "mean", "sum"]),
    ("PAYMENT_PERC", ["max", "mean", "sum"]), ("PAYMENT_DIFF", ["max", "mean", "sum"]),
    ("AMT_EXT", ["max", "mean", "sum", "min"]), ("DAYS_SHIP", ["max", "mean", "sum"]),
]
CARD_SPEC = A.spec_for(["l_quantity", "AMT_EXT", "l_discount", "l_tax", "MONTHS_BALANCE", "DAYS_SHIP"],
                       ["max", "mean", "min", "sum"])
BUREAU_SUBSETS = {"ACTIVE_": ("o_orderstatus", "O"), "CLOSED_": ("o_orderstatus", "F")}
RATE, RATE_COLUMNS = "decimal(4,2)", ["l_discount", "l_tax"]
PRICE_PER_UNIT = 1000    # the prescribed instalment of the derived payment columns, per unit
DAYS_PER_INSTALMENT = 300
ACTIVITY_SPEC = [("AMT_VALUE", ["sum", "mean", "max"])]
LOAN_SUBSETS = {"APPROVED_": ("o_orderstatus", "F"), "REFUSED_": ("o_orderstatus", "O")}


@dataclass
class MartModel:
    loan_vocab: OneHotModel
    line_vocab: OneHotModel
    activity_vocab: OneHotModel


def fit(loans: DataFrame, lines: DataFrame, activity: DataFrame) -> MartModel:
    """All vocabularies of the mart in one distributed distinct job."""
    return MartModel(*fit_one_hot_many([
        (loans, ["o_orderpriority", "o_orderstatus"], True),
        (lines, ["l_returnflag", "l_linestatus"], True),
        (activity, ["event_type"], False),
    ]))


def lines_by_loan(lines: DataFrame) -> DataFrame:
    """The lines, partitioned by loan before any column is derived from them: the shuffled rows are
    as narrow as the table's.  Rates are two-place decimals, so that their sums are exact like money's."""
    return lines.withColumns({c: F.col(c).cast(RATE) for c in RATE_COLUMNS}).repartition("l_orderkey")


def payment_columns(lines: DataFrame) -> DataFrame:
    """Instalment columns: paid share and difference, days past and before due (clamped at 0)."""
    due = -(F.col("l_linenumber") * DAYS_PER_INSTALMENT)
    return lines.select(
        "*", X.safe_ratio("AMT_EXT", "l_quantity").alias("PAYMENT_PERC"),
        (F.col("AMT_EXT") - (F.col("l_quantity") * PRICE_PER_UNIT).cast(B.MONEY)).cast(B.MONEY).alias("PAYMENT_DIFF"),
        X.clamp_zero(F.col("DAYS_SHIP") - due).alias("DPD"), X.clamp_zero(due - F.col("DAYS_SHIP")).alias("DBD"))


def loan_and_line_features(loans: DataFrame, lines: DataFrame, model: MartModel) -> DataFrame:
    """The five blocks that come from loans and their lines, per applicant."""
    detail = payment_columns(lines_by_loan(lines)).select("*", *model.line_vocab.dummy_exprs())
    lines_pass = (A.MidPass(detail, "l_orderkey", wide=True)
                  .weighted(LINE_SPEC + [(n, ["sum"]) for n in model.line_vocab.names], ["mean", "max"], "POS_", "POS_COUNT")
                  .direct(INSTAL_SPEC, "INSTAL_").direct(CARD_SPEC, "CC_"))
    lines_pass.partial += A.agg_exprs(BALANCE_SPEC, "BAL_", df=detail)
    # the loan row with its balance features, as the parent of the second level
    src = loans.withColumnRenamed("o_orderkey", "l_orderkey").withColumnRenamed("o_custkey", KEY).withColumn(
        "PRICE_PER_DAY", X.safe_ratio("AMT_PRICE", -F.col("DAYS_DECISION")))
    exprs = A.agg_exprs(LOAN_SPEC, "PREV_", df=src)
    for prefix, (c, v) in LOAN_SUBSETS.items():
        exprs += A.agg_exprs(LOAN_SPEC, prefix, F.col(c) == v, df=src)
    exprs += model.loan_vocab.agg_exprs(["mean"], "PREV_")
    exprs.append(F.count(F.lit(1)).alias("PREV_COUNT"))
    exprs += A.agg_exprs(BUREAU_SPEC, "BURO_", df=src)
    for prefix, (c, v) in BUREAU_SUBSETS.items():
        exprs += A.agg_exprs(BUREAU_SPEC, prefix, F.col(c) == v, df=src)
    return lines_pass.run(src, KEY, extra=exprs, how="left")


def activity_features(activity: DataFrame, vocab: OneHotModel) -> DataFrame:
    exprs = A.agg_exprs(ACTIVITY_SPEC, "EVT_", df=activity)
    exprs += vocab.agg_exprs(["sum"], "EVT_")
    exprs.append(F.count(F.lit(1)).alias("EVT_COUNT"))
    return activity.groupBy(KEY).agg(*exprs)


def root_features(applicants: DataFrame) -> DataFrame:
    enc = category_stat_encode(applicants, "n_name", "c_acctbal", "ACCTBAL_BY_NATION", "median")
    return enc.select(
        KEY, "TARGET", "c_acctbal", "c_nationkey", "n_regionkey",
        X.threshold_dummy("c_acctbal", "<", 0).alias("ACCTBAL_NEGATIVE"),
        X.safe_ratio("c_acctbal", "ACCTBAL_BY_NATION").alias("ACCTBAL_TO_NATION_MEDIAN"),
        "ACCTBAL_BY_NATION")


def build(spark: SparkSession, d: str, model: MartModel | None = None) -> DataFrame:
    app = B.applicants(spark, d)
    loans, lines, activity = B.loans(spark, d), B.balance_lines(spark, d), B.activity(spark, d)
    model = model or fit(loans, lines, activity)
    mart = (root_features(app)
            .join(loan_and_line_features(loans, lines, model), KEY, "left")
            .join(activity_features(activity, model.activity_vocab), KEY, "left"))
    return mart.withColumn("HAS_NO_ACTIVITY", F.col("EVT_COUNT").isNull().cast("int"))
