"""Scalar features (F*) and row-wise statistics (H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import rowwise as R
from ..operators.profile import fit_zscore
from ..sources.io import scan_table
from . import bindings as B
from .registry import query, rnd

W = B.with_ctes
LN = {"lines_n": B.SQL_LINES_NULLS}


@query("safe_ratio", """SELECT l_orderkey, l_linenumber,
l_tax / NULLIF(l_discount, 0) AS TAX_PER_DISC,
-l_tax / NULLIF(l_discount, 0) AS NEG_TAX_PER_DISC,
(l_tax - l_tax) / NULLIF(l_discount - l_discount, 0) AS ZERO_ZERO,
l_extendedprice / NULLIF(1 + l_discount, 0) AS PRICE_SHIFTED FROM lineitem""")
def safe_ratio(spark, d):
    li = scan_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.safe_ratio("l_tax", "l_discount").alias("TAX_PER_DISC"),
                     X.safe_ratio(-F.col("l_tax"), "l_discount").alias("NEG_TAX_PER_DISC"),
                     X.safe_ratio(F.col("l_tax") - F.col("l_tax"),
                                  F.col("l_discount") - F.col("l_discount")).alias("ZERO_ZERO"),
                     X.shifted_ratio("l_extendedprice", "l_discount").alias("PRICE_SHIFTED"))


@query("arith_features", """SELECT l_orderkey, l_linenumber,
l_extendedprice - l_quantity AS PRICE_MINUS_QTY, l_quantity * l_tax AS QTY_TAX,
l_extendedprice + l_tax AS PRICE_PLUS_TAX, l_quantity * NULLIF(l_discount, 0.0) AS QTY_DISC,
NULLIF(l_discount, 0.0) - NULLIF(l_tax, 0.0) AS DISC_MINUS_TAX FROM lineitem""")
def arith_features(spark, d):
    x = scan_table(spark, d, "lineitem")
    disc, tax = F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))
    return x.select("l_orderkey", "l_linenumber",
                    (F.col("l_extendedprice") - F.col("l_quantity")).alias("PRICE_MINUS_QTY"),
                    (F.col("l_quantity") * F.col("l_tax")).alias("QTY_TAX"),
                    (F.col("l_extendedprice") + F.col("l_tax")).alias("PRICE_PLUS_TAX"),
                    (F.col("l_quantity") * disc).alias("QTY_DISC"),
                    (disc - tax).alias("DISC_MINUS_TAX"))


@query("recency_scaled_amount", W("""SELECT o_orderkey,
CASE WHEN DAYS_DECISION < 0 THEN CAST(AMT_PRICE AS DOUBLE) / sqrt(CAST(-DAYS_DECISION AS DOUBLE)) END AS WEIGHTED_PRICE
FROM l""", l=B.SQL_LOANS))
def recency_scaled_amount(spark, d):
    return B.loans(spark, d).select("o_orderkey",
                                    X.recency_scaled("AMT_PRICE", "DAYS_DECISION").alias("WEIGHTED_PRICE"))


_DUE = "CASE WHEN DISC IS NOT NULL THEN -(l_linenumber * 300) END"


@query("dpd_dbd", W(f"""SELECT l_orderkey, l_linenumber,
CASE WHEN LATE - ({_DUE}) > 0 THEN LATE - ({_DUE}) ELSE 0 END AS DPD,
CASE WHEN ({_DUE}) - LATE > 0 THEN ({_DUE}) - LATE ELSE 0 END AS DBD FROM lines_n""", **LN))
def dpd_dbd(spark, d):
    x = B.lines_nulls(spark, d)
    due = F.when(F.col("DISC").isNotNull(), -(F.col("l_linenumber") * 300))
    return x.select("l_orderkey", "l_linenumber", X.clamp_zero(F.col("LATE") - due).alias("DPD"),
                    X.clamp_zero(due - F.col("LATE")).alias("DBD"))


@query("clip_column", W("""SELECT l_orderkey, l_linenumber,
CASE WHEN Q_R IS NULL THEN NULL WHEN Q_R >= 45 THEN 45 ELSE Q_R END AS Q_R_CLIP,
CASE WHEN l_linenumber - 3 >= 3 THEN 3 WHEN l_linenumber - 3 <= -1 THEN -1 ELSE l_linenumber - 3 END AS LN_CLIP,
CASE WHEN LATE IS NULL THEN NULL WHEN LATE <= -1500 THEN LATE ELSE 0 END AS LATE_CAP
FROM lines_n""", **LN))
def clip_column(spark, d):
    x = B.lines_nulls(spark, d)
    return x.select("l_orderkey", "l_linenumber", X.clip("Q_R", hi=45).alias("Q_R_CLIP"),
                    X.clip(F.col("l_linenumber") - 3, lo=-1, hi=3).alias("LN_CLIP"),
                    X.cap_else("LATE", -1500, 0).alias("LATE_CAP"))


def _fwb_sql(x, s, w, k, null_label=None):
    e = (f"CASE WHEN {x} IS NOT NULL THEN CAST(CAST(least(greatest(floor((CAST({x} AS DOUBLE) - {s}) / {w}) + 1, 0), {k}) "
         f"AS BIGINT) AS VARCHAR) END")
    return f"coalesce({e}, '{null_label}')" if null_label is not None else e


@query("fixed_width_bucket", f"""SELECT l_orderkey, l_linenumber,
{_fwb_sql("CASE WHEN l_returnflag = 'R' THEN l_extendedprice END", 50000, 25000, 12, '12')} AS PRICE_BIN,
{_fwb_sql("o_totalprice", 600000, 100000, 10)} AS TOTAL_BIN_A,
{_fwb_sql("o_totalprice", 400000, 200000, 4)} AS TOTAL_BIN_B
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fixed_width_bucket(spark, d):
    li = scan_table(spark, d, "lineitem")
    o = scan_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    price_r = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    # fixed (start, width, count) triples of the three income/credit binnings
    return x.select("l_orderkey", "l_linenumber",
                    X.fixed_width_bucket(price_r, 50000, 25000, 12, null_label="12").alias("PRICE_BIN"),
                    X.fixed_width_bucket("o_totalprice", 600000, 100000, 10).alias("TOTAL_BIN_A"),
                    X.fixed_width_bucket("o_totalprice", 400000, 200000, 4).alias("TOTAL_BIN_B"))


@query("threshold_dummy", W("""SELECT l_orderkey, l_linenumber, CAST(DISC > 0.05 AS INTEGER) AS DISC_GT,
CAST(TAX >= 0.04 AS INTEGER) AS TAX_GE, CAST(Q_R < 10 AS INTEGER) AS Q_R_LT,
CASE WHEN NULLIF(l_returnflag, 'A') IS NULL THEN NULL WHEN NULLIF(l_returnflag, 'A') = 'R' THEN 1 ELSE 0 END AS RETURNED
FROM lines_n""", **LN))
def threshold_dummy(spark, d):
    x = B.lines_nulls(spark, d)
    return x.select("l_orderkey", "l_linenumber", X.threshold_dummy("DISC", ">", 0.05).alias("DISC_GT"),
                    X.threshold_dummy("TAX", ">=", 0.04).alias("TAX_GE"),
                    X.threshold_dummy("Q_R", "<", 10).alias("Q_R_LT"),
                    X.binary_recode(F.nullif("l_returnflag", F.lit("A")), "R").alias("RETURNED"))


@query("zero_flag", W("""SELECT l_orderkey, l_linenumber,
CASE WHEN l_quantity - 1 = 0 THEN '0' WHEN l_quantity IS NOT NULL THEN '1' END AS QTY_ONE,
CASE WHEN Q_R - 10 = 0 THEN '0' WHEN Q_R IS NOT NULL THEN '1' END AS Q_R_TEN FROM lines_n""", **LN))
def zero_flag(spark, d):
    x = B.lines_nulls(spark, d)
    return x.select("l_orderkey", "l_linenumber", X.zero_flag(F.col("l_quantity") - 1).alias("QTY_ONE"),
                    X.zero_flag(F.col("Q_R") - 10).alias("Q_R_TEN"))


# ordinal maps of the order priorities and statuses (fixed values)
PRIORITY_RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
STATUS_CODE = {"F": 0, "O": 1, "P": 2}


@query("dict_map", """SELECT o_orderkey,
CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS PRIO_RANK,
CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS STATUS_CODE FROM orders""")
def dict_map(spark, d):
    o = scan_table(spark, d, "orders")
    return o.select("o_orderkey", X.dict_map("o_orderpriority", PRIORITY_RANK).alias("PRIO_RANK"),
                    X.dict_map("o_orderstatus", STATUS_CODE, fallback="error").alias("STATUS_CODE"))


@query("collapse_categories", """SELECT o_orderkey,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'others' END AS PRIO_TOP,
CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS PRIO_RENAMED FROM orders""")
def collapse_categories(spark, d):
    o = scan_table(spark, d, "orders")
    return o.select("o_orderkey", X.collapse_categories("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("PRIO_TOP"),
                    X.dict_map("o_orderpriority", {"5-LOW": "LOW"}, fallback="identity").alias("PRIO_RENAMED"))


@query("math_features", """SELECT l_orderkey, l_linenumber,
round(ln(l_extendedprice), 8) AS LN_PRICE, l_quantity * l_quantity AS QTY_SQ, sqrt(l_quantity) AS QTY_SQRT,
round((ln(l_extendedprice) - avg(ln(l_extendedprice)) OVER ()) / stddev_pop(ln(l_extendedprice)) OVER (), 6) AS LN_PRICE_Z
FROM lineitem""")
def math_features(spark, d):
    li = scan_table(spark, d, "lineitem").withColumn("LN_PRICE", X.safe_ln("l_extendedprice"))
    z = fit_zscore(li, ["LN_PRICE"])
    out = z.transform(li.select("l_orderkey", "l_linenumber", "LN_PRICE", "l_quantity"), suffix="_Z")
    return out.select("l_orderkey", "l_linenumber", rnd("LN_PRICE", 8).alias("LN_PRICE"),
                      X.square("l_quantity").alias("QTY_SQ"), X.safe_sqrt("l_quantity").alias("QTY_SQRT"),
                      rnd("LN_PRICE_Z", 6).alias("LN_PRICE_Z"))


_PW = ["PRICE", "DAYS_DECISION", "o_custkey"]


def _pw_sql():
    out = []
    for a in _PW:
        for b in _PW:
            if a != b:
                out.append(f"CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) AS {a}_mul_{b}")
                out.append(f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0) AS {a}_div_{b}")
    return ", ".join(out)


@query("pairwise_features", W(f"SELECT o_orderkey, {_pw_sql()} FROM (SELECT *, CAST(AMT_PRICE AS DOUBLE) AS PRICE FROM l)",
                              l=B.SQL_LOANS))
def pairwise_features(spark, d):
    x = B.loans(spark, d).withColumn("PRICE", F.col("AMT_PRICE").cast("double"))
    return x.select("o_orderkey", *X.pairwise_features(_PW))


@query("blend_elementwise", W("""SELECT a.c_custkey, greatest(a.LGB, b.XGB) AS BLEND_MAX,
least(a.LGB, b.XGB) AS BLEND_MIN, (a.LGB + b.XGB) / 2 AS BLEND_MEAN
FROM s a JOIN s b USING (c_custkey)""", s=B.SQL_SCORES))
def blend_elementwise(spark, d):
    s = B.model_scores(spark, d)
    sub1 = s.select("c_custkey", "LGB")
    sub2 = s.select("c_custkey", "XGB")
    j = sub1.join(sub2, "c_custkey")  # key join replaces positional zip
    return j.select("c_custkey", F.greatest("LGB", "XGB").alias("BLEND_MAX"),
                    F.least("LGB", "XGB").alias("BLEND_MIN"),
                    ((F.col("LGB") + F.col("XGB")) / 2).alias("BLEND_MEAN"))


# ------------------------------------------------------------- row-wise ---

QS, RS = B.LINE_VALUES, B.LINE_FLAGS
OW = {"w": B.SQL_LINE_WIDE}


def _lst(cols):
    return "[" + ", ".join(cols) + "]"


@query("row_sum", W(f"SELECT l_orderkey, l_linenumber, " + " + ".join(f"coalesce({q}, 0)" for q in QS)
                    + " AS LINE_SUM, " + " + ".join(f"coalesce(CAST({r} AS DOUBLE), 0)" for r in RS)
                    + " AS FLAG_SUM FROM w", **OW))
def row_sum(spark, d):
    w = B.line_wide(spark, d)
    return w.select("l_orderkey", "l_linenumber", R.row_sum(QS).alias("LINE_SUM"), R.row_sum(RS).alias("FLAG_SUM"))


@query("row_mean_std", W(f"""SELECT l_orderkey, l_linenumber,
list_sum(list_filter({_lst(QS)}, lambda x: x IS NOT NULL)) / NULLIF(len(list_filter({_lst(QS)}, lambda x: x IS NOT NULL)), 0) AS LINE_MEAN,
round(list_aggregate({_lst(QS)}, 'stddev_samp'), 4) AS LINE_STD FROM w""", **OW))
def row_mean_std(spark, d):
    w = B.line_wide(spark, d)
    return w.select("l_orderkey", "l_linenumber", R.row_mean(QS).alias("LINE_MEAN"), rnd(R.row_std(QS), 4).alias("LINE_STD"))


@query("row_kurtosis", W(f"""SELECT l_orderkey, l_linenumber,
round(CASE WHEN len(list_filter({_lst(RS)}, lambda x: x IS NOT NULL)) < 4 THEN NULL
     WHEN list_aggregate({_lst(RS)}, 'var_pop') = 0 THEN 0.0
     ELSE list_aggregate({_lst(RS)}, 'kurtosis') END, 8) AS FLAG_KURT FROM w""", **OW))
def row_kurtosis(spark, d):
    w = B.line_wide(spark, d)
    return w.select("l_orderkey", "l_linenumber", rnd(R.row_kurtosis(RS), 8).alias("FLAG_KURT"))


@query("row_median_min_sum", W(f"""SELECT l_orderkey, l_linenumber, list_aggregate({_lst(QS)}, 'median') AS LINE_MEDIAN,
list_aggregate({_lst(QS)}, 'min') AS LINE_MIN, coalesce(list_sum({_lst(QS)}), 0.0) AS LINE_NANSUM FROM w""", **OW))
def row_median_min_sum(spark, d):
    w = B.line_wide(spark, d)
    return w.select("l_orderkey", "l_linenumber", R.row_median(QS).alias("LINE_MEDIAN"), R.row_min(QS).alias("LINE_MIN"),
                    R.row_sum(QS).alias("LINE_NANSUM"))


# fixed blend weights of the stack-level features
SCORE_WEIGHTS = [0.3, 0.25, 0.2, 0.15, 0.1]


@query("row_score_stats", W(f"""SELECT c_custkey,
round(list_aggregate({_lst(B.SCORE_NAMES)}, 'var_pop'), 8) AS SCORE_VAR,
round(LGB + XGB + CGB + ET + RF, 10) AS SCORE_SUM,
greatest(LGB, XGB, CGB, ET, RF) AS SCORE_MAX, least(LGB, XGB, CGB, ET, RF) AS SCORE_MIN,
round({' + '.join(f'{n} * {w}' for n, w in zip(B.SCORE_NAMES, SCORE_WEIGHTS))}, 10) AS SCORE_WSUM
FROM s""", s=B.SQL_SCORES))
def row_score_stats(spark, d):
    s = B.model_scores(spark, d)
    n = B.SCORE_NAMES
    return s.select("c_custkey", rnd(R.row_var(n, ddof=0), 8).alias("SCORE_VAR"),
                    rnd(R.row_sum(n), 10).alias("SCORE_SUM"), R.row_max(n).alias("SCORE_MAX"),
                    R.row_min(n).alias("SCORE_MIN"),
                    rnd(R.row_weighted_sum(n, SCORE_WEIGHTS), 10).alias("SCORE_WSUM"))
