"""Spec-driven aggregations (A*), imputation/scaling (M1, M3, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import agg as A
from ..operators import profile as P
from ..operators import rank as RK
from ..operators.encode import fit_one_hot
from ..sources.io import scan_table
from . import bindings as B
from .registry import query, round_columns

W = B.with_ctes


def _sql_agg(c, f, decimal=False, cond=None):
    v = c if cond is None else f"CASE WHEN {cond} THEN {c} END"
    if f in ("min", "max"):
        e = f"{f}({v})"
        return f"CAST({e} AS DOUBLE)" if decimal else e
    if f == "mean":
        return (f"CAST(sum({v}) AS DOUBLE) / count({v})" if decimal
                else f"avg(CAST({v} AS DOUBLE))")
    if f == "sum":
        return f"coalesce(CAST(sum({v}) AS DOUBLE), 0.0)"
    if f == "var":
        return f"var_samp(CAST({v} AS DOUBLE))"
    if f == "std":
        return f"stddev_samp(CAST({v} AS DOUBLE))"
    if f == "median":
        return f"median(CAST({v} AS DOUBLE))"
    if f == "size":
        return "count(*)" if cond is None else f"count(*) FILTER (WHERE {cond})"
    if f == "count":
        return f"count({v})"
    if f == "nunique":
        return f"count(DISTINCT {v})"
    raise ValueError(f)


def sql_spec(spec, prefix="", decimals=(), cond=None, rounding=None):
    """DuckDB select list of a spec (same names and NULL rules)."""
    rounding = rounding or {}
    out = []
    for c, funcs in A.spec_items(spec):
        for f in funcs:
            e = _sql_agg(c, f, c in decimals, cond)
            if cond is not None:
                e = f"CASE WHEN count(*) FILTER (WHERE {cond}) > 0 THEN {e} END"
            name = f"{prefix}{c}_{f.upper()}"
            if name in rounding:
                e = f"round(CAST({e} AS DOUBLE), {rounding[name]})"
            out.append(f'{e} AS "{name}"')
    return ", ".join(out)


def _round_spark(df, rounding):
    cols = df.columns
    return df.select(*[F.round(F.col(c).cast("double"), rounding[c]).alias(c) if c in rounding else F.col(c)
                       for c in cols])


# ------------------------------------------------------------------- A1 ---

BUREAU_SPEC = [("DAYS_DECISION", ["mean", "var", "min", "std", "median"]),
               ("AMT_PRICE", ["mean", "sum", "max"]),
               ("PRICE_PER_DAY", ["mean", "median"])]
BUREAU_ROUND = {"BURO_DAYS_DECISION_VAR": 3, "BURO_DAYS_DECISION_STD": 6, "BURO_PRICE_PER_DAY_MEAN": 4}
LOANS_PPD = ("SELECT *, CAST(AMT_PRICE AS DOUBLE) / CAST(NULLIF(-DAYS_DECISION, 0) AS DOUBLE) AS PRICE_PER_DAY "
             "FROM l")


def _loans_ppd(spark, d):
    return B.loans(spark, d).withColumn("PRICE_PER_DAY", X.safe_ratio("AMT_PRICE", -F.col("DAYS_DECISION")))


@query("agg_spec_bureau", W(f"SELECT o_custkey, {sql_spec(BUREAU_SPEC, 'BURO_', ['AMT_PRICE'], rounding=BUREAU_ROUND)} "
                            "FROM x GROUP BY o_custkey", l=B.SQL_LOANS, x=LOANS_PPD))
def agg_spec_bureau(spark, d):
    out = A.agg_by(_loans_ppd(spark, d), "o_custkey", BUREAU_SPEC, "BURO_")
    return _round_spark(out, BUREAU_ROUND)


PREV_SPEC = [("AMT_PRICE", ["min", "max", "mean", "sum"]), ("DAYS_DECISION", ["min", "max", "mean"]),
             ("o_orderpriority", ["nunique"]), ("o_orderkey", ["size"])]


@query("agg_spec_prev", W(f"SELECT o_custkey, {sql_spec(PREV_SPEC, 'PREV_', ['AMT_PRICE'])} FROM l GROUP BY o_custkey",
                          l=B.SQL_LOANS))
def agg_spec_prev(spark, d):
    return A.agg_by(B.loans(spark, d), "o_custkey", PREV_SPEC, "PREV_")


POS_SPEC = [("MONTHS_BALANCE", ["max", "mean", "size"]), ("l_quantity", ["max", "mean", "sum"])]
RF_LEVELS = ["A", "N", "R"]


def _pos_dummy_sql():
    out = []
    for v in RF_LEVELS + ["nan"]:
        x = "CASE WHEN l_returnflag IS NULL THEN 1.0 ELSE 0.0 END" if v == "nan" else \
            f"CASE WHEN l_returnflag = '{v}' THEN 1.0 ELSE 0.0 END"
        for f, g in (("max", "max"), ("mean", "avg"), ("sum", "sum")):
            out.append(f'{g}({x}) AS "POS_l_returnflag_{v}_{f.upper()}"')
    return ", ".join(out)


@query("agg_spec_pos", W(f"SELECT l_orderkey, {sql_spec(POS_SPEC, 'POS_')}, {_pos_dummy_sql()} FROM x GROUP BY l_orderkey",
                         x=B.SQL_LINES))
def agg_spec_pos(spark, d):
    li = B.balance_lines(spark, d)
    vocab = fit_one_hot(li, ["l_returnflag"], nan_column=True)
    return li.groupBy("l_orderkey").agg(*A.agg_exprs(POS_SPEC, "POS_", df=li),
                                        *vocab.agg_exprs(["max", "mean", "sum"], "POS_"))


# the repeated key keeps the last list: nunique is replaced by max/mean/sum
INS_SPEC = A.merge_specs({"l_linenumber": ["nunique"], "AMT_EXT": ["max", "mean", "sum", "min"]},
                         {"l_linenumber": ["max", "mean", "sum"], "DAYS_SHIP": ["max", "mean", "sum"],
                          "PAYMENT_PERC": ["max", "mean", "sum", "var"]})
INS_ROUND = {"INSTAL_PAYMENT_PERC_MEAN": 5, "INSTAL_PAYMENT_PERC_SUM": 5, "INSTAL_PAYMENT_PERC_VAR": 3}


@query("agg_spec_ins", W(f"SELECT o_custkey, {sql_spec(INS_SPEC, 'INSTAL_', ['AMT_EXT'], rounding=INS_ROUND)} "
                         "FROM (SELECT *, CAST(AMT_EXT AS DOUBLE) / NULLIF(l_quantity, 0) AS PAYMENT_PERC FROM x) "
                         "GROUP BY o_custkey", x=B.SQL_LINES))
def agg_spec_ins(spark, d):
    # algebraic spec: partial aggregates per loan, then the applicant key
    li = B.balance_lines(spark, d).withColumn("PAYMENT_PERC", X.safe_ratio("AMT_EXT", "l_quantity"))
    out = A.agg_spec_through_parent(li, "l_orderkey", B.loan_owner(spark, d), "o_custkey", INS_SPEC, "INSTAL_")
    return _round_spark(out, INS_ROUND)


CC_COLS = ["l_quantity", "AMT_EXT", "l_discount", "l_tax", "MONTHS_BALANCE", "DAYS_SHIP"]
CC_FUNCS = ["max", "mean", "min", "sum"]
CC_ROUND = {f"CC_{c}_{f}": 6 for c in ("l_discount", "l_tax") for f in ("MEAN", "SUM")}


@query("agg_all_columns", W(f"SELECT l_orderkey, {sql_spec(A.spec_for(CC_COLS, CC_FUNCS), 'CC_', ['AMT_EXT'], rounding=CC_ROUND)} "
                            "FROM x GROUP BY l_orderkey", x=B.SQL_LINES))
def agg_all_columns(spark, d):
    li = B.balance_lines(spark, d).select("l_orderkey", *CC_COLS)
    return _round_spark(A.agg_all_columns(li, "l_orderkey", CC_FUNCS, "CC_"), CC_ROUND)


@query("group_size", W("""SELECT l_orderkey, count(*) AS LINES_SIZE, count(DISC) AS DISC_COUNT,
count(Q_R) AS Q_R_COUNT FROM n GROUP BY l_orderkey""", n=B.SQL_LINES_NULLS))
def group_size(spark, d):
    x = B.lines_nulls(spark, d)
    return x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("LINES_SIZE"), F.count("DISC").alias("DISC_COUNT"),
                                       F.count("Q_R").alias("Q_R_COUNT"))


NUNIQUE_SPEC = [("l_partkey", ["nunique"]), ("l_suppkey", ["nunique"]), ("l_returnflag", ["nunique"])]


@query("agg_nunique", W(f"""SELECT o_custkey, {sql_spec(NUNIQUE_SPEC, 'INS_')} FROM
(SELECT l.*, o_custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_custkey"""))
def agg_nunique(spark, d):
    li = scan_table(spark, d, "lineitem")
    o = scan_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    columns = [c for c, _ in NUNIQUE_SPEC]
    return A.MidPass(li, "l_orderkey").distinct(columns, "INS_", levels={"l_returnflag": RF_LEVELS}).run(o, "o_custkey")


COND_SPEC = [("AMT_PRICE", ["mean", "sum", "max"]), ("DAYS_DECISION", ["max", "size", "median"])]


@query("conditional_agg", W(f"""SELECT o_custkey, {sql_spec(COND_SPEC, 'PREV_', ['AMT_PRICE'])},
{sql_spec(COND_SPEC, 'APPROVED_', ['AMT_PRICE'], cond="o_orderstatus = 'F'")},
{sql_spec(COND_SPEC, 'REFUSED_', ['AMT_PRICE'], cond="o_orderstatus = 'O'")} FROM l GROUP BY o_custkey""",
                            l=B.SQL_LOANS))
def conditional_agg(spark, d):
    lo = B.loans(spark, d)
    return A.conditional_agg(lo, "o_custkey", COND_SPEC, "PREV_",
                             {"APPROVED_": F.col("o_orderstatus") == "F",
                              "REFUSED_": F.col("o_orderstatus") == "O"})


TL_SPEC = [("l_quantity", ["mean", "sum", "max"]), ("MONTHS_BALANCE", ["min"]), ("AMT_EXT", ["sum"])]
TL_FEATS = [f"POS_{c}_{f.upper()}" for c, fs in TL_SPEC for f in fs]


def _tl_sql():
    lvl1 = (f"SELECT l_orderkey, o_custkey, {sql_spec(TL_SPEC, 'POS_', ['AMT_EXT'])} "
            "FROM x GROUP BY l_orderkey, o_custkey")
    lvl1 = lvl1.replace('coalesce(CAST(sum(AMT_EXT) AS DOUBLE), 0.0) AS "POS_AMT_EXT_SUM"',
                        'coalesce(sum(AMT_EXT), 0) AS "POS_AMT_EXT_SUM"')
    out = []
    for n in TL_FEATS:
        q = f'"{n}"'
        mean = (f"CAST(sum({q}) AS DOUBLE) / count({q})" if n == "POS_AMT_EXT_SUM"
                else f"round(avg(CAST({q} AS DOUBLE)), 6)")
        out += [f'{mean} AS "POS_{n}_MEAN"', f'CAST(max({q}) AS DOUBLE) AS "POS_{n}_MAX"',
                f'CAST(min({q}) AS DOUBLE) AS "POS_{n}_MIN"']
    # exploded form: every detail row carries its order's level-1 values
    return W(f"""SELECT o_custkey, {', '.join(out)}, count(*) AS POS_COUNT
FROM x JOIN lvl1 USING (l_orderkey, o_custkey) GROUP BY o_custkey""", x=B.SQL_LINES, lvl1=lvl1)


@query("two_level_weighted_agg", _tl_sql())
def two_level_weighted_agg(spark, d):
    out = A.two_level_weighted_agg(B.balance_lines(spark, d), "o_custkey", "l_orderkey", TL_SPEC,
                                   ["mean", "max", "min"], "POS_", count_name="POS_COUNT",
                                   mid_parent=B.loan_owner(spark, d))
    return round_columns(out, [f"POS_{n}_MEAN" for n in TL_FEATS if n != "POS_AMT_EXT_SUM"], 6)


BB_SPEC = [("MONTHS_BALANCE", ["min", "max", "size"]), ("RETURNED", ["mean"])]


def _two_level_sql():
    lvl1 = ("SELECT l_orderkey, min(MONTHS_BALANCE) AS MONTHS_BALANCE_MIN, max(MONTHS_BALANCE) AS MONTHS_BALANCE_MAX, "
            "count(*) AS MONTHS_BALANCE_SIZE, avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS RETURNED_MEAN "
            "FROM x GROUP BY l_orderkey")
    feats = ["MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX", "MONTHS_BALANCE_SIZE", "RETURNED_MEAN"]
    out = []
    for n in feats:
        m = f"avg(CAST({n} AS DOUBLE))"
        if n == "RETURNED_MEAN":
            m = f"round({m}, 8)"
        out += [f'{m} AS "BURO_{n}_MEAN"', f'max({n}) AS "BURO_{n}_MAX"']
    return W(f"""SELECT o_custkey, {', '.join(out)}, coalesce(CAST(sum(AMT_PRICE) AS DOUBLE), 0.0) AS "BURO_AMT_PRICE_SUM"
FROM l LEFT JOIN lvl1 ON o_orderkey = l_orderkey GROUP BY o_custkey""", x=B.SQL_LINES, l=B.SQL_LOANS, lvl1=lvl1)


@query("two_level_agg", _two_level_sql())
def two_level_agg(spark, d):
    lines = B.balance_lines(spark, d).withColumn("RETURNED", (F.col("l_returnflag") == "R").cast("double"))
    loans = B.loans(spark, d).withColumnRenamed("o_orderkey", "l_orderkey")
    out = A.two_level_agg(loans, lines, "l_orderkey", "o_custkey", BB_SPEC,
                          lambda feats: [(f, ["mean", "max"]) for f in feats] + [("AMT_PRICE", ["sum"])],
                          prefix2="BURO_", child_cols=["AMT_PRICE"])
    return round_columns(out, ["BURO_RETURNED_MEAN_MEAN"], 8)


@query("recency_weighted_mean", W("""SELECT o_custkey,
round(avg(l_quantity * CASE WHEN MONTHS_BALANCE < 0 THEN sqrt(-1.0 / MONTHS_BALANCE) END), 8) AS QTY_RECENCY_SQRT,
round(avg(l_quantity * CASE WHEN MONTHS_BALANCE < 0 THEN -1.0 / MONTHS_BALANCE END), 8) AS QTY_RECENCY_LIN
FROM x GROUP BY o_custkey""", x=B.SQL_LINES))
def recency_weighted_mean(spark, d):
    from ..functions.exprs import recency_weight
    q = F.col("l_quantity").cast("double")
    out = A.agg_through_parent(
        B.balance_lines(spark, d), "l_orderkey", B.loan_owner(spark, d), "o_custkey",
        {"QTY_RECENCY_SQRT": ("mean", q * recency_weight("MONTHS_BALANCE", 0.5)),
         "QTY_RECENCY_LIN": ("mean", q * recency_weight("MONTHS_BALANCE", 1))})
    return round_columns(out, ["QTY_RECENCY_SQRT", "QTY_RECENCY_LIN"], 8)


@query("weighted_average", W("""SELECT o_custkey,
round(sum(l_quantity * (-1.0 / MONTHS_BALANCE)) / sum(-1.0 / MONTHS_BALANCE), 8) AS QTY_WAVG
FROM x GROUP BY o_custkey""", x=B.SQL_LINES))
def weighted_average(spark, d):
    w = X.safe_ratio(F.lit(-1.0), "MONTHS_BALANCE")
    q = F.col("l_quantity").cast("double")
    both = q.isNotNull() & w.isNotNull()
    out = A.agg_through_parent(B.balance_lines(spark, d), "l_orderkey", B.loan_owner(spark, d), "o_custkey",
                               {"QTY_WAVG": ("ratio", F.when(both, q * w), F.when(both, w))})
    return round_columns(out, ["QTY_WAVG"], 8)


@query("agg_mode", W("""SELECT q.o_custkey, q.v AS QTY_MODE, f.v AS FLAG_MODE FROM
(SELECT o_custkey, v FROM (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS rn
  FROM (SELECT o_custkey, l_quantity AS v, count(*) AS n FROM x GROUP BY 1, 2)) WHERE rn = 1) q JOIN
(SELECT o_custkey, v FROM (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS rn
  FROM (SELECT o_custkey, l_returnflag AS v, count(*) AS n FROM x GROUP BY 1, 2)) WHERE rn = 1) f USING (o_custkey)""",
                     x=B.SQL_LINES))
def agg_mode(spark, d):
    li = B.lines(spark, d)
    return A.agg_by(li, "o_custkey", [("l_quantity", ["mode"]), ("l_returnflag", ["mode"])]) \
        .withColumnRenamed("l_quantity_MODE", "QTY_MODE").withColumnRenamed("l_returnflag_MODE", "FLAG_MODE")


# -------------------------------------------------- imputation / scaling ---

QS = B.LINE_VALUES
OW = {"w": B.SQL_LINE_WIDE}
# temporal split: statistics are fitted on lines shipped before the cut-off
# year and applied to every line
TRAIN_BEFORE_YEAR = 1999
TRAIN = f"SHIP_YEAR < {TRAIN_BEFORE_YEAR}"


def _train(df):
    return df.where(F.col("SHIP_YEAR") < TRAIN_BEFORE_YEAR)


@query("impute_mean", W("SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"coalesce({q}, (SELECT avg({q}) FROM w WHERE {TRAIN})) AS {q}" for q in QS) + " FROM w", **OW))
def impute_mean(spark, d):
    w = B.line_wide(spark, d).select("l_orderkey", "l_linenumber", "SHIP_YEAR", *QS)
    return P.fit_mean_imputer(_train(w), QS).transform(w).drop("SHIP_YEAR")


ZQ = ["V1", "V2", "V6"]


@query("zscore_train_apply", W("SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({q} - (SELECT avg({q}) FROM w WHERE {TRAIN})) / NULLIF((SELECT stddev_pop({q}) FROM w WHERE {TRAIN}), 0), 8) AS {q}"
    for q in ZQ) + " FROM w", **OW))
def zscore_train_apply(spark, d):
    w = B.line_wide(spark, d).select("l_orderkey", "l_linenumber", "SHIP_YEAR", *ZQ)
    return round_columns(P.fit_zscore(_train(w), ZQ).transform(w).drop("SHIP_YEAR"), ZQ, 8)


@query("robust_scale", W("SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({q} - (SELECT quantile_cont({q}, 0.5) FROM w WHERE {TRAIN})) / NULLIF((SELECT quantile_cont({q}, 0.75) - quantile_cont({q}, 0.25) FROM w WHERE {TRAIN}), 0), 8) AS {q}"
    for q in ZQ) + " FROM w", **OW))
def robust_scale(spark, d):
    w = B.line_wide(spark, d).select("l_orderkey", "l_linenumber", "SHIP_YEAR", *ZQ)
    return round_columns(P.fit_robust_scale(_train(w), ZQ).transform(w).drop("SHIP_YEAR"), ZQ, 8)


def _rank_corr_sql():
    n = B.SCORE_NAMES
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) AS {c}" for c in n)
    pairs = [(a, b) for i, a in enumerate(n) for b in n[i:]]
    return W(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM r"
                                for a, b in pairs), s=B.SQL_SCORES, r=f"SELECT {ranks} FROM s")


@query("rank_corr", _rank_corr_sql())
def rank_corr(spark, d):
    s = RK.rank_columns(B.model_scores(spark, d), "c_custkey", B.SCORE_NAMES)
    out = P.correlation_matrix(s, B.SCORE_NAMES)
    return out.select("a", "b", F.round("corr", 8).alias("corr"))


WIN_COLS = ["l_extendedprice", "l_quantity", "l_linenumber", "l_orderkey"]


def _winsor_sql():
    sel = []
    for c in WIN_COLS:
        b = (f"(SELECT CASE WHEN count(DISTINCT {c}) < 30 OR count(DISTINCT {c}) = count({c}) THEN NULL "
             f"ELSE quantile_cont(CAST({c} AS DOUBLE), [0.001, 0.999]) END FROM lineitem)")
        sel.append(f"CASE WHEN {b} IS NULL THEN {c} WHEN {c} > {b}[1] AND {c} < {b}[2] THEN {c} END AS {c}")
    return "SELECT l_linenumber AS line_no, " + ", ".join(sel) + " FROM lineitem"


@query("winsor_to_null", _winsor_sql())
def winsor_to_null(spark, d):
    li = scan_table(spark, d, "lineitem").select(*WIN_COLS)
    bounds = P.winsor_bounds(li, WIN_COLS)
    return P.winsor_to_null(li.withColumn("line_no", F.col("l_linenumber")), bounds)
