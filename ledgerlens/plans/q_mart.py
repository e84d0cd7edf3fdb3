"""Flagship mart query and its oracle."""

from __future__ import annotations

from . import bindings as B
from . import mart as M
from .q_agg import sql_spec
from .registry import query, round_map

# Levels of the test tables' categorical columns, for the oracle side only.
ORACLE_LEVELS = {
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "o_orderstatus": ["F", "O", "P"],
    "l_returnflag": ["A", "N", "R"],
    "l_linestatus": ["F", "O"],
    "event_type": ["click", "error", "purchase", "signup", "view"],
}

# places of the order-dependent sums, rounded on both sides
MART_PLACES = {f"INSTAL_PAYMENT_PERC_{f}": 4 for f in ("MEAN", "SUM")}
MART_NOISY = [f"{p}{c}" for p in ("PREV_", "APPROVED_", "REFUSED_")
              for c in ("PRICE_PER_DAY_MEAN", "DAYS_DECISION_VAR")]


def _q(name: str) -> str:
    return '"' + name + '"'


def _loan_sql_aggs(prefix: str, cond: str | None) -> list[str]:
    def x(c):
        return c if cond is None else f"CASE WHEN {cond} THEN {c} END"
    present = None if cond is None else f"count(*) FILTER (WHERE {cond})"
    out = []
    for c, funcs in M.LOAN_SPEC:
        for f in funcs:
            v = x(c)
            if f == "min":
                e = f"min({v})"
            elif f == "max":
                e = f"max({v})"
            elif f == "mean":
                e = (f"CAST(sum({v}) AS DOUBLE) / count({v})" if c == "AMT_PRICE"
                     else f"avg(CAST({v} AS DOUBLE))")
            elif f == "sum":
                e = f"coalesce(CAST(sum({v}) AS DOUBLE), 0.0)"
            elif f == "var":
                e = f"var_samp(CAST({v} AS DOUBLE))"
            if c == "AMT_PRICE" and f in ("min", "max"):
                e = f"CAST({e} AS DOUBLE)"
            if present:
                e = f"CASE WHEN {present} > 0 THEN {e} END"
            name = f"{prefix}{c}_{f.upper()}"
            if name in MART_NOISY:
                e = f"round(CAST({e} AS DOUBLE), 6)"
            out.append(f"{e} AS {_q(name)}")
    return out


def mart_sql() -> str:
    loan_aggs = _loan_sql_aggs("PREV_", None)
    for prefix, (c, v) in M.LOAN_SUBSETS.items():
        loan_aggs += _loan_sql_aggs(prefix, f"{c} = '{v}'")
    for c in ("o_orderpriority", "o_orderstatus"):
        for v in ORACLE_LEVELS[c]:
            loan_aggs.append(f"avg(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END) AS {_q(f'PREV_{c}_{v}_MEAN')}")
        loan_aggs.append(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {_q(f'PREV_{c}_nan_MEAN')}")
    loan_aggs.append("count(*) AS PREV_COUNT")
    loans = (f"SELECT o_custkey AS c_custkey, {', '.join(loan_aggs)} FROM "
             f"(SELECT *, CAST(AMT_PRICE AS DOUBLE) / CAST(NULLIF(-DAYS_DECISION, 0) AS DOUBLE) AS PRICE_PER_DAY FROM loans_b) "
             f"GROUP BY o_custkey")

    # level 1 per (order, customer); dummies summed per order
    l1 = []
    feats = []
    for c, funcs in M.LINE_SPEC:
        for f in funcs:
            name = f"POS_{c}_{f.upper()}"
            e = {"max": f"max({c})", "min": f"min({c})", "size": "count(*)",
                 "sum": f"sum({c})"}[f]
            l1.append(f"{e} AS {_q(name)}")
            feats.append(name)
    for c in ("l_returnflag", "l_linestatus"):
        for v in ORACLE_LEVELS[c] + ["nan"]:
            name = f"POS_{c}_{v}_SUM"
            cond = f"{c} IS NULL" if v == "nan" else f"{c} = '{v}'"
            l1.append(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS {_q(name)}")
            feats.append(name)
    lvl1 = (f"SELECT l_orderkey, o_custkey, count(*) AS n, {', '.join(l1)} "
            f"FROM lines_b GROUP BY l_orderkey, o_custkey")
    # level 2 over the fan-out (every detail row carries its order's values)
    l2 = []
    for name in feats:
        q = _q(name)
        l2.append(f"CAST(sum({q} * n) AS DOUBLE) / sum(CASE WHEN {q} IS NOT NULL THEN n END) AS {_q('POS_' + name + '_MEAN')}")
        l2.append(f"CAST(max({q}) AS DOUBLE) AS {_q('POS_' + name + '_MAX')}")
    pos = (f"SELECT o_custkey AS c_custkey, {', '.join(l2)}, sum(n) AS POS_COUNT "
           f"FROM ({lvl1}) GROUP BY o_custkey")

    rates = ", ".join(f"CAST({c} AS {M.RATE}) AS {c}" for c in M.RATE_COLUMNS)
    detail = (f"SELECT * REPLACE ({rates}), CAST(AMT_EXT AS DOUBLE) / NULLIF(l_quantity, 0) AS PAYMENT_PERC, "
              f"AMT_EXT - CAST(l_quantity * {M.PRICE_PER_UNIT} AS DECIMAL(18,2)) AS PAYMENT_DIFF, "
              f"greatest(DAYS_SHIP + l_linenumber * {M.DAYS_PER_INSTALMENT}, 0) AS DPD, "
              f"greatest(-l_linenumber * {M.DAYS_PER_INSTALMENT} - DAYS_SHIP, 0) AS DBD FROM lines_b")
    ins = (f"SELECT o_custkey AS c_custkey, {sql_spec(M.INSTAL_SPEC, 'INSTAL_', ['AMT_EXT', 'PAYMENT_DIFF'], rounding=MART_PLACES)}, "
           f"{sql_spec(M.CARD_SPEC, 'CC_', ['AMT_EXT', *M.RATE_COLUMNS], rounding=MART_PLACES)} FROM ({detail}) GROUP BY o_custkey")
    buro_aggs = [sql_spec(M.BUREAU_SPEC, "BURO_", ["AMT_PRICE"])]
    for prefix, (c, v) in M.BUREAU_SUBSETS.items():
        buro_aggs.append(sql_spec(M.BUREAU_SPEC, prefix, ["AMT_PRICE"], cond=f"{c} = '{v}'"))
    buro = (f"SELECT o_custkey AS c_custkey, {', '.join(buro_aggs)} FROM loans_b LEFT JOIN (SELECT l_orderkey, "
            f"min(MONTHS_BALANCE) AS BAL_MONTHS_BALANCE_MIN, max(MONTHS_BALANCE) AS BAL_MONTHS_BALANCE_MAX, "
            f"count(*) AS BAL_MONTHS_BALANCE_SIZE FROM lines_b GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_custkey")

    ev = ["coalesce(CAST(sum(AMT_VALUE) AS DOUBLE), 0.0) AS EVT_AMT_VALUE_SUM",
          "CAST(sum(AMT_VALUE) AS DOUBLE) / count(AMT_VALUE) AS EVT_AMT_VALUE_MEAN",
          "CAST(max(AMT_VALUE) AS DOUBLE) AS EVT_AMT_VALUE_MAX"]
    for v in ORACLE_LEVELS["event_type"]:
        ev.append(f"sum(CASE WHEN event_type = '{v}' THEN 1.0 ELSE 0.0 END) AS {_q(f'EVT_event_type_{v}_SUM')}")
    ev.append("count(*) AS EVT_COUNT")
    evt = f"SELECT c_custkey, {', '.join(ev)} FROM activity_b GROUP BY c_custkey"

    root = ("SELECT a.c_custkey, TARGET, c_acctbal, c_nationkey, n_regionkey, "
            "CAST(c_acctbal < 0 AS INTEGER) AS ACCTBAL_NEGATIVE, "
            "c_acctbal / NULLIF(m.med, 0) AS ACCTBAL_TO_NATION_MEDIAN, m.med AS ACCTBAL_BY_NATION "
            "FROM applicants_b a LEFT JOIN (SELECT n_name, median(c_acctbal) AS med FROM applicants_b "
            "WHERE n_name IS NOT NULL GROUP BY n_name) m USING (n_name)")
    body = (f"SELECT r.*, p.* EXCLUDE (c_custkey), s.* EXCLUDE (c_custkey), i.* EXCLUDE (c_custkey), "
            f"b.* EXCLUDE (c_custkey), e.* EXCLUDE (c_custkey), "
            f"CAST(e.EVT_COUNT IS NULL AS INTEGER) AS HAS_NO_ACTIVITY "
            f"FROM ({root}) r LEFT JOIN ({loans}) p USING (c_custkey) "
            f"LEFT JOIN ({pos}) s USING (c_custkey) LEFT JOIN ({ins}) i USING (c_custkey) "
            f"LEFT JOIN ({buro}) b USING (c_custkey) LEFT JOIN ({evt}) e USING (c_custkey)")
    return B.with_ctes(body, applicants_b=B.SQL_APPLICANTS, loans_b=B.SQL_LOANS,
                       lines_b=B.SQL_LINES, activity_b=B.SQL_ACTIVITY)


@query("feature_mart", mart_sql())
def feature_mart(spark, d):
    return round_map(M.build(spark, d), MART_PLACES | dict.fromkeys(MART_NOISY, 6))
