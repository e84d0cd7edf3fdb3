"""Deep feature synthesis over customer -< orders -< lines, customer -< events (D*)."""

from __future__ import annotations

import re

from ..operators.dfs import CATEGORICAL_PRIMITIVES, NUMERIC_PRIMITIVES, EntitySet, synthesize
from . import bindings as B
from .registry import query, round_map


def entity_set(spark, d) -> EntitySet:
    es = EntitySet()
    es.add("customers", B.applicants(spark, d).select("c_custkey", "c_acctbal"), "c_custkey")
    es.add("orders", B.loans(spark, d).select("o_orderkey", "o_custkey", "AMT_PRICE", "DAYS_DECISION",
                                              "o_orderstatus"), "o_orderkey")
    # integer-valued line columns: a mean of per-order means of 2-decimal
    # money can end exactly on a rounding tie, which no oracle compares stably
    es.add("lines", B.balance_lines(spark, d).select("l_orderkey", "l_quantity", "DAYS_SHIP", "l_returnflag"),
           None)
    es.add("events", B.activity(spark, d).select("c_custkey", "AMT_VALUE", "event_type"), None)
    es.relate("customers", "c_custkey", "orders", "o_custkey")
    es.relate("orders", "o_orderkey", "lines", "l_orderkey")
    es.relate("customers", "c_custkey", "events", "c_custkey")
    return es


# ------------------------------------------------------------ the oracle ---
# column kinds of each entity in SQL: (name, kind) with kind dec|int|dbl|str
SQL_ENTITIES = {
    "customers": ("SELECT c_custkey, c_acctbal FROM a", "c_custkey", []),
    "orders": ("SELECT o_orderkey, o_custkey, AMT_PRICE, DAYS_DECISION, o_orderstatus FROM l", "o_orderkey",
               [("AMT_PRICE", "dec"), ("DAYS_DECISION", "int"), ("o_orderstatus", "str")]),
    "lines": ("SELECT l_orderkey, l_quantity, DAYS_SHIP, l_returnflag FROM x", None,
              [("l_quantity", "dbl"), ("DAYS_SHIP", "int"), ("l_returnflag", "str")]),
    "events": ("SELECT c_custkey, AMT_VALUE, event_type FROM v", None,
               [("AMT_VALUE", "dec"), ("event_type", "str")]),
}
SQL_REL = [("customers", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lines", "l_orderkey"),
           ("customers", "c_custkey", "events", "c_custkey")]


def _num_sql(c, kind, p):
    q = f'"{c}"'
    d = f"CAST({q} AS DOUBLE)"
    if p == "SUM":
        return f"coalesce(sum({q}), 0)" if kind == "dec" else f"coalesce(sum({d}), 0.0)"
    if p == "MEAN":
        return f"CAST(sum({q}) AS DOUBLE) / count({q})" if kind == "dec" else f"avg({d})"
    if p in ("MAX", "MIN"):
        return f"{p.lower()}({q})"
    if p == "STD":
        return f"stddev_samp({d})"
    if p == "SKEW":
        return f"CASE WHEN count({q}) < 3 THEN NULL WHEN var_pop({d}) = 0 THEN 0.0 ELSE skewness({d}) END"
    raise ValueError(p)


def _kind_after(p, kind):
    if p in ("SUM", "MAX", "MIN") and kind in ("dec", "int") and p != "SUM":
        return kind
    if p == "SUM" and kind == "dec":
        return "dec"
    return "dbl"


def _sql_build(name, depth, ctes, counter, path=()):
    """Returns (cte name, key, [(col, kind)]) for the entity at this depth."""
    body, key, cols = SQL_ENTITIES[name]
    cur = f"e{counter[0]}"
    counter[0] += 1
    ctes[cur] = body
    cols = list(cols)
    if depth <= 0:
        return cur, cols
    for parent, pk, child, fk in SQL_REL:
        if parent != name or child in path:
            continue
        ccte, ccols = _sql_build(child, depth - 1, ctes, counter, (*path, name))
        aggs = [f'count(*) AS "COUNT({child})"']
        new = [(f"COUNT({child})", "int")]
        modes = []
        for c, kind in ccols:
            if kind == "str":
                aggs.append(f'count(DISTINCT "{c}") AS "NUM_UNIQUE({child}.{c})"')
                new.append((f"NUM_UNIQUE({child}.{c})", "int"))
                modes.append(c)
                new.append((f"MODE({child}.{c})", "str"))
            else:
                for p in NUMERIC_PRIMITIVES:
                    aggs.append(f'{_num_sql(c, kind, p)} AS "{p}({child}.{c})"')
                    new.append((f"{p}({child}.{c})", _kind_after(p, kind)))
        acte = f"e{counter[0]}"
        counter[0] += 1
        ctes[acte] = f'SELECT "{fk}" AS __fk, {", ".join(aggs)} FROM {ccte} GROUP BY "{fk}"'
        mode_sel = []
        for m in modes:
            mcte = f"e{counter[0]}"
            counter[0] += 1
            ctes[mcte] = (f'SELECT __fk, first(v ORDER BY n DESC, v) AS "MODE({child}.{m})" FROM '
                          f'(SELECT "{fk}" AS __fk, "{m}" AS v, count(*) AS n FROM {ccte} WHERE "{m}" IS NOT NULL '
                          f'GROUP BY 1, 2) GROUP BY __fk')
            mode_sel.append((mcte, f"MODE({child}.{m})"))
        joined = f"e{counter[0]}"
        counter[0] += 1
        sel = [f"p.*"] + [f'g."{n}"' for n, _ in new if not n.startswith("MODE(")] + \
              [f'm{i}."{n}"' for i, (_, n) in enumerate(mode_sel)]
        frm = f'{cur} p LEFT JOIN {acte} g ON p."{pk}" = g.__fk' + "".join(
            f' LEFT JOIN {mc} m{i} ON p."{pk}" = m{i}.__fk' for i, (mc, _) in enumerate(mode_sel))
        ctes[joined] = f"SELECT {', '.join(sel)} FROM {frm}"
        cur = joined
        cols += new
    return cur, cols


NOISY = re.compile(r"(STD\(|SKEW\(|^(SUM|MEAN)\((orders|events)\.(MEAN|SUM|STD|SKEW)\((lines)\.(l_quantity|AMT_EXT)\)\)$)")


def _noisy(name):
    if "STD(" in name or "SKEW(" in name:
        return True
    m = re.match(r"^(SUM|MEAN)\(\w+\.(\w+)\(", name)
    return bool(m) and m.group(2) == "MEAN"


def _places(name):
    """Rounding of noisy outputs by magnitude: money-sized values keep 4
    places, skewness (small, and exactly k/2**m for some integer samples) 9."""
    if "AMT_" in name:
        return 4
    if "SKEW(" in name:
        return 9
    # means of per-loan means: exact values can end on k/2**7, so keep more
    # places than such a denominator produces (noise stays far below them)
    if re.match(r"^(SUM|MEAN)\(\w+\.MEAN\(lines\.l_quantity\)\)$", name):
        return 9
    if re.match(r"^(SUM|MEAN)\(\w+\.MEAN\(lines\.DAYS_SHIP\)\)$", name):
        return 7
    return 6


def dfs_sql(depth):
    ctes = {"a": B.SQL_APPLICANTS, "l": B.SQL_LOANS, "x": B.SQL_LINES, "v": B.SQL_ACTIVITY}
    top, cols = _sql_build("customers", depth, ctes, [0])
    sel = ["c_custkey", "c_acctbal"]
    for n, kind in cols:
        q = f'"{n}"'
        if kind == "dec":
            sel.append(f"CAST({q} AS DOUBLE) AS {q}")
        elif _noisy(n):
            sel.append(f"round(CAST({q} AS DOUBLE), {_places(n)}) AS {q}")
        else:
            sel.append(q)
    return B.with_ctes(f"SELECT {', '.join(sel)} FROM {top}", **ctes)


def _dfs(spark, d, depth):
    out = synthesize(entity_set(spark, d), "customers", max_depth=depth,
                     numeric_prims=NUMERIC_PRIMITIVES, cat_prims=CATEGORICAL_PRIMITIVES)
    return round_map(out, {c: _places(c) for c in out.columns if _noisy(c)})


@query("dfs_depth1", dfs_sql(1))
def dfs_depth1(spark, d):
    return _dfs(spark, d, 1)


@query("dfs_depth2", dfs_sql(2))
def dfs_depth2(spark, d):
    return _dfs(spark, d, 2)


def _loans_sql() -> str:
    """Loans with the aggregates of their lines, and their applicant's columns and activity aggregates."""
    ctes = {"a": B.SQL_APPLICANTS, "l": B.SQL_LOANS, "x": B.SQL_LINES, "v": B.SQL_ACTIVITY}
    counter = [0]
    own, cols = _sql_build("orders", 2, ctes, counter)
    above, direct = _sql_build("customers", 1, ctes, counter, ("orders",))
    named = [("o", n, n, kind) for n, kind in cols] + [("c", "c_acctbal", "customers.c_acctbal", "dbl")]
    named += [("c", n, f"customers.{n}", kind) for n, kind in direct]
    sel = ["o.o_orderkey", "o.o_custkey"]
    for t, n, out, kind in named:
        e = f'CAST({t}."{n}" AS DOUBLE)' if kind == "dec" else f'{t}."{n}"'
        # no negative zero on either side
        sel.append(f'round(CAST({e} AS DOUBLE), {_places(out)}) + 0.0::DOUBLE AS "{out}"' if _noisy(out) else f'{e} AS "{out}"')
    return B.with_ctes(f"SELECT {', '.join(sel)} FROM {own} o LEFT JOIN {above} c ON c.c_custkey = o.o_custkey", **ctes)


@query("dfs_loans_depth2", _loans_sql())
def dfs_loans_depth2(spark, d):
    """Synthesis for a table that is child and parent at once."""
    out = synthesize(entity_set(spark, d), "orders", max_depth=2)
    return round_map(out, {c: _places(c) for c in out.columns if _noisy(c)})
