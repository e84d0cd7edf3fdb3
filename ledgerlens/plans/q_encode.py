"""Categorical encoders (C*), label statistics and joins/unions (J*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import profile as P
from ..sources.io import scan_table
from . import bindings as B
from .q_mart import ORACLE_LEVELS
from .registry import query

W = B.with_ctes
AP = {"a": B.SQL_APPLICANTS}
LO = {"l": B.SQL_LOANS}
ONE_HOT_COLS = ["o_orderstatus", "o_orderpriority"]


def _dummy_sql(c, v, nan=False):
    if nan:
        return f'CAST({c} IS NULL AS INTEGER) AS "{c}_nan"'
    return f"""coalesce(CAST({c} = '{v}' AS INTEGER), 0) AS "{c}_{v}\""""


def _one_hot_sql_cols(cols, nan=True):
    out = []
    for c in cols:
        out += [_dummy_sql(c, v) for v in ORACLE_LEVELS[c]]
        if nan:
            out.append(_dummy_sql(c, None, True))
    return out


@query("one_hot", "SELECT o_orderkey, " + ", ".join(_one_hot_sql_cols(ONE_HOT_COLS)) + " FROM orders")
def one_hot(spark, d):
    o = scan_table(spark, d, "orders").select("o_orderkey", *ONE_HOT_COLS)
    enc, _ = E.one_hot(o, ONE_HOT_COLS, nan_column=True)
    return enc


def _one_hot_agg_sql():
    out = []
    for c in ONE_HOT_COLS:
        for v in ORACLE_LEVELS[c]:
            out.append(f"""avg(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END) AS "PREV_{c}_{v}_MEAN\"""")
        out.append(f"""avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS "PREV_{c}_nan_MEAN\"""")
    return ", ".join(out)


@query("one_hot_agg", f"SELECT o_custkey, {_one_hot_agg_sql()} FROM orders GROUP BY o_custkey")
def one_hot_agg(spark, d):
    o = scan_table(spark, d, "orders")
    model = E.fit_one_hot(o, ONE_HOT_COLS, nan_column=True)
    return o.groupBy("o_custkey").agg(*model.agg_exprs(["mean"], "PREV_"))


TRAIN_NATIONS = 20  # the train vocabulary only knows nations 0..19


@query("align_columns", W("SELECT c_custkey, " + ", ".join(
    f"""CAST(n_name = 'NATION_{k}' AS INTEGER) AS "NATION_NATION_{k}\"""" for k in range(TRAIN_NATIONS))
    + " FROM a WHERE TARGET IS NULL", **AP))
def align_columns(spark, d):
    a = B.applicants(spark, d)
    train = a.where("TARGET IS NOT NULL").select(
        "c_custkey", F.when(F.col("c_nationkey") < TRAIN_NATIONS, F.col("n_name")).alias("NATION"))
    test = a.where("TARGET IS NULL").select("c_custkey", F.col("n_name").alias("NATION"))
    train_model = E.fit_one_hot(train, ["NATION"])
    test_enc, _ = E.one_hot(test, ["NATION"])
    return E.align_columns(test_enc, ["c_custkey", *train_model.names])


@query("factorize", W("""SELECT c_custkey, coalesce(code, -1) AS SEG_CODE FROM a LEFT JOIN (
  SELECT seg, CAST(dense_rank() OVER (ORDER BY first_id, seg) - 1 AS INTEGER) AS code FROM (
    SELECT NULLIF(c_mktsegment, 'HOUSEHOLD') AS seg, min(c_custkey) AS first_id FROM a
    WHERE NULLIF(c_mktsegment, 'HOUSEHOLD') IS NOT NULL GROUP BY 1)) m
  ON NULLIF(a.c_mktsegment, 'HOUSEHOLD') = m.seg""", **AP))
def factorize(spark, d):
    a = B.applicants(spark, d).select("c_custkey", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("seg"))
    return E.factorize(a, "seg", "c_custkey", "SEG_CODE").select("c_custkey", "SEG_CODE")


# high-cardinality columns: one code per part, distributed row numbers
@query("factorize_high", """SELECT l_orderkey, l_linenumber, code AS PART_CODE FROM lineitem JOIN (
  SELECT l_partkey AS p, CAST(row_number() OVER (ORDER BY f, l_partkey) - 1 AS INTEGER) AS code
  FROM (SELECT l_partkey, min(l_orderkey) AS f FROM lineitem GROUP BY 1)) ON l_partkey = p""")
def factorize_high(spark, d):
    li = scan_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return E.factorize(li, "l_partkey", "l_orderkey", "PART_CODE").select("l_orderkey", "l_linenumber", "PART_CODE")


@query("frequency_encode_high", """SELECT l_orderkey, l_linenumber, code AS PART_FREQ FROM lineitem JOIN (
  SELECT l_partkey AS p, CAST(row_number() OVER (ORDER BY n DESC, l_partkey) - 1 AS INTEGER) AS code
  FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)) ON l_partkey = p""")
def frequency_encode_high(spark, d):
    li = scan_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return E.frequency_encode(li, "l_partkey", "PART_FREQ").select("l_orderkey", "l_linenumber", "PART_FREQ")


@query("frequency_encode", """SELECT o_orderkey, m.code AS PRIO_FREQ FROM orders LEFT JOIN (
  SELECT o_orderpriority AS v, CAST(least(row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1, 3) AS INTEGER) AS code
  FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)) m ON o_orderpriority = m.v""")
def frequency_encode(spark, d):
    o = scan_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.frequency_encode(o, "o_orderpriority", "PRIO_FREQ", cap=3).select("o_orderkey", "PRIO_FREQ")


@query("category_median_encode", W("""SELECT c_custkey, m.med AS ACCTBAL_BY_NATION FROM a LEFT JOIN
  (SELECT n_name, median(c_acctbal) AS med FROM a GROUP BY n_name) m USING (n_name)""", **AP))
def category_median_encode(spark, d):
    a = B.applicants(spark, d)
    return E.category_stat_encode(a, "n_name", "c_acctbal", "ACCTBAL_BY_NATION").select(
        "c_custkey", "ACCTBAL_BY_NATION")


@query("target_rate_by_category", W("""SELECT n_name, avg(CAST(TARGET AS DOUBLE)) AS target_mean,
count(*) AS n_rows FROM a WHERE TARGET IS NOT NULL GROUP BY n_name""", **AP))
def target_rate_by_category(spark, d):
    return E.target_rate_by_category(B.applicants(spark, d), "n_name")


def _cluster_ctes(k=4):
    """Every way to cut the sorted rates into ``k`` runs, empty ones included, by its cost."""
    prefix = "OVER (ORDER BY m)"
    cost = lambda a, b: (f"CASE WHEN {b}.w = {a}.w THEN 0 ELSE {b}.q - {a}.q - "  # noqa: E731
                         f"({b}.s - {a}.s) * ({b}.s - {a}.s) / ({b}.w - {a}.w) END")
    names = ["lo", *[f"p{i}" for i in range(1, k)], "hi"]
    total = " + ".join(cost(a, b) for a, b in zip(names, names[1:], strict=False))
    joins = " ".join(f"JOIN sums p{i} ON p{i}.i >= {names[i - 1]}.i" for i in range(1, k))
    return {
        "rates": "SELECT n_name, avg(CAST(TARGET AS DOUBLE)) AS m FROM a WHERE TARGET IS NOT NULL GROUP BY n_name",
        "shared": "SELECT m, m - (SELECT avg(m) FROM rates) AS x, count(*) AS n FROM rates GROUP BY m",
        "sums": (f"SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q UNION ALL SELECT row_number() {prefix}, "
                 f"sum(n) {prefix}, sum(n * x) {prefix}, sum(n * x * x) {prefix} FROM shared"),
        "costs": (f"SELECT [{', '.join(f'p{i}.i' for i in range(1, k))}] AS cuts, {total} AS cost FROM sums lo {joins} "
                  f"JOIN sums hi ON hi.i >= p{k - 1}.i WHERE lo.i = 0 AND hi.i = (SELECT max(i) FROM sums)"),
        "chosen": ("SELECT arg_min(cuts, (round(cost / (SELECT greatest(max(q), 1e-300) * 1e-12 FROM sums WHERE i = (SELECT max(i) FROM sums))), "
                   "list_reverse(cuts))) AS cuts FROM costs"),
        "numbered": "SELECT m, row_number() OVER (ORDER BY m) AS i FROM shared",
        "clusters": ("SELECT n_name, r.m, CAST(dense_rank() OVER (ORDER BY len(list_filter(cuts, lambda c: c < i))) - 1 AS INTEGER) AS cluster_id "
                     "FROM rates r JOIN numbered USING (m), chosen"),
    }


CLUSTERS = AP | _cluster_ctes()


@query("target_rate_clusters", W("SELECT n_name, m AS target_mean, cluster_id FROM clusters", **CLUSTERS))
def target_rate_clusters(spark, d):
    return E.target_rate_clusters(B.applicants(spark, d), "n_name", k=4)


@query("target_rate_cluster_rows", W("SELECT c_custkey, TARGET, cluster_id, " + ", ".join(
    f"CAST(coalesce(cluster_id = {i}, false) AS INTEGER) AS cluster_id_{i}" for i in range(4))
    + " FROM a LEFT JOIN clusters USING (n_name)", **CLUSTERS))
def target_rate_cluster_rows(spark, d):
    rows = E.target_rate_cluster_encode(B.applicants(spark, d), "n_name", k=4)
    return rows.select("c_custkey", "TARGET", "cluster_id", *[f"cluster_id_{i}" for i in range(4)])


@query("crosstab_pivot", W("""SELECT n_name, count(*) FILTER (WHERE TARGET = 0) AS TARGET_0,
count(*) FILTER (WHERE TARGET = 1) AS TARGET_1 FROM a WHERE TARGET IS NOT NULL GROUP BY n_name""", **AP))
def crosstab_pivot(spark, d):
    return P.crosstab_pivot(B.applicants(spark, d), "n_name")


_EVT_SUM = "(SELECT c_custkey, sum(value) AS EVT_SUM FROM (SELECT user_id AS c_custkey, value FROM events) GROUP BY 1)"
_LIFT_COLS = {"EVT_SUM": "EVT_SUM", "BAL_POS": "CASE WHEN c_acctbal < 2000 THEN NULL ELSE c_acctbal END",
              "c_acctbal": "c_acctbal"}


def _lift_sql():
    parts = []
    for c in _LIFT_COLS:
        parts.append(f"""SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN CAST(TARGET AS DOUBLE) END) AS rate_missing,
avg(CASE WHEN {c} IS NOT NULL THEN CAST(TARGET AS DOUBLE) END) AS rate_present,
count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE {c} IS NOT NULL) AS n_present FROM x""")
    body = ("SELECT *, abs(rate_missing - rate_present) AS gap FROM (" + " UNION ALL ".join(parts)
            + ") WHERE n_missing > 0 AND n_present > 0 AND abs(rate_missing - rate_present) > 0.02")
    x = ("SELECT TARGET, " + ", ".join(f"{v} AS {k}" for k, v in _LIFT_COLS.items())
         + f" FROM a LEFT JOIN {_EVT_SUM} e USING (c_custkey) WHERE TARGET IS NOT NULL")
    return W(body, a=B.SQL_APPLICANTS, x=x)


@query("missing_target_lift", _lift_sql())
def missing_target_lift(spark, d):
    a = B.applicants(spark, d)
    ev = scan_table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.sum("value").alias("EVT_SUM"))
    x = a.join(ev, "c_custkey", "left").select(
        "TARGET", "EVT_SUM", F.when(F.col("c_acctbal") < 2000, None).otherwise(F.col("c_acctbal")).alias("BAL_POS"),
        "c_acctbal")
    return P.missing_target_lift(x, list(_LIFT_COLS))


@query("value_counts", "SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1")
def value_counts(spark, d):
    return P.value_counts(scan_table(spark, d, "orders"), "o_orderpriority")


@query("class_histogram", W("""SELECT TARGET, CAST(least(greatest(floor((c_acctbal - -1000.0) / ((10000.0 - -1000.0) / 10)), 0), 9) AS INTEGER) AS bin,
count(*) AS n_rows FROM a WHERE TARGET IS NOT NULL GROUP BY 1, 2""", **AP))
def class_histogram(spark, d):
    return P.class_histogram(B.applicants(spark, d), "c_acctbal", "TARGET", -1000.0, 10000.0, 10)


_KIND_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey", "TARGET"]


@query("column_kind", W(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,
CASE WHEN {str(c in ('c_mktsegment', 'n_name')).upper()} OR count(DISTINCT {c}) < 15 THEN 'categorical' ELSE 'continuous' END AS kind FROM a"""
    for c in _KIND_COLS), **AP))
def column_kind(spark, d):
    return P.column_kind(B.applicants(spark, d))


# ------------------------------------------------------------ joins/unions ---

@query("join_inner", """SELECT o_orderkey, o_totalprice, n_lines FROM orders JOIN
(SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def join_inner(spark, d):
    o = scan_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = scan_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return o.join(n, o.o_orderkey == n.l_orderkey, "inner").drop("l_orderkey")


@query("attach_root_key", """SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey""")
def attach_root_key(spark, d):
    li = scan_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    o = scan_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").drop("o_orderkey")


def _evt_dummy_sql():
    return ", ".join(f"""sum(CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END) AS "event_{v}_DUMMY\""""
                     for v in ORACLE_LEVELS["event_type"])


@query("join_dummy_features", W(f"""SELECT c_custkey, c_acctbal, e.* EXCLUDE (c_custkey) FROM a LEFT JOIN
(SELECT user_id AS c_custkey, {_evt_dummy_sql()} FROM events GROUP BY 1) e USING (c_custkey)""", **AP))
def join_dummy_features(spark, d):
    a = B.applicants(spark, d).select("c_custkey", "c_acctbal")
    ev = scan_table(spark, d, "events")
    model = E.fit_one_hot(ev, ["event_type"])
    dummies = ev.groupBy(F.col("user_id").alias("c_custkey")).agg(*[
        F.sum(F.coalesce((F.col("event_type") == v).cast("long"), F.lit(0))).alias(f"event_{v}_DUMMY")
        for v in model.levels["event_type"]])
    return a.join(dummies, "c_custkey", "left")


@query("no_child_flag", W("""SELECT c_custkey, CAST(e.c_custkey IS NULL AS INTEGER) AS HAS_NO_EVENTS,
coalesce(e.n, 0) AS N_EVENTS FROM a LEFT JOIN (SELECT user_id AS c_custkey, count(*) AS n FROM events GROUP BY 1) e
USING (c_custkey)""", **AP))
def no_child_flag(spark, d):
    a = B.applicants(spark, d).select("c_custkey")
    ev = scan_table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"))
    j = a.join(ev, "c_custkey", "left")
    return j.select("c_custkey", F.col("n").isNull().cast("int").alias("HAS_NO_EVENTS"),
                    F.coalesce("n", F.lit(0)).alias("N_EVENTS"))


@query("union_train_test", W("""SELECT c_custkey, c_acctbal, TARGET, 1 AS is_train,
CAST(c_acctbal IS NULL AS INTEGER) AS n_missing FROM a WHERE TARGET IS NOT NULL
UNION ALL SELECT c_custkey, c_acctbal, NULL AS TARGET, 0 AS is_train, CAST(c_acctbal IS NULL AS INTEGER) AS n_missing
FROM a WHERE TARGET IS NULL""", **AP))
def union_train_test(spark, d):
    from ..functions.rowwise import row_missing_count
    a = B.applicants(spark, d)
    train = a.where("TARGET IS NOT NULL").select("c_custkey", "c_acctbal", "TARGET")
    test = a.where("TARGET IS NULL").select("c_custkey", "c_acctbal")  # no label column
    u = (train.withColumn("is_train", F.lit(1))
         .unionByName(test.withColumn("is_train", F.lit(0)), allowMissingColumns=True))
    return u.withColumn("n_missing", row_missing_count([c for c in u.columns
                                                        if c not in ("TARGET", "is_train")]))
