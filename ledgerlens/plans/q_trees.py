"""Extremely randomised trees (M22) and boosting with missing direction and early stopping (M21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as T
from ..operators.folds import hash_bucket
from ..operators.rank import auc_exact
from . import bindings as B
from .registry import query

FEATURES = ["BALANCE", "NATION", "LOANS", "PRICE"]
SEED, TREES, DEPTH = 47, 3, 2


def _rows(spark, d):
    """Applicants with a balance, a nation, their loans and the sum of prices in whole units (NULL without a loan)."""
    loans = B.loans(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("AMT_PRICE").alias("s"))
    a = B.applicants(spark, d)
    return a.join(loans, a.c_custkey == loans.o_custkey, "left").select(
        "c_custkey", F.when(F.col("TARGET").isNotNull(), (F.col("c_nationkey") % 3 == 0) | (F.col("c_acctbal") > 7000)).cast("int").alias("TARGET"),
        F.floor("c_acctbal").cast("double").alias("BALANCE"), F.col("c_nationkey").cast("double").alias("NATION"),
        F.coalesce("n", F.lit(0)).cast("double").alias("LOANS"), F.floor("s").cast("double").alias("PRICE"))


_CTE = dict(a=B.SQL_APPLICANTS, l=B.SQL_LOANS, r="""SELECT c_custkey, CASE WHEN TARGET IS NOT NULL THEN
  CAST(c_nationkey % 3 = 0 OR c_acctbal > 7000 AS INTEGER) END AS TARGET, CAST(floor(c_acctbal) AS DOUBLE) AS BALANCE,
  CAST(c_nationkey AS DOUBLE) AS NATION, CAST(coalesce(n, 0) AS DOUBLE) AS LOANS, CAST(floor(s) AS DOUBLE) AS PRICE
  FROM a LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(AMT_PRICE) AS s FROM l GROUP BY 1) ON o_custkey = c_custkey""")


def _extra_sql() -> str:
    """The forest level by level: ranges, drawn thresholds, gains, best column, next nodes."""
    cte = dict(_CTE, w0=f"SELECT *, unnest(range({TREES})) AS tree, CAST(1 AS BIGINT) AS node FROM r")
    for v in range(DEPTH):
        w = f"w{v}"
        long = " UNION ALL ".join(f"SELECT tree, node, TARGET AS y, {i} AS f, {c} AS x FROM {w} WHERE TARGET IS NOT NULL" for i, c in enumerate(FEATURES))
        cte[f"g{v}"] = f"SELECT tree, node, f, y, x FROM ({long})"
        cte[f"t{v}"] = (f"SELECT tree, node, f, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s, min(x) + (('0x' || substr(md5('{SEED}:' || tree || ':' || node || ':' || f), 1, 8))"
                        f"::BIGINT / 4294967296.0::DOUBLE) * (max(x) - min(x)) AS t FROM g{v} GROUP BY tree, node, f")
        cte[f"s{v}"] = (f"SELECT t.tree, t.node, t.f, t.n, t.s, t.t, count(*) FILTER (WHERE x <= t.t) AS nl, CAST(coalesce(sum(y) FILTER (WHERE x <= t.t), 0) AS DOUBLE) AS sl "
                        f"FROM t{v} t JOIN g{v} g ON g.tree = t.tree AND g.node = t.node AND g.f = t.f GROUP BY ALL")
        cte[f"b{v}"] = (f"SELECT tree, node, f, t FROM (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) AS gain FROM s{v} WHERE nl > 0 AND nl < n AND n >= 2) "
                        f"WHERE gain > s * s / n QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f) = 1")
        x = "CASE b.f " + " ".join(f"WHEN {i} THEN w.{c}" for i, c in enumerate(FEATURES)) + " END"
        cte[f"w{v + 1}"] = (f"SELECT w.* REPLACE (CASE WHEN b.f IS NULL THEN w.node WHEN {x} <= b.t THEN 2 * w.node ELSE 2 * w.node + 1 END AS node) "
                            f"FROM {w} w LEFT JOIN b{v} b ON b.tree = w.tree AND b.node = w.node")
    cte["p"] = f"SELECT tree, node, avg(TARGET) AS p FROM w{DEPTH} WHERE TARGET IS NOT NULL GROUP BY tree, node"
    return B.with_ctes(f"SELECT c_custkey, round(avg(p), 9) AS score FROM w{DEPTH} JOIN p USING (tree, node) GROUP BY c_custkey", **cte)


@query("extra_trees_scores", _extra_sql())
def extra_trees_scores(spark, d):
    rows = _rows(spark, d)
    model = T.fit_extra_trees(rows, "TARGET", FEATURES, TREES, DEPTH, seed=SEED)
    return rows.select("c_custkey", F.round(model.score(), 9).alias("score"))


@query("extra_trees_auc")
def extra_trees_auc(spark, d):
    """AUC of a deeper forest on a held-out third."""
    rows = _rows(spark, d).withColumn("third", hash_bucket("c_custkey", 3))
    model = T.fit_extra_trees(rows.where("third > 0"), "TARGET", FEATURES, n_trees=8, depth=5, seed=SEED)
    return auc_exact(rows.where("third = 0 and TARGET is not null").withColumn("score", model.score()), "score", "TARGET")


@query("boosted_early_stop")
def boosted_early_stop(spark, d):
    """Scores of all applicants from the rounds kept, and those rounds."""
    rows = _rows(spark, d)
    model = T.fit_boosted(rows, "c_custkey", "TARGET", FEATURES, hash_bucket("c_custkey", 4) == 0, rounds=12, leaves=6, depth=3,
                          rate=0.3, n_bins=8, patience=3)
    return model.transform(rows).select("c_custkey", "score", F.lit(model.best).alias("rounds"))
