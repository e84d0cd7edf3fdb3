"""Ranks, blends, top-k, AUC/ROC (W*, M14-M16, M25) and folds/splits
(M7-M9, M26, M27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rowwise as R
from ..operators import folds as FO
from ..operators import rank as RK
from . import bindings as B
from .registry import query, round_columns

W = B.with_ctes
SC = {"s": B.SQL_SCORES}
IMP = {"imp": B.sql_importance_long()}
H = "('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 8))::BIGINT"


def _h(c):
    return H.format(c=c)


@query("rank_min", W("SELECT c_custkey, CAST(rank() OVER (ORDER BY LGB) AS DOUBLE) AS LGB_RANK FROM s", **SC))
def rank_min(spark, d):
    s = B.model_scores(spark, d).select("c_custkey", "LGB")
    return RK.rank(s, "LGB", "LGB_RANK", method="min").select("c_custkey", "LGB_RANK")


def _ranks_sql():
    return "SELECT c_custkey, " + ", ".join(
        f"CAST(rank() OVER (ORDER BY {c}) AS DOUBLE) AS {c}" for c in B.SCORE_NAMES) + " FROM s"


def _all_ranks(spark, d):
    return RK.rank_columns(B.model_scores(spark, d), "c_custkey", B.SCORE_NAMES)


@query("rank_average_scaled", W("""SELECT c_custkey,
round(((LGB + XGB + CGB + ET + RF) / 5 - min((LGB + XGB + CGB + ET + RF) / 5) OVER ())
 / (max((LGB + XGB + CGB + ET + RF) / 5) OVER () - min((LGB + XGB + CGB + ET + RF) / 5) OVER ()), 10) AS RANK_SCORE
FROM r""", s=B.SQL_SCORES, r=_ranks_sql()))
def rank_average_scaled(spark, d):
    r = _all_ranks(spark, d).select("c_custkey", R.row_mean(B.SCORE_NAMES).alias("m"))
    out = RK.min_max_scale(r, "m", "RANK_SCORE").select("c_custkey", "RANK_SCORE")
    return round_columns(out, ["RANK_SCORE"], 10)


# fixed blend weights of the two-model rank blend
BLEND_WEIGHTS = {"LGB": 0.61, "XGB": 0.39}


@query("blend_weighted_rank", W("""SELECT c_custkey, round((LGB * 0.61 + XGB * 0.39) / count(*) OVER (), 10) AS BLEND
FROM r""", s=B.SQL_SCORES, r=_ranks_sql()))
def blend_weighted_rank(spark, d):
    scores = B.model_scores(spark, d)
    s, n = RK.rank_columns(scores, "c_custkey", list(BLEND_WEIGHTS)), scores.count()
    score = R.row_weighted_sum(list(BLEND_WEIGHTS), list(BLEND_WEIGHTS.values())) / F.lit(float(n))
    return s.select("c_custkey", F.round(score, 10).alias("BLEND"))


TOPK = 3


@query("topk_mean_importance", W(f"""SELECT feature, fold, importance FROM imp WHERE feature IN (
SELECT feature FROM imp GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT {TOPK})""", **IMP))
def topk_mean_importance(spark, d):
    imp = B.importance_long(spark, d)
    means = imp.groupBy("feature").agg(F.avg("importance").alias("m"))
    top = RK.top_k(means, [F.desc("m"), F.asc("feature")], TOPK).select("feature")
    return imp.join(F.broadcast(top), "feature", "left_semi")


@query("topk_threshold", W(f"""SELECT feature, m AS mean_importance FROM (SELECT feature, avg(importance) AS m FROM imp GROUP BY 1)
WHERE m > (SELECT m FROM (SELECT avg(importance) AS m FROM imp GROUP BY feature) ORDER BY m DESC LIMIT 1 OFFSET {TOPK})""", **IMP))
def topk_threshold(spark, d):
    means = B.importance_long(spark, d).groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return means.where(RK.kth_largest_threshold(means, "mean_importance", TOPK))


@query("importance_filter", W("""SELECT feature, avg(importance) AS mean_importance,
CAST(avg(importance) >= 50 AS INTEGER) AS strong FROM imp GROUP BY feature
HAVING avg(importance) <> 0 AND feature LIKE '%Q%'""", **IMP))
def importance_filter(spark, d):
    means = B.importance_long(spark, d).groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return (means.where((F.col("mean_importance") != 0) & F.col("feature").contains("Q"))
            .withColumn("strong", (F.col("mean_importance") >= 50).cast("int")))


@query("auc_exact", W("""SELECT (sum(r) FILTER (WHERE TARGET = 1) - count(*) FILTER (WHERE TARGET = 1) * (count(*) FILTER (WHERE TARGET = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE TARGET = 1) * count(*) FILTER (WHERE TARGET = 0)) AS auc,
  count(*) FILTER (WHERE TARGET = 1) AS n_pos, count(*) FILTER (WHERE TARGET = 0) AS n_neg FROM rk""",
                      s=B.SQL_SCORES, rk="""SELECT TARGET, rank() OVER (ORDER BY ET) + (count(*) OVER (PARTITION BY ET) - 1) / 2.0 AS r
FROM s WHERE TARGET IS NOT NULL"""))
def auc_exact(spark, d):
    return RK.auc_exact(B.model_scores(spark, d), "ET", "TARGET")


@query("roc_curve_points", W("""SELECT t.ET AS threshold,
CAST(count(*) FILTER (WHERE s.TARGET = 0 AND s.ET >= t.ET) AS DOUBLE) / (SELECT count(*) FROM s WHERE TARGET = 0) AS fpr,
CAST(count(*) FILTER (WHERE s.TARGET = 1 AND s.ET >= t.ET) AS DOUBLE) / (SELECT count(*) FROM s WHERE TARGET = 1) AS tpr
FROM (SELECT DISTINCT ET FROM s WHERE TARGET IS NOT NULL) t, s WHERE s.TARGET IS NOT NULL GROUP BY t.ET""", **SC))
def roc_curve_points(spark, d):
    return RK.roc_curve_points(B.model_scores(spark, d), "ET", "TARGET")


@query("roc_curve_corners", W("""SELECT threshold, fpr, tpr FROM (
SELECT ET AS threshold, p, n, lag(p) OVER o AS lp, lag(n) OVER o AS ln, lead(p) OVER o AS up,
CAST(sum(n) OVER d AS DOUBLE) / sum(n) OVER () AS fpr, CAST(sum(p) OVER d AS DOUBLE) / sum(p) OVER () AS tpr FROM
(SELECT ET, count(*) FILTER (WHERE TARGET = 1) AS p, count(*) FILTER (WHERE TARGET <> 1) AS n FROM s WHERE TARGET IS NOT NULL GROUP BY ET)
WINDOW o AS (ORDER BY ET), d AS (ORDER BY ET DESC)) WHERE lp IS NULL OR up IS NULL OR lp <> p OR ln <> n""", **SC))
def roc_curve_corners(spark, d):
    """ROC points without those inside straight stretches."""
    return RK.roc_curve_points(B.model_scores(spark, d), "ET", "TARGET", drop_intermediate=True)


@query("rmse", W("SELECT round(sqrt(avg((TARGET - ET) * (TARGET - ET))), 10) AS rmse FROM s WHERE TARGET IS NOT NULL", **SC))
def rmse(spark, d):
    s = B.model_scores(spark, d).where("TARGET IS NOT NULL")
    e = F.col("TARGET") - F.col("ET")
    return s.agg(F.round(F.sqrt(F.avg(e * e)), 10).alias("rmse"))


# -------------------------------------------------------------- folds ----

AP = {"a": B.SQL_APPLICANTS}


@query("holdout_split", W(f"SELECT c_custkey, CAST({_h('c_custkey')} % 100 < 30 AS INTEGER) AS is_holdout FROM a", **AP))
def holdout_split(spark, d):
    return FO.holdout_split(B.applicants(spark, d).select("c_custkey"), "c_custkey", 30)


@query("kfold_assign", W(f"SELECT c_custkey, CAST({_h('c_custkey')} % 5 AS INTEGER) AS fold FROM a", **AP))
def kfold_assign(spark, d):
    return FO.kfold_assign(B.applicants(spark, d).select("c_custkey"), "c_custkey", 5)


@query("stratified_kfold", W(f"""SELECT c_custkey, TARGET,
CAST((row_number() OVER (PARTITION BY TARGET ORDER BY {_h('c_custkey')}, c_custkey) - 1) % 5 AS INTEGER) AS fold
FROM a WHERE TARGET IS NOT NULL""", **AP))
def stratified_kfold(spark, d):
    a = B.applicants(spark, d).where("TARGET IS NOT NULL").select("c_custkey", "TARGET")
    return FO.stratified_kfold(a, "c_custkey", "TARGET", 5)


@query("bag_assign", W(f"SELECT c_custkey, CAST({_h('c_custkey')} % 11 AS INTEGER) AS bag FROM a", **AP))
def bag_assign(spark, d):
    return FO.bag_assign(B.applicants(spark, d).select("c_custkey"), "c_custkey", 11)


@query("downsample_majority", W(f"""SELECT c_custkey, TARGET FROM a WHERE TARGET IS NOT NULL
AND (TARGET <> 0 OR {_h('c_custkey')} % 100 < 40)""", **AP))
def downsample_majority(spark, d):
    a = B.applicants(spark, d).where("TARGET IS NOT NULL").select("c_custkey", "TARGET")
    return FO.downsample_majority(a, "c_custkey", "TARGET", 40)


@query("class_weight_column", W("""SELECT c_custkey, TARGET, CASE WHEN TARGET = 1 THEN 5.0 ELSE 1.0 END AS weight
FROM a WHERE TARGET IS NOT NULL""", **AP))
def class_weight_column(spark, d):
    a = B.applicants(spark, d).where("TARGET IS NOT NULL").select("c_custkey", "TARGET")
    return a.select("c_custkey", "TARGET", FO.class_weight_column("TARGET", 5.0))
