"""Model-data operators on Spark ML (M*): rows-only checks (no SQL oracle)."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from ..operators import model as ML
from ..operators.folds import holdout_split
from ..sources.io import sink_roundtrip
from . import bindings as B
from . import mart as M
from .registry import query

KEY, LABEL = "c_custkey", "TARGET"


def _training_table(spark, d):
    """The applicant mart, written once as Parquet to the shared folder: every fold, trial and fit
    step then reads it instead of re-planning the joins, and reads only the columns it needs."""
    return sink_roundtrip(spark, M.build(spark, d), "training")


@query("oof_predict")
def oof_predict(spark, d):
    r = ML.oof_predict(_training_table(spark, d), KEY, ML.ESTIMATORS["gbt"], k=5, positive_weight=5.0)
    return (r.oof.select(KEY, "score", F.lit("oof").alias("kind"))
            .unionByName(r.test.select(KEY, "score", F.lit("test").alias("kind"))))


# companions with an exact answer: which rows are scored, by which fold, and how
_FOLD = "CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % {k} AS INTEGER)"


@query("oof_membership", B.with_ctes(f"""SELECT c_custkey, CASE WHEN TARGET IS NULL THEN 'test' ELSE 'oof' END AS kind,
CASE WHEN TARGET IS NOT NULL THEN {_FOLD.format(k=3)} END AS fold, true AS score_in_range FROM a""", a=B.SQL_APPLICANTS))
def oof_membership(spark, d):
    r = ML.oof_predict(_training_table(spark, d), KEY, ML.ESTIMATORS["dt"], k=3)
    ok = F.col("score").between(0, 1).alias("score_in_range")
    return (r.oof.select(KEY, F.lit("oof").alias("kind"), F.col("fold").cast("int").alias("fold"), ok)
            .unionByName(r.test.select(KEY, F.lit("test").alias("kind"), F.lit(None).cast("int").alias("fold"), ok)))


@query("oof_fold_sizes", B.with_ctes(f"""SELECT {_FOLD.format(k=5)} AS fold, count(*) AS n_rows, min(c_custkey) AS first_id,
max(c_custkey) AS last_id FROM a WHERE TARGET IS NOT NULL GROUP BY 1""", a=B.SQL_APPLICANTS))
def oof_fold_sizes(spark, d):
    r = ML.oof_predict(_training_table(spark, d), KEY, ML.ESTIMATORS["dt"], k=5)
    return r.oof.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(KEY).alias("first_id"), F.max(KEY).alias("last_id"))


@query("oof_auc")
def oof_auc(spark, d):
    """Overall AUC over all out-of-fold rows beside the mean of the folds' AUCs."""
    data = _training_table(spark, d)
    r = ML.oof_predict(data, KEY, ML.ESTIMATORS["lr"], k=3)
    return spark.createDataFrame([(float(ML.overall_auc(r, data, KEY, LABEL)), sum(r.fold_auc) / len(r.fold_auc))],
                                 "overall_auc double, mean_fold_auc double")


@query("stack_auc_matrix")
def stack_auc_matrix(spark, d):
    names = {"LR": ML.ESTIMATORS["lr"], "DT": ML.ESTIMATORS["dt"]}
    return ML.auc_matrix(ML.stack(_training_table(spark, d), KEY, names, k=3), [*names, "STACK"], LABEL)


@query("stack_oof_matrix")
def stack_oof_matrix(spark, d):
    return ML.stack(_training_table(spark, d), KEY, {"LR": ML.ESTIMATORS["lr"], "DT": ML.ESTIMATORS["dt"]}, k=3)


@query("importance_table")
def importance_table(spark, d):
    return ML.oof_predict(_training_table(spark, d), KEY, ML.ESTIMATORS["gbt"], k=3,
                          with_importance=True).importances


@query("bagged_scores")
def bagged_scores(spark, d):
    return ML.bagged_scores(_training_table(spark, d), KEY, ML.ESTIMATORS["lr"], n_bags=11)


def _results_frame(spark, rows):
    return spark.createDataFrame([(json.dumps(p, sort_keys=True, default=str), float(m)) for p, m in rows],
                                 "params string, auc double")


@query("cv_score")
def cv_score(spark, d):
    return _results_frame(spark, ML.cv_score(_training_table(spark, d), KEY, ML.ESTIMATORS["lr"], k=3))


@query("grid_search")
def grid_search(spark, d):
    lr = LogisticRegression()
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.1]).addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
    rows = ML.cv_score(_training_table(spark, d), KEY, lambda: lr, k=3, grid=grid)
    return _results_frame(spark, rows)


@query("random_search")
def random_search(spark, d):
    def make(p):
        return GBTClassifier(maxIter=10, stepSize=p["stepSize"], maxDepth=int(round(p["maxDepth"])), seed=47)
    rows = ML.random_search(_training_table(spark, d), KEY, {"stepSize": (0.05, 0.3), "maxDepth": (2, 4)},
                            make, n_trials=2, k=3)
    return _results_frame(spark, rows)


def _score(spark, d, name):
    data = holdout_split(_training_table(spark, d), KEY, 30)
    feats = ML.numeric_features(data, [KEY, LABEL, "is_holdout"])
    train = data.where((F.col("is_holdout") == 0) & F.col(LABEL).isNotNull())
    prepared = ML.prepare(data, feats, LABEL, fit_on=train)
    fit_rows = prepared.where((F.col("is_holdout") == 0) & F.col(LABEL).isNotNull()) \
        .withColumn(LABEL, F.col(LABEL).cast("double"))
    model = ML.ESTIMATORS[name]().setLabelCol(LABEL).setFeaturesCol("features").fit(fit_rows)
    return ML.positive_probability(model.transform(prepared)).select(KEY, "is_holdout", "score")


for _name in ("lr", "gbt", "rf", "dt", "nb"):
    query(f"score_{_name}")(lambda spark, d, _n=_name: _score(spark, d, _n))


@query("l1_select")
def l1_select(spark, d):
    rows = ML.l1_select(_training_table(spark, d), KEY, reg=0.005)
    return spark.createDataFrame(rows, "feature string, coef double")


@query("pipeline_datahandle")
def pipeline_datahandle(spark, d):
    data = _training_table(spark, d)
    return ML.DataHandle(missing_rate=0.3, id_col=KEY, label=LABEL).fit(data).transform(data)
