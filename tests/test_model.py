"""Model operators: folds are read from a written table, nothing but the learner's blocks is cached."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from ledgerlens.operators import model as ML
from ledgerlens.operators.folds import kfold_assign


@pytest.fixture(scope="module")
def rows(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(240).select(
        F.col("id").alias("c_custkey"), F.when(F.col("id") % 6 > 0, (h + (F.col("id") % 7) / 10.0 > 0.8).cast("int")).alias("TARGET"),
        h.alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("double")).alias("b")).localCheckpoint()


def test_cv_scores_are_those_of_cross_validator(spark, rows):
    lr = LogisticRegression(maxIter=5)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 5.0]).addGrid(lr.elasticNetParam, [0.0]).build()
    data = kfold_assign(ML.prepare(rows, ["a", "b"]), "c_custkey", 2).where("TARGET is not null") \
        .withColumn("TARGET", F.col("TARGET").cast("double"))
    want = CrossValidator(estimator=lr.copy().setLabelCol("TARGET"), estimatorParamMaps=grid, foldCol="fold", numFolds=2,
                          evaluator=BinaryClassificationEvaluator(labelCol="TARGET")).fit(data)
    means, best = ML.cross_validate(rows, "c_custkey", lambda: lr, k=2, grid=grid)
    assert means == pytest.approx(want.avgMetrics, abs=1e-9)
    assert best.coefficients.toArray() == pytest.approx(want.bestModel.coefficients.toArray(), abs=1e-6)
    got = ML.cv_score(rows, "c_custkey", lambda: lr, k=2, grid=grid)
    assert [m for _, m in got] == pytest.approx(means, abs=1e-9) and got[0][0] == {"regParam": 0.001, "elasticNetParam": 0.0}


def test_folds_leave_storage_memory_to_the_learner(spark, rows):
    cached = spark.sparkContext._jsc.getPersistentRDDs
    before = set(cached().keySet().toArray())
    table, feats = ML.fold_table(rows, "c_custkey", 3)
    assert feats == ["a", "b"] and table.storageLevel.useMemory is False and table.count() == 240
    r = ML.oof_predict(rows, "c_custkey", ML.ESTIMATORS["dt"], k=3, prepared=(table, feats))
    # the scores are read, not computed once more by the fold's model
    assert "UDF" not in r.oof._jdf.queryExecution().executedPlan().toString()
    assert r.oof.count() == 200 and r.test.count() == 40 and len(r.fold_auc) == 3
    assert r.oof.where("score between 0 and 1").select("c_custkey").distinct().count() == 200
    assert set(cached().keySet().toArray()) <= before
