"""Training and scoring on Spark ML: imputation, folds, out-of-fold
prediction, stacking, bagging, searches, importances.

The feature table has one row per applicant; it is assembled once into a
vector column and written to the shared folder, then every fold/trial is an
ordinary Spark ML fit over it.  It is read a few times a fit, the learner's own
blocks at every step: only those are held in the executors' storage memory.  Predictions are DataFrames keyed by id (never positional
arrays); fold scores are one aggregate each.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import sink_roundtrip
from .clean import drop_sparse_columns
from .folds import bag_assign, kfold_assign
from .profile import fit_mean_imputer, fit_zscore

Factory = Callable[[], object]

ESTIMATORS: dict[str, Factory] = {
    "lr": lambda: LogisticRegression(maxIter=50, regParam=0.01),
    "gbt": lambda: GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=47),
    "rf": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=47),
    "dt": lambda: DecisionTreeClassifier(maxDepth=4, impurity="gini", seed=47),
    "nb": lambda: NaiveBayes(modelType="gaussian"),
}


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in exclude and
            f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]


def prepare(df: DataFrame, features: Sequence[str], label: str = "TARGET",
            fit_on: DataFrame | None = None) -> DataFrame:
    """Mean-impute (fitted on labelled rows) and assemble ``features``."""
    src = fit_on if fit_on is not None else df.where(F.col(label).isNotNull())
    imp = fit_mean_imputer(src, features)
    filled = imp.transform(df)
    # columns with no value at all stay NULL after imputation -> 0
    filled = filled.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                             if c in features else F.col(c) for c in filled.columns])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def positive_probability(pred: DataFrame, out: str = "score") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def auc(pred: DataFrame, label: str = "TARGET", raw: str = "rawPrediction") -> float:
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC")
    return ev.evaluate(pred)


@dataclass
class OOFResult:
    oof: DataFrame          # (id, fold, score) for labelled rows
    test: DataFrame         # (id, score) = mean over fold models, unlabelled rows
    fold_auc: list[float]
    importances: DataFrame | None


def fold_table(data: DataFrame, id_col: str, k: int, label: str = "TARGET",
               features: Sequence[str] | None = None, positive_weight: float | None = None) -> tuple[DataFrame, list[str]]:
    """``(id, label, fold, features)`` imputed, assembled and written once for
    any number of models over the same folds, and the feature names."""
    feats = list(features) if features is not None else numeric_features(data, [id_col, label])
    prepared = kfold_assign(prepare(data, feats, label), id_col, k)
    extra = []
    if positive_weight is not None:
        from .folds import class_weight_column
        extra = [class_weight_column(label, positive_weight, "weight")]
    return sink_roundtrip(data.sparkSession, prepared.select(id_col, label, "fold", "features", *extra), "folds"), feats


def mean_probability(models: Sequence, df: DataFrame, id_col: str) -> DataFrame:
    """``(id, score)``: the mean positive probability of several models, in one
    pass over ``df`` (each model adds its own columns; no shuffle)."""
    for i, m in enumerate(models):
        df = (m.copy().setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setPredictionCol(f"__y{i}").transform(df))
    total = reduce(lambda x, y: x + y, [vector_to_array(f"__p{i}")[1] for i in range(len(models))])
    return df.select(id_col, (total / len(models)).alias("score"))


def oof_predict(data: DataFrame, id_col: str, factory: Factory, k: int = 5,
                label: str = "TARGET", features: Sequence[str] | None = None,
                with_importance: bool = False, positive_weight: float | None = None,
                prepared: tuple[DataFrame, list[str]] | None = None) -> OOFResult:
    """K-fold out-of-fold prediction: per fold train on the other folds,
    score the held-out fold and the unlabelled rows.  ``positive_weight``
    re-weights the positive class (``weightCol``, the scale_pos_weight
    setting of the boosted models).  ``prepared`` is a ``fold_table`` shared
    by several calls.  Every held-out fold is scored once and its scores
    written; AUCs and results are read from them."""
    spark = data.sparkSession
    table, feats = prepared or fold_table(data, id_col, k, label, features, positive_weight)
    labelled = table.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    oofs, models, aucs, imps = [], [], [], []
    for i in range(k):
        est = factory().setLabelCol(label).setFeaturesCol("features")
        if positive_weight is not None and est.hasParam("weightCol"):
            est = est.setWeightCol("weight")
        model = est.fit(labelled.where(F.col("fold") != i))
        models.append(model)
        held = positive_probability(model.transform(labelled.where(F.col("fold") == i)))
        held = sink_roundtrip(spark, held.select(id_col, label, "fold", "rawPrediction", "score"), "held")
        aucs.append(auc(held, label))
        oofs.append(held.select(id_col, "fold", "score"))
        if with_importance and hasattr(model, "featureImportances"):
            vals = model.featureImportances.toArray().tolist()
            imps.append(spark.createDataFrame([(f, float(v), i) for f, v in zip(feats, vals)],
                                              "feature string, importance double, fold int"))
    test = mean_probability(models, table.where(F.col(label).isNull()), id_col)
    return OOFResult(reduce(DataFrame.unionByName, oofs), test, aucs,
                     reduce(DataFrame.unionByName, imps) if imps else None)


def overall_auc(result: OOFResult, data: DataFrame, id_col: str, label: str = "TARGET") -> float:
    """One AUC over all out-of-fold rows (not the mean of the folds' AUCs)."""
    from .rank import auc_exact
    scored = result.oof.join(data.select(id_col, label), id_col)
    return auc_exact(scored, "score", label).first()["auc"]


def stack(data: DataFrame, id_col: str, base: dict[str, Factory], k: int = 5,
          label: str = "TARGET") -> DataFrame:
    """Level-1 OOF scores of each base model joined on id, then a logistic
    meta model trained on the OOF matrix (its own OOF for labelled rows).
    The base models share one prepared table."""
    shared = fold_table(data, id_col, k, label)
    mats = []
    for name, f in base.items():
        r = oof_predict(data, id_col, f, k, label, prepared=shared)
        mats.append(r.oof.select(id_col, "score").unionByName(r.test).withColumnRenamed("score", name))
    matrix = sink_roundtrip(data.sparkSession, reduce(lambda a, b: a.join(b, id_col), mats)
                            .join(data.select(id_col, label), id_col), "stack")
    meta = oof_predict(matrix, id_col, lambda: LogisticRegression(maxIter=50), k, label, list(base))
    meta_scores = meta.oof.select(id_col, "score").unionByName(meta.test)
    return matrix.join(meta_scores.withColumnRenamed("score", "STACK"), id_col)


def auc_matrix(scores: DataFrame, columns: Sequence[str], label: str = "TARGET") -> DataFrame:
    """``(model, auc, n_pos, n_neg)``: one overall AUC per score column, labelled rows only."""
    from .rank import auc_exact
    rows = scores.where(F.col(label).isNotNull())
    return reduce(DataFrame.unionByName, [auc_exact(rows, c, label).select(F.lit(c).alias("model"), "auc", "n_pos", "n_neg")
                                          for c in columns])


def bagged_scores(data: DataFrame, id_col: str, factory: Factory, n_bags: int = 11,
                  label: str = "TARGET") -> DataFrame:
    """One model per disjoint id bag; score = mean over bag models, which score
    the table in one pass."""
    feats = numeric_features(data, [id_col, label])
    prepared = sink_roundtrip(data.sparkSession, bag_assign(prepare(data, feats, label), id_col, n_bags)
                              .select(id_col, label, "bag", "features"), "bags")
    labelled = prepared.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    models = [factory().setLabelCol(label).setFeaturesCol("features").fit(labelled.where(F.col("bag") == b))
              for b in range(n_bags)]
    return mean_probability(models, prepared.select(id_col, "features"), id_col)


def cross_validate(data: DataFrame, id_col: str, factory: Factory, k: int = 5, label: str = "TARGET",
                   grid: list | None = None, parallelism: int = 2) -> tuple[list[float], object]:
    """Mean AUC over hash folds of every grid point, and the best point's model on all labelled rows:
    Spark ML's ``CrossValidator``, which caches each fold's rows beside the learner's blocks, over a
    written table instead.  ``parallelism`` grid points are fitted at the same time."""
    table, _ = fold_table(data, id_col, k, label)
    rows = table.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias(label), "fold", "features")
    est = factory().setLabelCol(label).setFeaturesCol("features")
    grid = grid if grid is not None else ParamGridBuilder().build()

    def score(point: tuple[int, dict]) -> float:
        fold, params = point
        held = est.fit(rows.where(F.col("fold") != fold), params).transform(rows.where(F.col("fold") == fold))
        held = held.select(label, "rawPrediction").persist(StorageLevel.MEMORY_AND_DISK)   # a pair of doubles a row
        try:
            return auc(held, label)
        finally:
            held.unpersist()

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        aucs = list(pool.map(score, [(i, p) for i in range(k) for p in grid]))
    means = [sum(aucs[j::len(grid)]) / k for j in range(len(grid))]
    return means, est.fit(rows, grid[max(range(len(grid)), key=means.__getitem__)])


def cv_score(data: DataFrame, id_col: str, factory: Factory, k: int = 5, label: str = "TARGET",
             grid: list | None = None, parallelism: int = 2):
    """Mean AUC over hash folds per grid point."""
    grid = grid if grid is not None else ParamGridBuilder().build()
    means, _ = cross_validate(data, id_col, factory, k, label, grid, parallelism)
    return [({p.name: v for p, v in pm.items()}, m) for pm, m in zip(grid, means)]


def random_search(data: DataFrame, id_col: str, space: dict[str, tuple[float, float]],
                  make: Callable[[dict], object], n_trials: int = 4, seed: int = 918, k: int = 3,
                  label: str = "TARGET", threads: int = 2):
    """Seeded random search; each trial is a K-fold OOF run scored by its
    overall AUC.  Trials run concurrently against one session."""
    rng = random.Random(seed)
    trials = [{p: rng.uniform(lo, hi) for p, (lo, hi) in space.items()} for _ in range(n_trials)]

    shared = fold_table(data, id_col, k, label)

    def run(params):
        r = oof_predict(data, id_col, lambda: make(params), k, label, prepared=shared)
        return params, overall_auc(r, data, id_col, label)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(run, trials))


def l1_select(data: DataFrame, id_col: str, reg: float = 0.01, label: str = "TARGET",
              tol: float = 1e-5) -> list[tuple[str, float]]:
    """Features kept by an L1 logistic regression (|coef| > tol)."""
    feats = numeric_features(data, [id_col, label])
    prepared = prepare(data, feats, label).where(F.col(label).isNotNull()) \
        .withColumn(label, F.col(label).cast("double"))
    z = fit_zscore(prepared, feats)  # standardise so the penalty is fair
    scaled = VectorAssembler(inputCols=feats, outputCol="features").transform(
        z.transform(prepared.drop("features")).na.fill(0.0, feats))
    lr = LogisticRegression(elasticNetParam=1.0, regParam=reg, maxIter=100, labelCol=label,
                            standardization=False).fit(scaled)
    coefs = lr.coefficients.toArray().tolist()
    return [(f, float(c)) for f, c in zip(feats, coefs) if abs(c) > tol]


class DataHandle:
    """Preprocessing object: missing-rate filter -> one-hot -> impute ->
    scale -> L1 selection, with ``fit``/``transform``."""

    def __init__(self, missing_rate: float = 0.3, id_col: str = "c_custkey", label: str = "TARGET",
                 reg: float = 0.01):
        self.missing_rate, self.id_col, self.label, self.reg = missing_rate, id_col, label, reg
        self.clear()

    def clear(self) -> "DataHandle":
        """Forgets everything fitted; the settings stay."""
        self.columns: list[str] = []
        self.onehot = self.imputer = self.scaler = None
        return self

    def fit(self, df: DataFrame) -> "DataHandle":
        from .encode import fit_one_hot
        self.clear()
        kept = drop_sparse_columns(df, self.missing_rate, inclusive=False, keep=[self.id_col, self.label])
        self.onehot = fit_one_hot(kept, [f.name for f in kept.schema.fields
                                        if f.dataType.typeName() == "string"])
        enc = self.onehot.transform(kept)
        feats = numeric_features(enc, [self.id_col, self.label])
        self.imputer = fit_mean_imputer(enc.where(F.col(self.label).isNotNull()), feats)
        filled = self.imputer.transform(enc)
        self.scaler = fit_zscore(filled, feats)
        selected = l1_select(self.scaler.transform(filled), self.id_col, self.reg, self.label)
        self.columns = [f for f, _ in selected] or feats
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.onehot is None:
            raise RuntimeError("fit first")
        enc = self.onehot.transform(df)
        out = self.scaler.transform(self.imputer.transform(enc))
        return out.select(self.id_col, self.label, *[F.col(c) for c in self.columns])
