"""Cross-validated comparison of estimators and categorical encodings."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import metrics
from granary.operators.clean import fill_missing
from granary.operators.forest import predict
from granary.operators.split import assign_folds
from granary.operators.train import train_gbt
from granary.session import materialize
from granary.sources.datasets import BINARY, MULTICLASS, REGRESSION, encoded

ENCODINGS = ("ord", "ohe", "nohe", "part")
# leaf-wise growth is the same trainer with another policy; the ml estimators take no native categories
TRAINERS = {
    "hist": {"tree_method": "hist"},
    "approx": {"tree_method": "approx"},
    "exact": {"tree_method": "exact"},
    "leafwise": {"tree_method": "hist", "grow_policy": "lossguide"},
}
BASELINES = ("ml_gbt", "ml_forest")
ONEHOT_ALWAYS = 2**31 - 1
FIXED = {"reg_lambda": 0.0, "alpha": 0.0, "max_bin": 16, "min_child_weight": 1e-6, "eta": 1.0}


def algorithms() -> list[str]:
    """All supported ``estimator-encoding`` names."""
    native = [f"{t}-{e}" for t in TRAINERS for e in ENCODINGS if not (t == "exact" and e in ("nohe", "part"))]
    return native + [f"{b}-{e}" for b in BASELINES for e in ("ord", "ohe")]


def ml_estimator(name: str, features: Sequence[str], label: str, task: str, n_iter: int, depth: int, n_classes: int = 2):
    """A Spark ML pipeline on encoded features; missing values must be filled before."""
    if name == "ml_gbt":
        if task == MULTICLASS:
            raise ValueError("ml_gbt has no multi-class form")
        kind = GBTRegressor if task == REGRESSION else GBTClassifier
        est = kind(featuresCol="__x", labelCol=label, maxIter=n_iter, maxDepth=depth, seed=0)
    elif name == "ml_forest":
        kind = RandomForestRegressor if task == REGRESSION else RandomForestClassifier
        est = kind(featuresCol="__x", labelCol=label, numTrees=n_iter, maxDepth=depth, seed=0)
    else:
        raise ValueError(f"unknown estimator: {name}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x"), est])


def _safe_names(df: DataFrame, label: str, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Feature columns as f0, f1, ..: one-hot names may hold dots or spaces."""
    names = [c for c in df.columns if c != label and c not in keep]
    return df.select(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)], label, *keep), [
        f"f{i}" for i in range(len(names))
    ]


def scored(
    estimator: str,
    encoding: str,
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    mask: list[bool] | None,
    label: str,
    task: str,
    n_iter: int,
    depth: int,
    max_cat_threshold: int,
    n_classes: int,
) -> tuple[DataFrame, float]:
    """Fit on ``train``; (``test`` with a ``prediction`` column, seconds)."""
    begin = time.perf_counter()
    if estimator in BASELINES:
        pipeline = ml_estimator(estimator, features, label, task, n_iter, depth, n_classes)
        fitted = pipeline.fit(fill_missing(train, -1))
        seconds = time.perf_counter() - begin
        out = fitted.transform(fill_missing(test, -1))
        if task == REGRESSION:
            return out, seconds
        probs = vector_to_array("probability")
        chosen = F.get(probs, F.lit(1)) if task == BINARY else probs
        return out.withColumn("prediction", chosen), seconds
    native = encoding in ("nohe", "part")
    params = {
        **FIXED,
        **TRAINERS[estimator],
        "max_depth": depth,
        "objective": task,
        "max_cat_threshold": max_cat_threshold,
        "max_cat_to_onehot": ONEHOT_ALWAYS if encoding == "nohe" else 1,
        "base_score": 0.5 if task == BINARY else 0.0,
        "num_class": n_classes if task == MULTICLASS else 0,
    }
    cats = [f for f, c in zip(features, mask or []) if c] if native else []
    model = train_gbt(train, features, label, params, n_iter, categorical=cats)
    seconds = time.perf_counter() - begin
    return predict(test, model), seconds


def score_of(df: DataFrame, label: str, task: str, n_classes: int) -> float:
    """The metric of the task; an error counts negative, so that larger is better."""
    if task == REGRESSION:
        return -metrics.mape(df, label, "prediction").first()[0]
    if task == BINARY:
        return metrics.auc(df, label, "prediction").first()["auc"]
    split = df.withColumns({f"__p{k}": F.get("prediction", F.lit(k)) for k in range(n_classes)})
    return metrics.auc_ovr(split, label, {k: f"__p{k}" for k in range(n_classes)}).first()["auc"]


def cross_validate(
    df: DataFrame,
    label: str,
    row_id: str,
    task: str,
    names: Sequence[str],
    k: int = 3,
    n_iter: int = 128,
    depth: int = 6,
    max_cat_threshold: int = 32,
    n_classes: int = 2,
) -> DataFrame:
    """``algo, fold, fit_time, score`` for each named estimator and encoding.

    Classifiers get stratified folds. Each encoding is computed and written once and read by all
    folds and estimators that use it.
    """
    spark = df.sparkSession
    folded = assign_folds(df, k, row_id, label if task != REGRESSION else None).drop(row_id)
    tables: dict[str, tuple] = {}
    rows = []
    for name in names:
        estimator, encoding = name.rsplit("-", 1)
        if name not in algorithms():
            raise ValueError(f"unknown algorithm: {name}")
        if encoding not in tables:
            coded, mask = encoded(folded.withColumnRenamed("fold", "__fold"), encoding, label)
            if mask is not None:
                mask = [m for c, m in zip(coded.columns, mask) if c != "__fold"]
            safe, columns = _safe_names(coded, label, ["__fold"])
            tables[encoding] = (materialize(safe, f"encoded-{encoding}"), columns, mask)
        table, columns, mask = tables[encoding]
        for fold in range(k):
            train, test = table.where(F.col("__fold") != fold), table.where(F.col("__fold") == fold)
            out, seconds = scored(
                estimator, encoding, train, test, columns, mask, label, task, n_iter, depth, max_cat_threshold, n_classes
            )
            rows.append((name, fold, seconds, float(score_of(out, label, task, n_classes))))
    return spark.createDataFrame(rows, "algo STRING, fold INT, fit_time DOUBLE, score DOUBLE")
