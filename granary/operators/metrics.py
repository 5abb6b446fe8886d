"""Evaluation metrics as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.scan import running

EPS_MAPE = 2.220446049250313e-16
EPS_LOG = 1e-16


def rmse(df: DataFrame, y: str, p: str, name: str = "rmse") -> DataFrame:
    d = F.col(y).cast("double") - F.col(p).cast("double")
    return df.agg(F.sqrt(F.avg(d * d)).alias(name))


def rmse_by_round(df: DataFrame, y: str, p: str, round_: str = "round") -> DataFrame:
    d = F.col(y).cast("double") - F.col(p).cast("double")
    return df.groupBy(round_).agg(F.avg(d * d).alias("l2"), F.sqrt(F.avg(d * d)).alias("rmse"))


def mape(df: DataFrame, y: str, p: str, name: str = "mape") -> DataFrame:
    """Mean absolute percentage error as a fraction; a target of zero is replaced by a tiny number."""
    ratio = F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(F.col(y).cast("double")), F.lit(EPS_MAPE))
    return df.agg(F.avg(ratio).alias(name))


def logloss(df: DataFrame, y: str, p: str, name: str = "logloss") -> DataFrame:
    prob = F.least(F.greatest(F.col(p).cast("double"), F.lit(EPS_LOG)), F.lit(1.0 - EPS_LOG))
    loss = -F.when(F.col(y) > 0, F.log(prob)).otherwise(F.log(F.lit(1.0) - prob))
    return df.agg(F.avg(loss).alias(name))


def auc_by(df: DataFrame, keys: list[str], y: str, score: str, n_buckets: int | None = None) -> DataFrame:
    """ROC AUC per key, ties counted half.

    Rows are combined per score first; the running count over distinct scores is a bucketed
    scan. A key with only one class gets NULL.
    """
    pos = F.col(y) > 0
    at = (
        df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("__s"))
        .agg(F.count_if(pos).alias("__p"), F.count_if(~pos).alias("__n"))
    )
    below = running(at, keys, ["__s"], {"__upto": ("sum", F.col("__n"))}, n_buckets)
    # the double of the pair count stays an integer: negatives below count 2, ties count 1
    wins = F.col("__p") * (F.lit(2) * F.col("__upto") - F.col("__n"))
    total = below.groupBy(*keys).agg(
        F.sum("__p").alias("n_positive"),
        F.sum("__n").alias("n_negative"),
        F.sum(wins.cast("decimal(38,0)")).alias("__w"),
    )
    pairs = F.lit(2.0) * F.col("n_positive").cast("double") * F.col("n_negative").cast("double")
    return total.withColumn("auc", F.col("__w").cast("double") / F.nullif(pairs, F.lit(0.0))).drop("__w")


def auc(df: DataFrame, y: str, score: str, n_buckets: int | None = None) -> DataFrame:
    return auc_by(df, [], y, score, n_buckets)


def auc_ovr(df: DataFrame, y: str, scores: dict, n_buckets: int | None = None) -> DataFrame:
    """Mean one-vs-rest AUC; ``scores`` maps each class to the column with its score."""
    rows = F.array(
        *[
            F.struct(
                F.lit(str(k)).alias("class"),
                (F.col(y) == F.lit(k)).cast("int").alias("__y"),
                F.col(c).cast("double").alias("__score"),
            )
            for k, c in scores.items()
        ]
    )
    per = auc_by(df.select(F.inline(rows)), ["class"], "__y", "__score", n_buckets)
    return per.agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_classes"))


METRICS: dict[str, Callable[..., DataFrame]] = {
    "rmse": rmse,
    "neg_mean_absolute_percentage_error": mape,
    "roc_auc": auc,
    "roc_auc_ovr": auc_ovr,
    "logloss": logloss,
}


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x))
