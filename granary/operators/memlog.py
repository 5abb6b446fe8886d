"""Analytics over allocation logs: ``device, seq, action, pointer, size``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.scan import neighbours, prefix_by_bucket, running


def signed_size() -> Column:
    """Change of usage: an allocation adds, a free removes, a failure changes nothing."""
    return (
        F.when(F.col("action") == "allocate", F.col("size"))
        .when(F.col("action") == "free", -F.col("size"))
        .otherwise(F.lit(0).cast("bigint"))
    )


def peak_memory(df: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Per device: the highest running usage and the usage at the end."""
    out = prefix_by_bucket(df, ["device"], ["seq", "pointer"], signed_size(), n_buckets)
    return out.select("device", F.col("peak"), F.col("total").alias("final_usage"))


def running_usage(df: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """The log with usage after each action."""
    return running(df, ["device"], ["seq", "pointer"], {"usage": ("sum", signed_size())}, n_buckets)


def alloc_failures(df: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Failed allocations with the attempted size and the usage at that time."""
    return (
        running_usage(df, n_buckets)
        .where(F.col("action") == "allocate failure")
        .select("device", "seq", F.col("size").alias("attempted"), "usage")
    )


def alloc_failure_totals(failures: DataFrame) -> DataFrame:
    return failures.groupBy("device").agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.sum("attempted").alias("attempted"),
        F.max("usage").alias("max_usage"),
    )


def alloc_lifecycle(df: DataFrame, order: tuple[str, ...] = ("seq",), n_buckets: int | None = None) -> DataFrame:
    """Judge each action by the neighbouring action on the same pointer.

    An allocation that follows one is a double allocation, one that a free follows is paired, and
    one with nothing after it leaks; a free without an allocation before it is unknown.
    """
    log = df.where(F.col("action") != "allocate failure")
    near = neighbours(log, ["device", "pointer"], list(order), ["action", "seq"], n_buckets)
    alloc = F.col("action") == "allocate"
    state = (
        F.when(alloc & (F.col("prev_action") == "allocate"), "double_allocate")
        .when(alloc & (F.col("next_action") == "free"), "paired")
        .when(alloc & F.col("next_action").isNull(), "leak")
        .when(alloc, "overwritten")
        .when(F.col("prev_action") == "allocate", "free")
        .otherwise("unknown_free")
    )
    return near.withColumns(
        {"state": state, "lifetime": F.when(state == "paired", F.col("next_seq") - F.col("seq"))}
    ).drop("prev_action", "next_action", "prev_seq", "next_seq")
