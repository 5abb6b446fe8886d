"""Incremental forms of batch replay, stage totals and peak memory.

Each query reads stored files as a stream, a bounded number per trigger, until all are read. Every
trigger leaves a small table under its own number, so a trigger that is run again after a failure
replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.memlog import signed_size
from granary.operators.scan import fold_peaks, prefix_by_bucket
from granary.session import scratch_path


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, glob: str | None = None
) -> DataFrame:
    """Parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drain(
    stream: DataFrame, each: Callable[[DataFrame], DataFrame], mode: str = "append", state: str | None = None
) -> str:
    """Run a stream to its end; returns the folder with the output of each trigger.

    ``state`` is the checkpoint of the stream: with the same one a later run continues behind the
    files already read.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")

    def write(rows: DataFrame, number: int) -> None:
        each(rows).write.mode("overwrite").parquet(f"{out}/trigger={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return out


def replay_batches(stream: DataFrame, value: str, batch: str = "batch_idx") -> DataFrame:
    """Rows, sum and extremes per stored batch, combined from one part per trigger and batch."""

    def part(rows: DataFrame) -> DataFrame:
        return rows.groupBy(batch).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(value).alias("total"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )

    parts = stream.sparkSession.read.parquet(drain(stream, part))
    return parts.groupBy(batch).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def timer_totals(stream: DataFrame) -> DataFrame:
    """Seconds and calls per (name, proc), kept in the state store; the last trigger holds the totals."""
    totals = stream.groupBy("name", "proc").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n_calls"))
    seen = stream.sparkSession.read.parquet(drain(totals, lambda rows: rows, mode="complete"))
    last = seen.agg(F.max("trigger")).scalar()
    return seen.where(F.col("trigger") == last).drop("trigger")


def peak_memory(stream: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Peak and final usage per device.

    A trigger is reduced to one (total, peak) pair per device by the bucketed scan, so that a busy
    device is spread over tasks; pairs are folded in log order. Files may arrive in any order, but
    each trigger must cover its own range of ``seq``.
    """

    def part(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("device").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        sums = prefix_by_bucket(rows, ["device"], ["seq", "pointer"], signed_size(), n_buckets)
        return sums.withColumnsRenamed({"total": "__total", "peak": "__peak"}).join(ends, "device")

    parts = stream.sparkSession.read.parquet(drain(stream, part))
    check_ranges(parts)
    return fold_peaks(parts, ["device"], "first_seq").withColumnsRenamed({"total": "final_usage"})


def check_ranges(parts: DataFrame) -> None:
    """Refuse triggers whose ranges of ``seq`` overlap on a device: their order would be undefined."""
    from pyspark.sql.window import Window

    after = F.lead("first_seq").over(Window.partitionBy("device").orderBy("first_seq"))
    bad = parts.select("device", "last_seq", after.alias("next_seq")).where(F.col("next_seq") < F.col("last_seq"))
    if bad.limit(1).count():
        raise ValueError("triggers overlap in seq: read the log in files that each cover their own range")
