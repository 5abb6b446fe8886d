"""Streaming queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators.split import with_batches
from granary.plans import fixtures as fx
from granary.plans import memory
from granary.plans.registry import Tables, query, r6
from granary.session import scratch_path
from granary.streaming import replay


@query(
    "stream_batch_replay",
    """
    SELECT event_id // 5000 AS batch_idx, count(*) AS n_rows, round(sum(value), 6) AS total, min(value) AS low,
      max(value) AS high FROM events GROUP BY 1
    """,
)
def _(t: Tables):
    """Stored batches, one file per trigger."""
    path = scratch_path(t.spark, "batches")
    stored = with_batches(t.events, "event_id", 5000).select("batch_idx", "row_in_batch", "value")
    stored.repartitionByRange(2, "batch_idx", "row_in_batch").write.parquet(path)
    out = replay.replay_batches(replay.file_stream(t.spark, path, stored.schema), "value")
    return out.withColumn("total", r6("total"))


@query(
    "stream_timer_totals",
    f"SELECT name, proc, round(sum(seconds), 6) AS seconds, count(*) AS n_calls FROM ({fx.TIMERS_SQL}) GROUP BY 1, 2",
)
def _(t: Tables):
    path = scratch_path(t.spark, "timers")
    log = fx.timers(t)
    log.repartition(2).write.parquet(path)
    return replay.timer_totals(replay.file_stream(t.spark, path, log.schema)).withColumn("seconds", r6("seconds"))


@query("stream_peak_memory", memory.PEAK_SQL)
def _(t: Tables):
    """The allocation log in three files, each with its own range of the log."""
    path = scratch_path(t.spark, "alloc-log")
    log = fx.alloc_log(t).select("device", "seq", "action", "pointer", "size")
    log.repartitionByRange(3, "seq", "pointer").write.parquet(path)
    return replay.peak_memory(replay.file_stream(t.spark, path, log.schema), n_buckets=4)


@query("stream_batch_files", "SELECT CAST(count(*) AS BIGINT) AS n_rows, round(sum(value), 6) AS total FROM events")
def _(t: Tables):
    """The event file itself as a stream."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("event_id", "value").schema
    stream = replay.file_stream(t.spark, t.sf_dir, schema, glob="events.parquet")
    out = replay.replay_batches(stream.withColumn("batch_idx", F.lit(0)), "value")
    return out.select("n_rows", r6("total").alias("total"))
