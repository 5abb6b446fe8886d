import pytest
from pyspark.sql import functions as F

from granary.operators import memlog
from granary.plans import fixtures
from granary.streaming import replay


def test_peak_does_not_depend_on_the_order_of_files(spark, tables, tmp_path):
    log = fixtures.alloc_log(tables).select("device", "seq", "action", "pointer", "size")
    path = str(tmp_path / "log")
    for part in (2, 0, 1):
        low, high = 700 * part, 700 * (part + 1) if part < 2 else 10**9
        log.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    got = replay.peak_memory(replay.file_stream(spark, path, log.schema))
    want = memlog.peak_memory(log)
    assert sorted(map(tuple, got.select("device", "peak", "final_usage").collect())) == sorted(
        map(tuple, want.select("device", "peak", "final_usage").collect())
    )


def test_overlapping_files_are_refused(spark, tables, tmp_path):
    log = fixtures.alloc_log(tables).select("device", "seq", "action", "pointer", "size")
    path = str(tmp_path / "log")
    log.repartition(2).write.parquet(path)
    with pytest.raises(ValueError):
        replay.peak_memory(replay.file_stream(spark, path, log.schema))


def test_a_second_run_continues_behind_the_first(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(10).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    first = replay.drain(replay.file_stream(spark, path, schema), lambda rows: rows, state=state)
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(path)
    second = replay.drain(replay.file_stream(spark, path, schema), lambda rows: rows, state=state)
    assert spark.read.parquet(first).count() == 10 and spark.read.parquet(second).count() == 5
