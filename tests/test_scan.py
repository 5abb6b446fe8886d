"""Bucketed scans equal plain windows, whatever the number of buckets and however skewed the keys."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.arith import count_at_most
from granary.operators import scan


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows under one key, some keys with a single row, and a NULL key."""
    i = F.col("id")
    return spark.range(600).select(
        F.when(i % 2 == 0, 0).when(i % 13 == 0, None).when(i > 590, i).otherwise(i % 5).alias("k"),
        (i * 7919 % 600).alias("at"),
        ((i * 31) % 17 - 8).alias("v"),
        F.when(i % 3 != 0, i % 11).alias("maybe"),
    )


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_running(skewed, n):
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumns(
        {"s": F.sum("v").over(w), "c": F.count("maybe").over(w), "lo": F.min("maybe").over(w), "hi": F.max("v").over(w)}
    )
    aggs = {"s": ("sum", F.col("v")), "c": ("count", F.col("maybe")), "lo": ("min", F.col("maybe")), "hi": ("max", F.col("v"))}
    assert rows(scan.running(skewed, ["k"], ["at"], aggs, n)) == rows(want)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_neighbours(skewed, n):
    w = Window.partitionBy("k").orderBy("at")
    want = skewed.withColumns({"prev_maybe": F.lag("maybe").over(w), "next_maybe": F.lead("maybe").over(w)})
    assert rows(scan.neighbours(skewed, ["k"], ["at"], ["maybe"], n)) == rows(want)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_rank_without_key(skewed, n):
    got = scan.rank_within(skewed, [], ["at"], "r", n)
    assert got.where(F.col("r") != F.col("at") + 1).count() == 0


def test_rank_of_strings(spark):
    df = spark.range(300).select(F.concat(F.lit("https://host/"), F.lpad(F.col("id") * 7 % 300, 4, "0")).alias("u"))
    got = scan.rank_within(df, [], ["u"], "r", 9)
    assert [r["r"] for r in got.orderBy("u").collect()] == list(range(1, 301))


def test_rank_of_timestamps(spark):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 37 % 200).alias("ts"))
    got = scan.rank_within(df, [], ["ts"], "r", 5)
    assert [r["r"] for r in got.orderBy("ts").collect()] == list(range(1, 201))


def test_buckets_hold_about_equal_rows(skewed):
    cuts = scan.order_cuts(skewed, "at", 8)
    sizes = [r["count"] for r in scan._bucketed(skewed, "at", cuts).groupBy("__bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 600 / 8


def test_small_tables_take_one_window(skewed):
    assert scan.order_cuts(skewed, "at") == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 6))
def test_peak(spark, deltas, n):
    log = spark.createDataFrame([(0, i, d) for i, d in enumerate(deltas)], "device INT, seq BIGINT, d BIGINT")
    got = scan.prefix_by_bucket(log, ["device"], ["seq"], F.col("d"), n).first()
    total, peak = 0, 0
    for d in deltas:
        total += d
        peak = max(peak, total)
    assert (got["total"], got["peak"]) == (total, peak)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-9, 9), max_size=20, unique=True), st.floats(-10, 10))
def test_count_at_most(spark, cuts, value):
    got = spark.range(1).select(count_at_most(F.lit(value), sorted(cuts))).first()[0]
    assert got == sum(c <= value for c in cuts)


@pytest.mark.parametrize("cuts", [2, 3, 8])
def test_more_buckets_than_cuts(skewed, monkeypatch, cuts):
    monkeypatch.setattr(scan, "MAX_CUTS", cuts)
    assert scan._divide(skewed, "at", 40)[1] == -(-40 // cuts)
    w = Window.partitionBy("k").orderBy("at")
    want = skewed.withColumns({"s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "prev_v": F.lag("v").over(w), "next_v": F.lead("v").over(w)})
    got = scan.neighbours(scan.running(skewed, ["k"], ["at"], {"s": ("sum", F.col("v"))}, 40), ["k"], ["at"], ["v"], 40)
    assert rows(got) == rows(want)
    sizes = scan._bucketed(skewed, "at", *scan._divide(skewed, "at", 40)).groupBy("__bucket").count().toPandas()
    assert len(sizes) > 30 and sizes["count"].max() < 60
