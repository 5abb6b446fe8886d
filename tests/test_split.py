"""Literal values of the split and shard rules."""

import pytest
from pyspark.sql import functions as F

from granary.operators import split
from granary.sources import synth


@pytest.mark.parametrize(
    "offsets,fold,want",
    [([0, 3, 6], 0, (0, 0, 0, 1)), ([0, 3, 6], 1, (0, 1, 0, 2)), ([0, 8, 10], 2, (0, 4, 0, 6)), ([0, 5, 10], 2, (0, 4, 1, 1))],
)
def test_fold_spans(offsets, fold, want):
    assert split.shard_span(offsets, *split.fold_bounds(offsets[-1], fold)) == want


def test_whole_batch_span():
    assert split.shard_span([0, 3, 6], 0, 6) == (0, 0, 1, 3)
    with pytest.raises(ValueError):
        split.shard_span([0, 3, 6], 0, 7)


@pytest.mark.parametrize(
    "n,rule,n_train",
    [(8, "floor_valid", 7), (256, "floor_valid", 205), (512, "floor_valid", 410), (32, "floor_valid", 26),
     (8, "floor_train", 6), (256, "floor_train", 204), (512, "floor_train", 409)],
)
def test_split_sizes(spark, n, rule, n_train):
    df = split.with_batches(synth.row_range(spark, 2 * n), "row_id", n)
    got = split.tail_split(df, rule=rule).groupBy("batch_idx").agg(F.count_if(~F.col("is_valid")).alias("n")).collect()
    assert [r["n"] for r in got] == [n_train] * 2


def test_split_matches_single_batch_rule(spark):
    df = synth.row_range(spark, 100)
    got = split.tail_split(df, batch=None, position="row_id").where("is_valid").agg(F.min("row_id"), F.count("*")).first()
    assert tuple(got) == (80, 20)


def test_strided_workers_cover_all_batches(spark):
    df = split.assign_strided(split.with_batches(synth.row_range(spark, 50), "row_id", 10), 3)
    got = {r["worker"]: r["b"] for r in df.groupBy("worker").agg(F.sort_array(F.collect_set("batch_idx")).alias("b")).collect()}
    assert got == {0: [0, 3], 1: [1, 4], 2: [2]}


def test_iter_batches_can_be_repeated(spark):
    df = split.with_batches(synth.row_range(spark, 30), "row_id", 10)
    for _ in range(2):
        assert [(b, rows.count()) for b, rows in split.iter_batches(df)] == [(0, 10), (1, 10), (2, 10)]


def test_tiny_table_has_no_folds(spark):
    assert split.fold_range(synth.row_range(spark, 3), "row_id").where("fold IS NOT NULL").count() == 0


def test_stratified_folds_are_balanced(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y"))
    sizes = split.class_shares(split.assign_folds(df, 3, "id", "y", n_buckets=5), "y").collect()
    assert {(r["y"], r["n"]) for r in sizes} == {(1, 33), (1, 34), (0, 66), (0, 67)} or all(
        abs(r["n"] - r["class_rows"] / 3) <= 1 for r in sizes
    )


def test_predicate_split_reports_unknown(spark):
    df = spark.range(10).select(F.when(F.col("id") > 1, F.col("id")).alias("d"))
    assert [p.count() for p in split.predicate_split(df, F.col("d") < 5)] == [3, 5, 2]
