"""Edge cases of training, splits, striped tables and documents that small tables don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import plans
from granary.operators import boost, quantile, runlog, split, train
from granary.operators.train import train_gbt
from granary.plans import boosting
from granary.session import discard, materialize
from granary.sources import striped

FEW = {"max_depth": 2, "max_bin": 16}


def rows(spark, labels):
    return spark.createDataFrame([(float(i % 37), float(i % 11), y) for i, y in enumerate(labels)], "f1 double, f2 double, y double")


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_labels_are_checked(spark, bad):
    with pytest.raises(ValueError, match="1 training rows"):
        train_gbt(rows(spark, [1.0, 2.0, bad, 4.0] * 1 + [3.0] * 40), ["f1", "f2"], "y", FEW, 1)


def test_an_outlier_costs_no_resolution(spark):
    labels = [float(i % 37) for i in range(3000)]
    data = rows(spark, labels)
    usual = train_gbt(data, ["f1", "f2"], "y", {**FEW, "base_score": 0.0, "reg_lambda": 0.0, "eta": 1.0}, 1, exact_cuts=True)
    wild = rows(spark, [1e15, *labels[1:]]).withColumn("f2", F.when(F.col("y") > 1e14, 1e6).otherwise(F.col("f2")))
    model = train_gbt(wild, ["f1", "f2"], "y", {**FEW, "base_score": 0.0, "reg_lambda": 0.0, "eta": 1.0}, 1, exact_cuts=True)
    leaves = [w[0] for t in model.trees for w, f in zip(t.weight, t.feature, strict=True) if f < 0]
    assert any(0 < abs(w) < 100 for w in leaves) and len(usual.trees) == 1


def test_ragged_and_missing_arrays_are_refused(spark):
    data = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0, 2.0, 3.0], 2.0)], "x array<double>, y double")
    with pytest.raises(ValueError, match="2 to 3 values"):
        train_gbt(data, "x", "y", FEW, 1)
    with pytest.raises(ValueError, match="1 rows without x"):
        train_gbt(data.unionByName(spark.createDataFrame([(None, 1.0)], data.schema)), "x", "y", FEW, 1)


@pytest.mark.parametrize("policy", ["depthwise", "lossguide"])
def test_limits_of_leaves(spark, policy):
    data = rows(spark, [float((i * 7919) % 101) for i in range(1500)])
    count = lambda **p: sum(f < 0 for f in train_gbt(data, ["f1", "f2"], "y", {**FEW, "grow_policy": policy, **p}, 1, exact_cuts=True).trees[0].feature)
    assert count(max_leaves=3) == 3
    assert count(max_depth=0, max_leaves=6) == 6
    assert count(max_depth=0, max_leaves=0, gamma=0.0) > 4


def test_rows_without_a_batch_are_a_batch(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (None, 0), (None, 1), (None, 2)], "batch_idx long, row_in_batch long")
    out = split.tail_split(df, 0.4).collect()
    assert len(out) == 5 and sum(r.is_valid for r in out if r.batch_idx is None) == 1
    assert split.with_shards(df, 2).count() == 5
    with pytest.raises(ValueError, match="without batch_idx"):
        striped.write_striped(df, "unused", 2)


def test_sizes_reach_the_rows_without_an_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("batch_idx"), F.col("id").alias("row_in_batch"))
    plan = split.with_shards(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_ranges_prune_directories(spark, tmp_path):
    df = split.with_batches(spark.range(4000).withColumnRenamed("id", "row_id"), "row_id", 1000)
    striped.write_striped(df, str(tmp_path / "t"), 10)
    found = striped.range_of_each(spark, str(tmp_path / "t"), 0.25, 0.35)
    assert sorted(r.row_in_batch for r in found.where("batch_idx = 2").collect()) == list(range(250, 350))
    assert found.count() == 400
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_documents_of_any_depth(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}'), (2, '{"a":{"b":{"c":{"d":{"e":{"g":"}{"}}}}}}')], "run int, doc string")
    assert {r.path for r in runlog.doc_key_diff(docs).collect()} == {"/a/b/c/d/e/f", "/a/b/c/d/e/g"}


def _brute_paths(doc, prefix=""):
    out = set()
    for key, value in doc.items():
        out |= _brute_paths(value, f"{prefix}/{key}") if isinstance(value, dict) else {f"{prefix}/{key}"}
    return out


def test_key_diff_with_braces_inside_strings(spark):
    """Closing braces inside strings, escaped quotes and a nesting of 12 levels: equal to a walk of the parsed documents."""
    import json

    deep = {"x": 1}
    for level in range(11):
        deep = {f"k{level}": deep, "s": "}}}{" if level % 2 else '\\"}'}
    docs = [
        (1, '{"a":"}}}","b":{"c":{"d":1}}}'),
        (2, '{"e":"}}}","b":{"c":{"d":1}}}'),
        (3, json.dumps(deep)),
        (4, json.dumps({"q": 'say \\"}}\\" twice', "b": {"c": {"d": {"z": []}}}})),
    ]
    got = {(r.path, r.n_runs) for r in runlog.doc_key_diff(spark.createDataFrame(docs, "run int, doc string")).collect()}
    paths = {run: _brute_paths(json.loads(doc)) for run, doc in docs}
    every = set.intersection(*paths.values())
    want = {(p, sum(p in found for found in paths.values())) for found in paths.values() for p in found if p not in every}
    assert got == want
    assert ("/k10/k9/k8/k7/k6/k5/k4/k3/k2/k1/k0/x", 1) in got


def test_bin_arrays_refuse_uneven_rows(spark):
    """Rows of 3, 2 and 4 values against 3 tables of cuts are refused; null arrays and values get the missing bin."""
    from granary.operators import quantile

    cuts = [[1.0], [2.0, 3.0], []]
    uneven = spark.createDataFrame([([0.0, 1.0, 2.0],), ([5.0, 6.0],), ([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    with pytest.raises(Exception, match="holds [24] values for 3 tables"):
        uneven.select(quantile.bin_arrays(F.col("v"), cuts).alias("b")).collect()
    even = spark.createDataFrame([([0.0, 2.5, 9.0],), (None,), ([None, 3.0, float("nan")],), ([1.0, 1.0, 1.0],)], "v array<double>")
    got = [r.b for r in even.select(quantile.bin_arrays(F.col("v"), cuts).alias("b")).collect()]
    m = quantile.MISSING
    assert got == [[0, 1, 0], [m, m, m], [m, 2, m], [1, 0, 0]]


def test_locate_keeps_points_outside_shards(spark):
    """Offsets outside every shard, unknown batches and null offsets stay, with NULL shard and offset."""
    from granary.operators import relate

    manifest = spark.createDataFrame([(0, 0, 0, 10), (0, 1, 10, 25), (1, 0, 0, 5)], "batch_idx int, shard_idx int, shard_begin long, shard_end long")
    points = spark.createDataFrame([(0, 3), (0, 10), (0, 24), (0, 25), (1, 4), (1, 7), (2, 0), (0, None)], "batch_idx int, offset long")
    got = sorted((tuple(r) for r in relate.locate(points, manifest).collect()), key=repr)
    want = [(0, 3, 0, 3), (0, 10, 1, 0), (0, 24, 1, 14), (0, 25, None, None), (1, 4, 0, 4), (1, 7, None, None), (2, 0, None, None), (0, None, None, None)]
    assert got == sorted(want, key=repr)


def test_written_tables_can_go(spark, tmp_path):
    stored = materialize(spark.range(5), "gone")
    discard(stored)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(stored.scratch)
    with pytest.raises(ValueError):
        discard(spark.range(1))


def test_trips_by_header(spark, tmp_path):
    """Two years with other names in another order; each has one valid trip."""
    from granary.sources import datasets

    (tmp_path / "a.csv").write_text(
        "pickup_datetime,dropoff_datetime,passenger_count,trip_distance,pickup_longitude,pickup_latitude,rate_code,dropoff_longitude,dropoff_latitude,fare_amount\n"
        "2014-01-02 10:00:00,2014-01-02 10:20:00,1,2.5,-73.9,40.7,1,-73.95,40.75,12.5\n"
    )
    (tmp_path / "b.csv").write_text(
        "fare_amount,tpep_pickup_datetime,tpep_dropoff_datetime,RateCodeID,passenger_count,pickup_latitude,pickup_longitude,dropoff_latitude,dropoff_longitude,trip_distance\n"
        "20.0,2015-01-26 10:00:00,2015-01-26 10:20:00,1,2,40.7,-73.9,40.75,-73.95,3.5\n"
    )
    df, _ = datasets.dataset(spark, "taxi", str(tmp_path))
    assert sorted((r["fare_amount"], r["part"]) for r in df.select("fare_amount", "part").collect()) == [(12.5, "train"), (20.0, "test")]


def test_cuts_read_their_rows_once(spark):
    """The steps of exact cuts work on written counts, not on the rows again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(500).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    cuts = quantile.collect_cuts(quantile.exact_cuts(df.mapInArrow(counted, df.schema), ["x", "y"], 4, n_buckets=3), ["x", "y"])
    assert cuts == {"x": [124.0, 249.0, 374.0], "y": [1.0, 3.0, 5.0]} and read.value == 500


def test_binned_rows_are_blocks(spark):
    """A few rows of arrays go to Python in each pass, not one row per row."""
    data = rows(spark, [float(i % 101) for i in range(9000)]).coalesce(2)
    blocks, cuts, _ = train.bin_table(data, ["f1", "f2"], None, ["y"], train.Params.of(FEW), None, None, [], True)
    found = blocks.collect()
    assert sum(r.n for r in found) == 9000 and len(found) < 10 and max(r.n for r in found) <= train.BLOCK_ROWS
    job = {"n_features": 2, "n_labels": 1}
    got = sorted((int(b[0]), int(b[1]), y[0]) for r in found for b, y in zip(train._arrays(r.asDict(), job)["bins"], train._arrays(r.asDict(), job)["labels"], strict=True))
    place = lambda v, f: sum(c <= v for c in cuts[f])
    assert got == sorted((place(i % 37, "f1"), place(i % 11, "f2"), float(i % 101)) for i in range(9000))


def test_row_samples_are_those_of_spark(spark):
    ids = [0, 1, -1, 2**31 - 1, 2**40, -(2**62), 2**63 - 1, -(2**63), *(i * 7919 - 5000 for i in range(300))]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = [r[0] for r in df.coalesce(1).select(boost.subsample_keep(F.col("id"), 3, 1, 0.5, 7)).collect()]
    assert boost.subsample_kept(np.array(ids), 3, 1, 0.5, 7).tolist() == want


@pytest.mark.parametrize("name", ["train_partition_invariance", "train_gbt_multi", "model_roundtrip", "predict_gbt"])
def test_training_queries_join_once(spark, sf_dir, monkeypatch, name):
    """What is trained on is a written table: reading it again does not make its join again."""

    class Seen(Exception):
        pass

    def stop(df, *args, **kwargs):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(boosting, "train_gbt", stop)
    with pytest.raises(Seen) as found:
        plans.load()
        plans.QUERIES[name](spark, sf_dir)
    assert "Join" not in str(found.value) and "Scan parquet" in str(found.value)
