"""Generated data: shape, density, determinism and invariance under batching."""

import pytest
from pyspark.sql import functions as F

from granary.functions import mix
from granary.operators import split
from granary.operators.clean import check_matrix
from granary.operators.relate import bag_difference
from granary.sources import striped, synth


def equal(a, b):
    return bag_difference(a, b).first()["equal"]


def test_sparse_density(spark):
    n = synth.sparse_cells(synth.row_range(spark, 1023), 32, 0.6).count()
    assert abs(n - 1023 * 32 * 0.4) < 400


def test_dense_density_and_whole_labels(spark):
    df = synth.linear_labels(synth.dense_rows(synth.row_range(spark, 2047), 16, seed=1, sparsity=0.6))
    one = df.agg(
        F.sum(F.size(F.filter("features", lambda v: v.isNotNull()))).alias("n"),
        F.count_if(F.get("labels", F.lit(0)).isNull()).alias("gone"),
    ).first()
    assert 12700 < one["n"] < 13500 and one["gone"] == 0


def test_values_look_normal_and_independent(spark):
    cells = synth.dense_cells(synth.row_range(spark, 10000), 16)
    one = cells.agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.kurtosis("value").alias("k")).first()
    assert abs(one["m"]) < 0.02 and abs(one["s"] - 1.5) < 0.02 and abs(one["k"]) < 0.1
    sums = cells.groupBy("row_id").agg(F.sum("value").alias("t"))
    assert abs(sums.agg(F.stddev("t")).first()[0] - 6.0) < 0.2
    pairs = cells.groupBy("row_id").pivot("col_idx", [0, 1]).agg(F.first("value"))
    assert abs(pairs.agg(F.corr("0", "1")).first()[0]) < 0.04


def test_no_repeat_beyond_the_modulus(spark):
    a = synth.dense_rows(synth.row_range(spark, 100), 8)
    b = synth.dense_rows(synth.row_range(spark, 100), 8, seed=mix.MODULUS)
    assert not equal(a, b)


def test_missing_mask_is_independent_of_the_value(spark):
    rows = synth.row_range(spark, 20000)
    full = synth.dense_cells(rows, 4)

    def kept_mean(mask):
        kept = synth.dense_cells(rows, 4, sparsity=0.5, mask=mask).where("value IS NOT NULL")
        return full.join(kept.select("row_id", "col_idx"), ["row_id", "col_idx"]).agg(F.avg(F.abs("value"))).first()[0]

    whole = full.agg(F.avg(F.abs("value"))).first()[0]
    assert abs(kept_mean("independent") - whole) < 0.02
    # the coupled mask drops small uniforms, i.e. large absolute values
    assert whole - kept_mean("coupled") > 0.2


@pytest.mark.parametrize("n_targets", [1, 3])
def test_batching_invariance(spark, n_targets):
    rows = synth.row_range(spark, 192)
    a = synth.batches(rows, 16, 3, n_targets).select("row_id", "features", "labels")
    b = synth.batches(rows, 192, 3, n_targets).select("row_id", "features", "labels")
    assert equal(a, b)


def test_partition_count_does_not_matter(spark):
    a = synth.batches(synth.row_range(spark, 200), 50, 4, sparsity=0.2)
    b = synth.batches(synth.row_range(spark, 200).repartition(13), 50, 4, sparsity=0.2)
    assert equal(a, b)


def test_stored_equals_generated(spark, tmp_path):
    args = dict(n_rows_per_batch=8, n_cols=4, n_targets=2, sparsity=0.3)
    synth.datagen(synth.row_range(spark, 96), str(tmp_path / "d"), n_shards=2, **args)
    stored, fly = synth.source(spark, str(tmp_path / "d")), synth.source(spark, None, n_rows=96, **args)
    assert equal(stored.select(*fly.columns), fly)


def test_coefficients_depend_on_the_target_only(spark):
    assert synth.mix.target_coefficients(3)[:1] == synth.mix.target_coefficients(1)


def test_validation_cells_are_disjoint(spark):
    """Validation rows follow the training rows, so no cell is shared."""
    train = synth.dense_cells(synth.row_range(spark, 80), 4)
    valid = synth.dense_cells(synth.row_range(spark, 20, first=80), 4)
    assert train.join(valid, "value").count() == 0


def test_only_float_can_be_stored(spark):
    df = synth.batches(synth.row_range(spark, 4), 2, 2)
    check_matrix(synth.as_stored(df), ["features", "labels"])
    with pytest.raises(TypeError):
        check_matrix(df, ["features"])


@pytest.mark.parametrize("n_rows,n_shards", [(100, 1), (100, 3), (5, 8)])
def test_striped_round_trip(spark, tmp_path, n_rows, n_shards):
    df = split.with_batches(synth.row_range(spark, 4 * n_rows), "row_id", n_rows)
    path = str(tmp_path / "s")
    striped.write_striped(df, path, n_shards)
    assert equal(striped.read_striped(spark, path).select(*df.columns), df)
    assert striped.n_batches(spark, path) == 4
    assert striped.manifest(spark, path).count() == 4 * n_shards
    one = striped.read_striped(spark, path, batch=2)
    assert one.count() == n_rows and one.select("batch_idx").distinct().count() == 1


@pytest.mark.parametrize("n_shards", [1, 3])
def test_range_read(spark, tmp_path, n_shards):
    path = str(tmp_path / "s")
    striped.write_striped(split.with_batches(synth.row_range(spark, 200), "row_id", 100), path, n_shards)
    got = striped.read_range(spark, path, 1, 25, 50)
    assert sorted(r["row_id"] for r in got.collect()) == list(range(125, 150))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "shard_idx" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "row_in_batch" in plan.split("PushedFilters")[1]


def test_empty_table_can_be_read(spark, tmp_path):
    df = split.with_batches(synth.row_range(spark, 10), "row_id", 5)
    striped.write_striped(df.where("row_id < 0"), str(tmp_path / "e"), 2)
    striped.write_striped(df, str(tmp_path / "f"), 2)
    assert striped.load_all(spark, [str(tmp_path / "e"), str(tmp_path / "f")]).count() == 10


def test_file_manifest_counts_all_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    striped.write_striped(split.with_batches(synth.row_range(spark, 90), "row_id", 30), path, 2)
    assert striped.file_manifest(spark, path).agg(F.sum("n_rows")).first()[0] == 90
