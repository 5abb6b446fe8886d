"""Result documents: options, timers, evaluations and machine of a run, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The layout of a result document.
OPTS = (
    "n_samples_per_batch BIGINT, n_features BIGINT, n_targets BIGINT, n_batches BIGINT, sparsity DOUBLE, "
    "on_the_fly BOOLEAN, validation BOOLEAN, device STRING, mr STRING, target_type STRING, "
    "cache_host_ratio DOUBLE, min_cache_page_bytes BIGINT, tree_method STRING, max_depth BIGINT, "
    "grow_policy STRING, subsample DOUBLE, num_parallel_tree BIGINT, colsample_bynode DOUBLE, "
    "colsample_bytree DOUBLE, max_bin BIGINT, gamma DOUBLE, alpha DOUBLE, eta DOUBLE, min_child_weight DOUBLE, "
    "`lambda` DOUBLE, seed BIGINT, verbosity BIGINT, objective STRING, multi_strategy STRING, "
    "n_rounds BIGINT, n_workers BIGINT"
)
SCHEMA = (
    f"run STRING, opts STRUCT<{OPTS.replace(' ', ':').replace(',:', ', ')}>, "
    "timer MAP<STRING, MAP<STRING, DOUBLE>>, "
    "evals MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>, "
    "machine STRUCT<system: STRING, arch: STRING, cpus: BIGINT, gpus: ARRAY<STRING>, drivers: ARRAY<STRING>, c2c: BIGINT>, "
    "version MAP<STRING, STRING>"
)


def save_results(df: DataFrame, path: str) -> None:
    """Append documents. Runs are told apart by their ``run`` column, not by numbered file names."""
    df.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Documents with a declared schema, so no pass over the text is spent on inference."""
    return spark.read.schema(schema).json(path)
