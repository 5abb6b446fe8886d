"""Tables stored as batches cut into contiguous shards.

Layout: ``<path>/data/batch_idx=B/shard_idx=S/*.parquet`` plus a small ``<path>/manifest`` table. Rows
are dealt out by their place in the whole table, so an oversized batch is spread over several tasks and
files, every file covers a contiguous range of rows, and Parquet statistics on
``row_in_batch`` skip files and row groups inside a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.relate import union_all
from granary.functions.arith import int_div
from granary.operators.scan import running
from granary.operators.split import join_sizes, shard_manifest, shard_span, with_shards

KEY = ("batch_idx", "shard_idx", "row_in_batch")


def write_striped(df: DataFrame, path: str, n_shards: int) -> None:
    if df.where(F.col("batch_idx").isNull()).limit(1).count():
        raise ValueError("rows without batch_idx cannot be stored")
    shard_manifest(df, n_shards).coalesce(1).write.parquet(f"{path}/manifest")
    stored = manifest(df.sparkSession, path)
    sharded = with_shards(df, n_shards)
    # where each batch starts among all rows gives equal parts without sampling the rows
    starts = batch_starts(stored)
    total = stored.agg(F.coalesce(F.sum("shard_rows"), F.lit(0))).first()[0]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = max(1, -(-total // parts))
    placed = join_sizes(sharded, starts).withColumn("__part", int_div(F.col("start") + F.col("row_in_batch"), per).cast("int"))
    placed = placed.repartitionById(parts, F.pmod("__part", F.lit(parts)).cast("int")).drop("__part", "start")
    placed.sortWithinPartitions(*KEY).write.partitionBy("batch_idx", "shard_idx").parquet(f"{path}/data")
    # the schema is kept beside the data, so that a table without rows can be read as well
    df.sparkSession.createDataFrame([], sharded.schema).coalesce(1).write.parquet(f"{path}/schema")


def batch_starts(stored: DataFrame) -> DataFrame:
    """``batch_idx, start``: rows in all batches with smaller numbers, from a manifest."""
    sizes = stored.groupBy("batch_idx").agg(F.max("batch_rows").alias("n_rows"))
    ends = running(sizes, [], ["batch_idx"], {"end": ("sum", F.col("n_rows"))})
    return ends.select("batch_idx", (F.col("end") - F.col("n_rows")).alias("start"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch and shard, empty shards included."""
    return spark.read.parquet(f"{path}/manifest")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows per stored file, from the file metadata column."""
    df = _data(spark, path)
    return df.groupBy("batch_idx", "shard_idx", F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def _data(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with the column types they were written with."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/data")


def read_striped(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """All rows, or one batch by partition pruning. Rows carry their position; sort only if needed."""
    df = _data(spark, path)
    if batch is not None:
        df = df.where(F.col("batch_idx") == batch)
    return df


def read_range(spark: SparkSession, path: str, batch: int, begin: int, end: int) -> DataFrame:
    """Rows [begin, end) of a batch.

    The shards that can hold them come from the manifest (one row per directory), so other
    shards are pruned before any file is opened.
    """
    shards = manifest(spark, path).where(F.col("batch_idx") == batch).orderBy("shard_idx").collect()
    if not shards:
        raise ValueError(f"no batch {batch}")
    offsets = [r["shard_begin"] for r in shards] + [shards[-1]["batch_rows"]]
    first, _, last, _ = shard_span(offsets, begin, end)
    df = _data(spark, path).where(
        (F.col("batch_idx") == batch)
        & F.col("shard_idx").between(first, last)
        & (F.col("row_in_batch") >= begin)
        & (F.col("row_in_batch") < end)
    )
    return df


def range_of_each(spark: SparkSession, path: str, first: float, last: float) -> DataFrame:
    """The same relative range of every batch, e.g. a fold, in one scan: [int(first n), int(last n))."""
    from granary.functions.arith import int_fraction

    n = F.col("batch_rows")
    wanted = manifest(spark, path).select(
        "batch_idx", "shard_idx", "shard_begin", "shard_end",
        int_fraction(n, first).alias("__low"), int_fraction(n, last).alias("__high"),
    )
    # shards that overlap with the range; the join on the directories' columns prunes all others at run time
    wanted = wanted.where((F.col("shard_begin") < F.col("__high")) & (F.col("shard_end") > F.col("__low")))
    wanted = wanted.select("batch_idx", "shard_idx", "__low", "__high")
    rows = read_striped(spark, path).join(wanted, ["batch_idx", "shard_idx"])
    at = F.col("row_in_batch")
    return rows.where((at >= F.col("__low")) & (at < F.col("__high"))).drop("__low", "__high")


def load_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All batches of all paths as one table; batch numbers are expected to be disjoint."""
    return union_all([read_striped(spark, p) for p in paths])


def n_batches(spark: SparkSession, path: str) -> int:
    return manifest(spark, path).select("batch_idx").distinct().count()
