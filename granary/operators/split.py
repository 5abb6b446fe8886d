"""Splits, folds and the assignment of rows to batches, shards and workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.arith import ceil_div, int_div, int_fraction
from granary.operators.scan import rank_within, running
from granary.session import materialize

TEST_SIZE = 0.2
# rows of 16 bytes
BROADCAST_BATCHES = 1_000_000


def with_batches(df: DataFrame, row_id: str, rows_per_batch: int) -> DataFrame:
    """Batch number and position in the batch, by arithmetic on a dense row id: no shuffle."""
    return df.withColumns(
        {
            "batch_idx": int_div(F.col(row_id), rows_per_batch),
            "row_in_batch": F.pmod(F.col(row_id), F.lit(rows_per_batch)).cast("bigint"),
        }
    )


def with_row_in_batch(df: DataFrame, batch: str, order: str, n_buckets: int | None = None) -> DataFrame:
    """Position in the batch for tables without a dense row id."""
    ranked = rank_within(df, [batch], [order], "row_in_batch", n_buckets)
    return ranked.withColumn("row_in_batch", F.col("row_in_batch") - F.lit(1))


def batch_sizes(df: DataFrame, batch: str = "batch_idx") -> DataFrame:
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"))


def join_sizes(df: DataFrame, sizes: DataFrame, batch: str = "batch_idx") -> DataFrame:
    """Add the columns of ``sizes``, one row per batch, to the rows of each batch; rows without a batch number are a batch too.

    The sizes are written first, from one column of ``df``. Up to ``BROADCAST_BATCHES`` of them go to the rows, so the rows
    are not dealt out by batch; more of them are joined by shuffle.
    """
    small = materialize(sizes.withColumnRenamed(batch, "__batch"), "sizes")
    if small.count() <= BROADCAST_BATCHES:
        small = F.broadcast(small)
    return df.join(small, df[batch].eqNullSafe(small["__batch"])).drop("__batch")


def batch_offsets(df: DataFrame, batch: str = "batch_idx") -> DataFrame:
    """Start of each batch in the whole table: a running sum over one row per batch."""
    sizes = batch_sizes(df, batch)
    ends = running(sizes, [], [batch], {"end": ("sum", F.col("n_rows"))})
    return ends.select(batch, "n_rows", (F.col("end") - F.col("n_rows")).alias("start"))


def n_train_of(n: Column, test_size: float = TEST_SIZE, rule: str = "floor_valid") -> Column:
    """Training rows among ``n``: the validation part or the training part is rounded down."""
    if rule == "floor_valid":
        return n - int_fraction(n, test_size)
    if rule == "floor_train":
        return int_fraction(n, 1.0 - test_size)
    raise ValueError(f"unknown rule: {rule}")


def tail_split(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    rule: str = "floor_valid",
    batch: str | None = "batch_idx",
    position: str = "row_in_batch",
) -> DataFrame:
    """Mark the last part of each batch, or of the whole table, as validation (``is_valid``).

    Only counts are shuffled; rows without a batch number form a batch. A whole-table split compares against a scalar subquery.
    """
    if batch is None:
        n = df.agg(F.count(F.lit(1))).scalar()
        return df.withColumn("is_valid", F.col(position) >= n_train_of(n, test_size, rule))
    sizes = batch_sizes(df, batch)
    joined = join_sizes(df, sizes, batch)
    return joined.withColumn("is_valid", F.col(position) >= n_train_of(F.col("n_rows"), test_size, rule)).drop(
        "n_rows"
    )


def predicate_split(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows where it holds, rows where it fails, rows where it is unknown)."""
    return df.filter(cond), df.filter(~cond), df.filter(cond.isNull())


def with_part(df: DataFrame, cond: Column) -> DataFrame:
    """The same split as one column, for a single pass over both parts."""
    return df.withColumn("part", F.when(cond, "train").when(~cond, "test").otherwise("unknown"))


def fold_range(df: DataFrame, position: str, test_size: float = TEST_SIZE) -> DataFrame:
    """Contiguous folds of ``int(n * test_size)`` rows; rows past the last full fold get no number.

    A table too small for one row per fold gets no fold number at all.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    size = int_fraction(n, test_size)
    count = F.lit(int(1.0 / test_size + 1e-9))
    fold = F.when(size > 0, int_div(F.col(position), F.greatest(size, F.lit(1).cast("bigint"))))
    return df.withColumn("fold", F.when(fold < count, fold))


def fold_bounds(n: int, fold: int, test_size: float = TEST_SIZE) -> tuple[int, int]:
    """[begin, end) of a contiguous fold."""
    size = int(n * test_size)
    return size * fold, size * (fold + 1)


def assign_folds(
    df: DataFrame, k: int, order: str, y: str | None = None, n_buckets: int | None = None
) -> DataFrame:
    """Deal rows to ``k`` folds in turn, within each class if ``y`` is given.

    Without classes and with a dense id the position is the id itself; with classes the
    rank inside a class comes from a bucketed scan, so a dominant class is not one task.
    """
    ranked = rank_within(df, [y] if y else [], [order], "__at", n_buckets)
    return ranked.withColumn("fold", F.pmod(F.col("__at") - F.lit(1), F.lit(k)).cast("int")).drop("__at")


def assign_strided(df: DataFrame, n_workers: int, batch: str = "batch_idx") -> DataFrame:
    """Worker r takes batches r, r + W, r + 2W, ..."""
    return df.withColumn("worker", F.pmod(F.col(batch), F.lit(n_workers)).cast("int"))


def assign_round_robin(df: DataFrame, n_dirs: int, batch: str = "batch_idx") -> DataFrame:
    """Batch i goes to directory i mod the number of directories."""
    return df.withColumn("dir", F.pmod(F.col(batch), F.lit(n_dirs)).cast("int"))


def with_shards(df: DataFrame, n_shards: int, batch: str = "batch_idx", position: str = "row_in_batch") -> DataFrame:
    """Contiguous shards of ``ceil(n / n_shards)`` rows in each batch; the last ones may be empty."""
    sizes = batch_sizes(df, batch)
    joined = join_sizes(df, sizes, batch)
    return joined.withColumn(
        "shard_idx", int_div(F.col(position), ceil_div(F.col("n_rows"), n_shards))
    ).drop("n_rows")


def shard_manifest(df: DataFrame, n_shards: int, batch: str = "batch_idx") -> DataFrame:
    """Per batch and shard, empty shards included: rows in the batch and the shard's [begin, end)."""
    sizes = batch_sizes(df, batch)
    shard = sizes.select(
        batch, "n_rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))).alias("shard_idx")
    )
    per = ceil_div(F.col("n_rows"), n_shards)
    begin = F.least(F.col("shard_idx") * per, F.col("n_rows"))
    end = F.least((F.col("shard_idx") + F.lit(1)) * per, F.col("n_rows"))
    return shard.select(
        batch,
        "shard_idx",
        F.col("n_rows").alias("batch_rows"),
        (end - begin).alias("shard_rows"),
        begin.alias("shard_begin"),
        end.alias("shard_end"),
    )


def shard_span(offsets: list[int], begin: int, end: int) -> tuple[int, int, int, int]:
    """(first shard, offset in it, last shard, offset in it) of rows [begin, end).

    ``offsets`` holds the start of every shard and the row count at the end.
    """
    n = offsets[-1]
    if end > n:
        raise ValueError(f"range ends at {end}, the batch has {n} rows")
    starts = offsets[:-1]

    def shard_of(row):
        return max(i for i, s in enumerate(starts) if s <= row)

    last = len(starts) - 1 if end == n else shard_of(end)
    first = shard_of(begin)
    return first, begin - offsets[first], last, end - offsets[last]


def batch_scan_stats(df: DataFrame, value: str, batch: str = "batch_idx") -> DataFrame:
    """Per batch: rows, sum and extremes of a column, in one pass over all batches."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(value).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def iter_batches(df: DataFrame, batch: str = "batch_idx"):
    """Yield (batch number, rows of that batch), in order; each is a pruned scan of a stored table.

    Only the batch numbers come to the driver.
    """
    for row in df.select(batch).distinct().orderBy(batch).toLocalIterator():
        yield row[0], df.where(F.col(batch) == row[0])


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """Globally ordered rows (a range-partitioned sort)."""
    return df.orderBy(*order)


def class_shares(df: DataFrame, y: str) -> DataFrame:
    """Rows and folds per class, to check a stratified assignment."""
    w = Window.partitionBy(y)
    counts = df.groupBy(y, "fold").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("class_rows", F.sum("n").over(w))
