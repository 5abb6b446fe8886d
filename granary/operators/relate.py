"""Joins, unions and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left outer join on one key. AQE broadcasts a small side and splits skewed partitions."""
    return fact.join(dim, key, "left")


def pair_xy(x: DataFrame, y: DataFrame, keys: Sequence[str] = ("batch_idx", "row_in_batch")) -> DataFrame:
    """Join features and labels on their position."""
    return x.join(y, list(keys), "inner")


def count_orphans(x: DataFrame, y: DataFrame, keys: Sequence[str] = ("batch_idx", "row_in_batch")) -> DataFrame:
    """Per batch: rows of x, rows of y and positions that only one of them has.

    Positions are counted by a grouped sum over both tables, so rows of a batch spread over all tasks.
    """
    keys = list(keys)
    both = x.select(*keys, F.lit(1).alias("in_x"), F.lit(0).alias("in_y")).unionByName(
        y.select(*keys, F.lit(0).alias("in_x"), F.lit(1).alias("in_y"))
    )
    at = both.groupBy(*keys).agg(F.sum("in_x").alias("in_x"), F.sum("in_y").alias("in_y"))
    return at.groupBy(keys[0]).agg(
        F.sum("in_x").alias("n_x"),
        F.sum("in_y").alias("n_y"),
        F.count_if(F.col("in_x") != F.col("in_y")).alias("n_orphans"),
    )


LOCATE_BROADCAST_BATCHES = 1_000_000


def locate(points: DataFrame, manifest: DataFrame, at: str = "offset", batch: str = "batch_idx") -> DataFrame:
    """Find the shard of each offset and the offset inside it; every point is kept.

    The manifest is first folded to one row per batch with its shard starts as an array, so the lookup is an equi-join
    plus a search in a short array rather than a range join. Up to ``LOCATE_BROADCAST_BATCHES`` batches (counted) the
    folded manifest is broadcast and the points are not shuffled; beyond, both sides are joined by batch. A point of an
    unknown batch, a null offset or an offset outside all shards of its batch gets NULL shard_idx and in_shard.
    """
    starts = manifest.groupBy(batch).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("shard_begin").alias("begin"), F.col("shard_end").alias("end"), F.col("shard_idx"))
            )
        ).alias("shards")
    )
    if starts.count() <= LOCATE_BROADCAST_BATCHES:
        starts = F.broadcast(starts)
    joined = points.join(starts, batch, "left")
    hit = F.filter("shards", lambda s: (s["begin"] <= F.col(at)) & (F.col(at) < s["end"]))
    joined = joined.withColumn("hit", F.get(hit, F.lit(0)))
    return joined.select(
        *points.columns,
        F.col("hit.shard_idx").alias("shard_idx"),
        (F.col(at) - F.col("hit.begin")).alias("in_shard"),
    )


def diff_tables(a: DataFrame, b: DataFrame, key: str, rtol: float, atol: float = 0.0) -> DataFrame:
    """Per value column: rows compared, rows apart by more than the tolerance, keys on one side only."""
    values = [c for c in a.columns if c != key]
    left = a.select(key, F.struct(*values).alias("a"))
    right = b.select(key, F.struct(*values).alias("b"))
    both = left.join(right, key, "full")
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"a.{c}").alias("x"), F.col(f"b.{c}").alias("y"))
            for c in values
        ]
    )
    cells = both.select(F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"), F.inline(rows))
    paired = ~F.col("no_a") & ~F.col("no_b")
    apart = F.abs(F.col("x") - F.col("y")) > F.lit(atol) + F.lit(rtol) * F.abs(F.col("y"))
    one_null = F.col("x").isNull() != F.col("y").isNull()
    return cells.groupBy("column_name").agg(
        F.count_if(paired).alias("n_compared"),
        F.count_if(paired & (F.coalesce(apart, F.lit(False)) | one_null)).alias("n_apart"),
        F.count_if(~paired).alias("n_unmatched"),
        F.max(F.when(paired, F.abs(F.col("x") - F.col("y")))).alias("max_abs_diff"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Append rows of all frames, matching columns by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def bag_difference(a: DataFrame, b: DataFrame, left_sums: dict[str, Column] | None = None) -> DataFrame:
    """One row: how many rows each side has beyond the other, counting duplicates.

    Both sides are grouped together with a signed count, which needs one shuffle and combines
    repeated rows before it. ``left_sums`` adds, per name, the sum over all rows of ``a`` of an
    expression of its columns (0 for an empty ``a``), taken in the same aggregation.
    """
    columns = a.columns
    if not left_sums:
        signed = a.withColumn("__n", F.lit(1)).unionByName(b.select(*columns).withColumn("__n", F.lit(-1)))
        net = signed.groupBy(*columns).agg(F.sum("__n").alias("__n"))
        extra = []
    else:
        signed = a.withColumns({"__n": F.lit(1), "__a": F.lit(1)}).unionByName(
            b.select(*columns).withColumns({"__n": F.lit(-1), "__a": F.lit(0)})
        )
        net = signed.groupBy(*columns).agg(F.sum("__n").alias("__n"), F.sum("__a").alias("__a"))
        extra = [F.coalesce(F.sum(F.col("__a") * e), F.lit(0)).alias(name) for name, e in left_sums.items()]
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("__n"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("__n"), F.lit(0))), F.lit(0)).alias("only_right"),
        *extra,
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
