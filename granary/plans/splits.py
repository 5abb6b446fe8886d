"""Queries for splits, folds and batch assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import split
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6

B = f"({fx.EVENT_BATCHES_SQL})"


@query(
    "batch_offsets",
    f"""
    WITH s AS (SELECT batch_idx, count(*) AS n_rows FROM {B} GROUP BY 1)
    SELECT batch_idx, n_rows, CAST(sum(n_rows) OVER (ORDER BY batch_idx) - n_rows AS BIGINT) AS start FROM s
    """,
)
def _(t: Tables):
    return split.batch_offsets(fx.event_batches(t))


@query(
    "row_in_batch",
    """
    SELECT event_id, user_id AS batch_idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_in_batch
    FROM events
    """,
)
def _(t: Tables):
    e = t.events.select("event_id", F.col("user_id").alias("batch_idx"))
    return split.with_row_in_batch(e, "batch_idx", "event_id", n_buckets=8)


@query(
    "stripe_assign",
    f"""
    SELECT event_id, batch_idx, row_in_batch,
      row_in_batch // ((count(*) OVER (PARTITION BY batch_idx) + 2) // 3) AS shard_idx FROM {B}
    """,
)
def _(t: Tables):
    b = fx.event_batches(t).select("event_id", "batch_idx", "row_in_batch")
    return split.with_shards(b, 3)


@query(
    "shard_manifest",
    f"""
    WITH s AS (SELECT batch_idx, count(*) AS n FROM {B} GROUP BY 1),
    m AS (SELECT batch_idx, n, unnest(range(8)) AS shard_idx, (n + 7) // 8 AS per FROM s)
    SELECT batch_idx, shard_idx, n AS batch_rows, least((shard_idx + 1) * per, n) - least(shard_idx * per, n) AS shard_rows,
      least(shard_idx * per, n) AS shard_begin, least((shard_idx + 1) * per, n) AS shard_end FROM m
    ORDER BY batch_idx, shard_idx
    """,
)
def _(t: Tables):
    return split.ordered(split.shard_manifest(fx.event_batches(t), 8), "batch_idx", "shard_idx")


def _tail_sql(n_train: str) -> str:
    return f"""
    SELECT event_id, batch_idx, row_in_batch,
      row_in_batch >= {n_train.format(n='count(*) OVER (PARTITION BY batch_idx)')} AS is_valid
    FROM (SELECT event_id, event_id // 512 AS batch_idx, event_id % 512 AS row_in_batch FROM events)
    """


@query("split_tail_batch", _tail_sql("{n} - CAST(trunc({n} * 0.2e0) AS BIGINT)"))
def _(t: Tables):
    return split.tail_split(fx.event_batches(t, 512).select("event_id", "batch_idx", "row_in_batch"))


@query("split_tail_floor_train", _tail_sql("CAST(trunc({n} * 0.8e0) AS BIGINT)"))
def _(t: Tables):
    b = fx.event_batches(t, 512).select("event_id", "batch_idx", "row_in_batch")
    return split.tail_split(b, rule="floor_train")


@query(
    "split_tail_global",
    """
    SELECT o_orderkey, o_orderkey >= (SELECT count(*) - CAST(trunc(count(*) * 0.2e0) AS BIGINT) FROM orders) AS is_valid
    FROM orders
    """,
)
def _(t: Tables):
    return split.tail_split(t.orders.select("o_orderkey"), batch=None, position="o_orderkey")


@query(
    "split_by_day",
    """
    SELECT part, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM (
      SELECT *, CASE WHEN d IS NULL THEN 'unknown' WHEN d < 25 THEN 'train' ELSE 'test' END AS part FROM (
        SELECT o_totalprice, CASE WHEN o_orderkey % 19 <> 0 THEN day(o_orderdate) END AS d FROM orders)) GROUP BY 1
    """,
)
def _(t: Tables):
    day = F.when(F.pmod("o_orderkey", F.lit(19)) != 0, F.dayofmonth("o_orderdate"))
    df = t.orders.select("o_totalprice", day.alias("d"))
    parts = split.with_part(df, F.col("d") < 25)
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "kfold_contiguous",
    """
    WITH s AS (SELECT CAST(trunc(count(*) * 0.2e0) AS BIGINT) AS v FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey // v < 5 THEN o_orderkey // v END AS fold FROM orders, s
    """,
)
def _(t: Tables):
    return split.fold_range(t.orders.select("o_orderkey"), "o_orderkey")


STRATIFIED_SQL = """
    SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 3 AS INTEGER) AS fold
    FROM labels
    """


@query("kfold_stratified", STRATIFIED_SQL)
def _(t: Tables):
    return split.assign_folds(t.labels.select("doc_id", "quality"), 3, "doc_id", "quality")


@query("kfold_stratified_bucketed", STRATIFIED_SQL)
def _(t: Tables):
    return split.assign_folds(t.labels.select("doc_id", "quality"), 3, "doc_id", "quality", n_buckets=8)


@query(
    "kfold_plain",
    """
    SELECT l_row AS o_orderkey, CAST((row_number() OVER (ORDER BY l_row) - 1) % 3 AS INTEGER) AS fold
    FROM (SELECT o_orderkey AS l_row FROM orders)
    """,
)
def _(t: Tables):
    return split.assign_folds(t.orders.select("o_orderkey"), 3, "o_orderkey", n_buckets=8)


@query(
    "assign_strided",
    f"""
    SELECT worker, count(DISTINCT batch_idx) AS n_batches, count(*) AS n_rows, min(batch_idx) AS first_batch
    FROM (SELECT *, CAST(batch_idx % 3 AS INTEGER) AS worker FROM {B}) GROUP BY 1
    """,
)
def _(t: Tables):
    sizes = split.batch_sizes(fx.event_batches(t))
    return (
        split.assign_strided(sizes, 3)
        .groupBy("worker")
        .agg(
            F.count(F.lit(1)).alias("n_batches"),
            F.sum("n_rows").alias("n_rows"),
            F.min("batch_idx").alias("first_batch"),
        )
    )


@query("assign_round_robin", f"SELECT event_id, batch_idx, CAST(batch_idx % 4 AS INTEGER) AS dir FROM {B}")
def _(t: Tables):
    return split.assign_round_robin(fx.event_batches(t).select("event_id", "batch_idx"), 4)


@query(
    "batch_scan_stats",
    f"""
    SELECT batch_idx, count(*) AS n_rows, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high
    FROM {B} GROUP BY 1
    """,
)
def _(t: Tables):
    return split.batch_scan_stats(fx.event_batches(t), "value").withColumn("total", r6("total"))
