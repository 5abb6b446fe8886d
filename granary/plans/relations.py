"""Join, union and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import relate, split
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6


@query(
    "pair_xy",
    """
    SELECT event_id // 500 AS batch_idx, event_id % 500 AS row_in_batch, value, user_id AS label FROM events
    """,
)
def _(t: Tables):
    b = fx.event_batches(t)
    x = b.select("batch_idx", "row_in_batch", "value")
    y = b.select("batch_idx", "row_in_batch", F.col("user_id").alias("label"))
    return relate.pair_xy(x, y)


@query(
    "pair_orphans",
    """
    SELECT event_id // 500 AS batch_idx, count(*) AS n_x, count(*) FILTER (event_id % 17 <> 0) AS n_y,
      count(*) FILTER (event_id % 17 = 0) AS n_orphans FROM events GROUP BY 1
    """,
)
def _(t: Tables):
    b = fx.event_batches(t)
    return relate.count_orphans(b, b.where(F.pmod("event_id", F.lit(17)) != 0))


@query(
    "locate_rows",
    f"""
    WITH b AS ({fx.EVENT_BATCHES_SQL}), s AS (SELECT batch_idx, count(*) AS n FROM b GROUP BY 1)
    SELECT b.event_id, b.batch_idx, b.row_in_batch, b.row_in_batch // ((s.n + 2) // 3) AS shard_idx,
      b.row_in_batch % ((s.n + 2) // 3) AS in_shard FROM b JOIN s USING (batch_idx)
    """,
)
def _(t: Tables):
    b = fx.event_batches(t)
    points = b.select("event_id", "batch_idx", "row_in_batch")
    return relate.locate(points, split.shard_manifest(b, 3), at="row_in_batch")


@query(
    "diff_tables",
    """
    WITH a AS (SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id FROM events WHERE event_id % 97 <> 0),
    b AS (SELECT event_id, value * (CASE WHEN event_id % 10 = 0 THEN 1.01e0 ELSE 1.0e0 END) AS value,
      CAST(user_id AS DOUBLE) AS user_id FROM events WHERE event_id % 89 <> 0),
    j AS (SELECT a.event_id IS NULL OR b.event_id IS NULL AS lone, a.value AS av, b.value AS bv, a.user_id AS au,
      b.user_id AS bu FROM a FULL JOIN b ON a.event_id = b.event_id),
    c AS (SELECT lone, 'value' AS column_name, av AS x, bv AS y FROM j
      UNION ALL SELECT lone, 'user_id', au, bu FROM j)
    SELECT column_name, count(*) FILTER (NOT lone) AS n_compared,
      count(*) FILTER (NOT lone AND abs(x - y) > 1e-6 * abs(y)) AS n_apart,
      count(*) FILTER (lone) AS n_unmatched, round(max(abs(x - y)), 6) AS max_abs_diff FROM c GROUP BY 1
    """,
)
def _(t: Tables):
    e = t.events.select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    a = e.where(F.pmod("event_id", F.lit(97)) != 0)
    factor = F.when(F.pmod("event_id", F.lit(10)) == 0, 1.01).otherwise(1.0)
    b = e.where(F.pmod("event_id", F.lit(89)) != 0).withColumn("value", F.col("value") * factor)
    return relate.diff_tables(a, b, "event_id", 1e-6).withColumn("max_abs_diff", r6("max_abs_diff"))


@query(
    "ordered_load",
    """
    SELECT event_id // 500 AS batch_idx, event_id % 500 AS row_in_batch, event_id, value FROM events
    ORDER BY batch_idx, row_in_batch
    """,
)
def _(t: Tables):
    b = fx.event_batches(t).select("batch_idx", "row_in_batch", "event_id", "value")
    return split.ordered(b, "batch_idx", "row_in_batch")


@query("union_batches", "SELECT * EXCLUDE (o_orderdate) FROM orders")
def _(t: Tables):
    o = t.orders.drop("o_orderdate")
    odd = o.where(F.pmod("o_orderkey", F.lit(2)) == 1)
    even = o.where(F.pmod("o_orderkey", F.lit(2)) == 0)
    return relate.union_all([even, odd.select(*reversed(odd.columns))])


@query(
    "bag_equal",
    """
    WITH a AS (SELECT o_custkey, o_orderstatus FROM orders),
    b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 50 <> 0),
    x AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
    y AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    SELECT CAST(x.n AS BIGINT) AS only_left, CAST(y.n AS BIGINT) AS only_right, x.n = 0 AND y.n = 0 AS equal FROM x, y
    """,
)
def _(t: Tables):
    columns = ["o_custkey", "o_orderstatus"]
    return relate.bag_difference(
        t.orders.select(*columns), t.orders.where(F.pmod("o_orderkey", F.lit(50)) != 0).select(*columns)
    )
