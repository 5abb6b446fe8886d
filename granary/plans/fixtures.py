"""Tables derived from the given ones, each in DataFrame form and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arith import int_div
from granary.operators.split import with_batches
from granary.plans.registry import Tables

EVENT_BATCH = 500


def event_batches(t: Tables, rows: int = EVENT_BATCH) -> DataFrame:
    return with_batches(t.events, "event_id", rows)


EVENT_BATCHES_SQL = "SELECT *, event_id // 500 AS batch_idx, event_id % 500 AS row_in_batch FROM events"


def perf(t: Tables) -> DataFrame:
    """The fact side of the loan join."""
    return t.lineitem.withColumnRenamed("l_orderkey", "loan_id")


def acq(t: Tables) -> DataFrame:
    """The dimension side; every tenth loan has a key that no fact has, so that the left join leaves NULLs."""
    key = F.col("o_orderkey")
    return t.orders.select(F.when(F.pmod(key, F.lit(10)) == 0, -1 - key).otherwise(key).alias("loan_id"), *[c for c in t.orders.columns if c != "o_orderkey"])


PERF_SQL = "SELECT l_orderkey AS loan_id, * EXCLUDE (l_orderkey) FROM lineitem"
ACQ_SQL = """SELECT CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS loan_id, * EXCLUDE (o_orderkey)
  FROM orders"""


def _coordinate(base: float, factor: int):
    return F.lit(base) + F.pmod(F.col("o_orderkey") * F.lit(factor), F.lit(20000)) / F.lit(10000.0)


def trips(t: Tables) -> DataFrame:
    seconds = F.unix_seconds("o_orderdate") + F.pmod(F.col("o_orderkey"), F.lit(7200))
    return t.orders.select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_orderdate").alias("pickup_datetime"),
        F.timestamp_seconds(seconds).alias("dropoff_datetime"),
        _coordinate(40.0, 7919).alias("pickup_latitude"),
        _coordinate(-75.0, 104729).alias("pickup_longitude"),
        _coordinate(40.0, 15485863).alias("dropoff_latitude"),
        _coordinate(-75.0, 32452843).alias("dropoff_longitude"),
        F.col("o_totalprice").alias("fare_amount"),
    )


TRIPS_SQL = """SELECT o_orderkey AS trip_id, o_orderdate AS pickup_datetime,
  o_orderdate + to_seconds(o_orderkey % 7200) AS dropoff_datetime,
  40.0e0 + (o_orderkey * 7919 % 20000) / 10000.0e0 AS pickup_latitude,
  -75.0e0 + (o_orderkey * 104729 % 20000) / 10000.0e0 AS pickup_longitude,
  40.0e0 + (o_orderkey * 15485863 % 20000) / 10000.0e0 AS dropoff_latitude,
  -75.0e0 + (o_orderkey * 32452843 % 20000) / 10000.0e0 AS dropoff_longitude,
  o_totalprice AS fare_amount FROM orders"""


def alloc_log(t: Tables, reuse: bool = False) -> DataFrame:
    """An allocation log with frees, failures and leaks; ``reuse`` lets users share pointers."""
    e = F.col("event_id")
    size = F.round(F.col("value") * F.lit(100)).cast("bigint")
    base = t.events.select(
        e.alias("event_id"),
        F.pmod(e, F.lit(3)).cast("int").alias("device"),
        (F.col("user_id") if reuse else e).alias("pointer"),
        size.alias("size"),
        (F.col("event_type") == "error").alias("failed"),
    )
    first = F.struct(
        (F.lit(2) * e).alias("seq"),
        F.when(F.col("failed"), "allocate failure").otherwise("allocate").alias("action"),
    )
    freed_at = F.lit(2) * (e + F.lit(1) + F.pmod(e, F.lit(7))) + F.lit(1)
    last = F.struct(freed_at.alias("seq"), F.lit("free").alias("action"))
    freed = ~F.col("failed") & (F.pmod(e, F.lit(13)) != 0)
    steps = F.when(freed, F.array(first, last)).otherwise(F.array(first))
    return base.select("event_id", "device", "pointer", "size", F.inline(steps))


ALLOC_LOG_SQL = """SELECT event_id, CAST(event_id % 3 AS INTEGER) AS device, {pointer} AS pointer,
  CAST(round(value * 100) AS BIGINT) AS size, 2 * event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'allocate failure' ELSE 'allocate' END AS action FROM events
UNION ALL
SELECT event_id, CAST(event_id % 3 AS INTEGER), {pointer}, CAST(round(value * 100) AS BIGINT),
  2 * (event_id + 1 + event_id % 7) + 1, 'free' FROM events
  WHERE event_type <> 'error' AND event_id % 13 <> 0"""


def timers(t: Tables) -> DataFrame:
    return t.events.select(
        F.pmod("user_id", F.lit(4)).cast("int").alias("worker"),
        F.col("event_type").alias("name"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("proc"),
        F.col("value").alias("seconds"),
    )


TIMERS_SQL = """SELECT CAST(user_id % 4 AS INTEGER) AS worker, event_type AS name,
  CAST(event_id % 3 AS INTEGER) AS proc, value AS seconds FROM events"""


def cv_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("algo"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("fold"),
        F.col("value").alias("fit_time"),
        (-F.col("value")).alias("score"),
    )


CV_SQL = """SELECT event_type AS algo, CAST(event_id % 3 AS INTEGER) AS fold, value AS fit_time,
  -value AS score FROM events"""


def eval_log(t: Tables) -> DataFrame:
    """Scores by run; the event number serves as the round."""
    return t.events.select(
        F.col("user_id").alias("run"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "Train").otherwise("Valid").alias("dataset"),
        F.col("event_type").alias("metric"),
        F.col("event_id").alias("round"),
        F.col("value").alias("score"),
    )


EVAL_SQL = """SELECT user_id AS run, CASE WHEN event_id % 2 = 0 THEN 'Train' ELSE 'Valid' END AS dataset,
  event_type AS metric, event_id AS round, value AS score FROM events"""


def enriched(t: Tables) -> DataFrame:
    """Line items with the price of their order; missing for every tenth order."""
    dim = acq(t).select("loan_id", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return t.lineitem.join(dim, F.col("l_orderkey") == F.col("loan_id"), "left").drop("loan_id")


ENRICHED_SQL = """SELECT l.*, o.o_totalprice, o.o_orderpriority, o.o_orderstatus FROM lineitem l LEFT JOIN
  orders o ON l.l_orderkey = CASE WHEN o.o_orderkey % 10 = 0 THEN -1 - o.o_orderkey ELSE o.o_orderkey END"""


def batch_number(row_id: str, rows: int):
    return int_div(F.col(row_id), rows)
