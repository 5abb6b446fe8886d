"""Queries over allocation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import memlog
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query

LOG = fx.ALLOC_LOG_SQL.format(pointer="event_id")
DIRTY = fx.ALLOC_LOG_SQL.format(pointer="user_id")
SIGNED = "CASE action WHEN 'allocate' THEN size WHEN 'free' THEN -size ELSE 0 END"
USAGE_SQL = f"""SELECT *, CAST(sum({SIGNED}) OVER (PARTITION BY device ORDER BY seq, pointer
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS usage FROM ({LOG})"""

PEAK_SQL = f"""
    SELECT device, greatest(max(usage), 0) AS peak, CAST(sum({SIGNED}) AS BIGINT) AS final_usage
    FROM ({USAGE_SQL}) GROUP BY 1
    """


@query("peak_memory", PEAK_SQL)
def _(t: Tables):
    return memlog.peak_memory(fx.alloc_log(t))


@query("peak_memory_bucketed", PEAK_SQL)
def _(t: Tables):
    """The same on the path that large logs take."""
    return memlog.peak_memory(fx.alloc_log(t), n_buckets=16)


USAGE_OUT = f"SELECT device, seq, pointer, action, size, usage FROM ({USAGE_SQL})"


@query("running_usage", USAGE_OUT)
def _(t: Tables):
    out = memlog.running_usage(fx.alloc_log(t), n_buckets=16)
    return out.select("device", "seq", "pointer", "action", "size", "usage")


FAILURES_SQL = f"SELECT device, seq, size AS attempted, usage FROM ({USAGE_SQL}) WHERE action = 'allocate failure'"


@query("alloc_failures", FAILURES_SQL)
def _(t: Tables):
    return memlog.alloc_failures(fx.alloc_log(t))


@query(
    "alloc_failure_totals",
    f"""
    SELECT device, count(*) AS n_failures, CAST(sum(attempted) AS BIGINT) AS attempted, max(usage) AS max_usage
    FROM ({FAILURES_SQL}) GROUP BY 1
    """,
)
def _(t: Tables):
    return memlog.alloc_failure_totals(memlog.alloc_failures(fx.alloc_log(t)))


def _lifecycle_sql(log: str) -> str:
    return f"""
    WITH n AS (SELECT *, lag(action) OVER w AS pa, lead(action) OVER w AS na, lead(seq) OVER w AS ns
      FROM ({log}) WHERE action <> 'allocate failure'
      WINDOW w AS (PARTITION BY device, pointer ORDER BY seq, event_id)),
    s AS (SELECT *, CASE WHEN action = 'allocate' AND pa = 'allocate' THEN 'double_allocate'
      WHEN action = 'allocate' AND na = 'free' THEN 'paired' WHEN action = 'allocate' AND na IS NULL THEN 'leak'
      WHEN action = 'allocate' THEN 'overwritten' WHEN pa = 'allocate' THEN 'free' ELSE 'unknown_free' END AS state
      FROM n)
    SELECT event_id, device, pointer, size, seq, action, state,
      CASE WHEN state = 'paired' THEN ns - seq END AS lifetime FROM s
    """


@query("alloc_lifecycle", _lifecycle_sql(DIRTY))
def _(t: Tables):
    return memlog.alloc_lifecycle(fx.alloc_log(t, reuse=True), ("seq", "event_id"))


@query("alloc_lifecycle_bucketed", _lifecycle_sql(DIRTY))
def _(t: Tables):
    return memlog.alloc_lifecycle(fx.alloc_log(t, reuse=True), ("seq", "event_id"), n_buckets=16)


@query("alloc_lifecycle_clean", _lifecycle_sql(LOG))
def _(t: Tables):
    return memlog.alloc_lifecycle(fx.alloc_log(t), ("seq", "event_id"))


@query(
    "alloc_lifecycle_totals",
    f"""
    SELECT device, state, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
    FROM ({_lifecycle_sql(DIRTY)}) GROUP BY 1, 2
    """,
)
def _(t: Tables):
    out = memlog.alloc_lifecycle(fx.alloc_log(t, reuse=True), ("seq", "event_id"))
    return out.groupBy("device", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
