"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import metrics
from granary.plans.registry import Tables, query, r6

# predictions derived from the events: the next thousandth of the user number
PRED = "(value + (user_id % 100) / 10.0e0)"


def scored(t: Tables):
    return t.events.withColumn("pred", F.col("value") + F.pmod("user_id", F.lit(100)) / F.lit(10.0))


@query("metric_rmse", f"SELECT round(sqrt(avg(pow(value - {PRED}, 2))), 6) AS rmse FROM events")
def _(t: Tables):
    return metrics.rmse(scored(t), "value", "pred").withColumn("rmse", r6("rmse"))


@query(
    "metric_rmse_by_round",
    f"""
    SELECT event_id // 1000 AS round, round(avg(pow(value - {PRED}, 2)), 6) AS l2,
      round(sqrt(avg(pow(value - {PRED}, 2))), 6) AS rmse FROM events GROUP BY 1
    """,
)
def _(t: Tables):
    from granary.plans.fixtures import batch_number

    out = metrics.rmse_by_round(scored(t).withColumn("round", batch_number("event_id", 1000)), "value", "pred")
    return out.withColumns({"l2": r6("l2"), "rmse": r6("rmse")})


@query("metric_mape", f"SELECT round(avg(abs(value - {PRED}) / greatest(abs(value), 2.220446049250313e-16)), 6) AS mape FROM events")
def _(t: Tables):
    return metrics.mape(scored(t), "value", "pred").withColumn("mape", r6("mape"))


@query(
    "metric_logloss",
    """
    SELECT round(avg(-CASE WHEN event_id % 2 = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS logloss FROM (
      SELECT event_id, least(greatest(value / 500, 1e-16), 1 - 1e-16) AS p FROM events)
    """,
)
def _(t: Tables):
    df = t.events.select(F.pmod("event_id", F.lit(2)).alias("y"), (F.col("value") / F.lit(500)).alias("p"))
    return metrics.logloss(df, "y", "p").withColumn("logloss", r6("logloss"))


def auc_sql(source: str, keys: str = "") -> str:
    """Mann-Whitney form: ranks with ties averaged."""
    over = f"PARTITION BY {keys} " if keys else ""
    cols = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
    WITH r AS (SELECT {cols}y, rank() OVER ({over}ORDER BY s) + (count(*) OVER (PARTITION BY {cols}s) - 1) / 2.0e0 AS rk
      FROM ({source}))
    SELECT {cols}count(*) FILTER (y > 0) AS n_positive, count(*) FILTER (y <= 0) AS n_negative,
      round((sum(rk) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0e0)
        / (count(*) FILTER (y > 0) * count(*) FILTER (y <= 0)), 6) AS auc FROM r {group}
    """


DOC_SQL = auc_sql("SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)")
EVENT_SQL = auc_sql("SELECT event_id % 2 AS y, value AS s FROM events")


def doc_scores(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")


@query("metric_auc", DOC_SQL)
def _(t: Tables):
    return metrics.auc(doc_scores(t), "quality", "n_chars").withColumn("auc", r6("auc"))


@query("metric_auc_bucketed", EVENT_SQL)
def _(t: Tables):
    """Many distinct scores, counted on the path that large tables take."""
    df = t.events.withColumn("y", F.pmod("event_id", F.lit(2)))
    return metrics.auc(df, "y", "value", n_buckets=16).withColumn("auc", r6("auc"))


OVR_SOURCE = """SELECT c, CAST(l_returnflag = c AS INTEGER) AS y,
  CASE c WHEN 'A' THEN l_quantity WHEN 'N' THEN l_discount ELSE l_tax END AS s
  FROM lineitem, (SELECT unnest(['A', 'N', 'R']) AS c)"""


@query("metric_auc_ovr", f"SELECT round(avg(a.auc), 5) AS auc, count(*) AS n_classes FROM ({auc_sql(OVR_SOURCE, 'c')}) a")
def _(t: Tables):
    out = metrics.auc_ovr(t.lineitem, "l_returnflag", {"A": "l_quantity", "N": "l_discount", "R": "l_tax"})
    return out.withColumn("auc", F.round("auc", 5))
