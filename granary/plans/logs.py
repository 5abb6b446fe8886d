"""Queries over timing, evaluation and cross-validation logs, and result documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import runlog
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6
from granary.session import scratch_path
from granary.sources import results


@query(
    "timer_totals",
    f"SELECT name, proc, round(sum(seconds), 6) AS seconds, count(*) AS n_calls FROM ({fx.TIMERS_SQL}) GROUP BY 1, 2",
)
def _(t: Tables):
    return runlog.accumulate_timers(fx.timers(t)).withColumn("seconds", r6("seconds"))


@query(
    "timer_max",
    f"""
    WITH tm AS ({fx.TIMERS_SQL}), w AS (SELECT worker, name, proc, sum(seconds) AS s FROM tm GROUP BY 1, 2, 3)
    SELECT name, proc, round(CASE WHEN name = 'view' AND proc = 0 THEN sum(s) ELSE max(s) END, 6) AS seconds
    FROM w GROUP BY 1, 2
    """,
)
def _(t: Tables):
    log = fx.timers(t)
    per_worker = log.groupBy("worker", "name", "proc").agg(F.sum("seconds").alias("seconds"))
    client = (
        log.where((F.col("name") == "view") & (F.col("proc") == 0))
        .groupBy("name", "proc")
        .agg(F.sum("seconds").alias("seconds"))
    )
    return runlog.merge_timers(per_worker, client).withColumn("seconds", r6("seconds"))


@query(
    "merge_shapes",
    """
    WITH b AS (SELECT event_id // 500 AS batch_idx, count(*) AS n, avg(CAST(event_type = 'error' AS INTEGER)) AS sp
      FROM events GROUP BY 1),
    w AS (SELECT CAST(batch_idx % 4 AS INTEGER) AS worker, count(*) AS n_batches, avg(sp) AS sparsity,
      max(n) AS n_samples_per_batch, 3 AS n_features FROM b GROUP BY 1)
    SELECT CAST(sum(n_batches) AS BIGINT) AS n_batches, round(avg(sparsity), 6) AS sparsity,
      arg_max(n_features, worker) AS n_features, arg_max(n_samples_per_batch, worker) AS n_samples_per_batch,
      min(n_features) = max(n_features) AND min(n_samples_per_batch) = max(n_samples_per_batch) AS consistent FROM w
    """,
)
def _(t: Tables):
    b = (
        fx.event_batches(t)
        .groupBy("batch_idx")
        .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("sp"))
    )
    workers = b.groupBy(F.pmod("batch_idx", F.lit(4)).cast("int").alias("worker")).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg("sp").alias("sparsity"),
        F.max("n").alias("n_samples_per_batch"),
        F.lit(3).alias("n_features"),
    )
    return runlog.merge_shapes(workers).withColumn("sparsity", r6("sparsity"))


@query(
    "merge_params",
    """
    SELECT event_id AS run, 'type' AS key, event_type AS value, FALSE AS conflict FROM events
    UNION ALL SELECT event_id, 'props', props, FALSE FROM events
    UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR), event_id % 5 = 0 FROM events
    """,
)
def _(t: Tables):
    e = t.events
    run = F.col("event_id").alias("run")

    def rows(**values):
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
        return e.select(run, F.inline(pairs))

    user = F.col("user_id").cast("string")
    other = F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(user, F.lit("x"))).otherwise(user)
    return runlog.merge_params(rows(type=F.col("event_type"), user=user), rows(user=other, props=F.col("props")))


CV_SUMMARY_SQL = f"""SELECT algo, avg(fit_time) AS fit_time, avg(abs(score)) AS test_score_mean,
  stddev_pop(score) AS test_score_std FROM ({fx.CV_SQL}) GROUP BY 1"""


@query(
    "cv_summary",
    f"""
    SELECT algo, round(fit_time, 6) AS fit_time, round(test_score_mean, 6) AS test_score_mean,
      round(test_score_std, 6) AS test_score_std FROM ({CV_SUMMARY_SQL})
    """,
)
def _(t: Tables):
    out = runlog.cv_summary(fx.cv_log(t), "algo")
    return out.withColumns({c: r6(F.col(c)) for c in out.columns[1:]})


@query(
    "compare_algos",
    f"""
    SELECT algo, round(fit_time, 6) AS fit_time, round(test_score_mean, 6) AS test_score_mean,
      round(test_score_std, 6) AS test_score_std, round(stddev_pop(fit_time) OVER (), 6) AS fit_time_std,
      CAST(rank() OVER (ORDER BY fit_time, algo) AS INTEGER) AS time_rank,
      CAST(rank() OVER (ORDER BY test_score_mean, algo) AS INTEGER) AS score_rank FROM ({CV_SUMMARY_SQL})
    """,
)
def _(t: Tables):
    out = runlog.compare(fx.cv_log(t))
    doubles = ("fit_time", "test_score_mean", "test_score_std", "fit_time_std")
    return out.withColumns({c: r6(F.col(c)) for c in doubles})


@query(
    "compare_grid",
    """
    SELECT event_type AS library, round(avg(abs(value)) FILTER (event_id % 4 = 0), 6) AS ord,
      round(avg(abs(value)) FILTER (event_id % 4 = 1), 6) AS ohe,
      round(avg(abs(value)) FILTER (event_id % 4 = 2), 6) AS nohe,
      round(avg(abs(value)) FILTER (event_id % 4 = 3), 6) AS part FROM events GROUP BY 1
    """,
)
def _(t: Tables):
    encodings = ["ord", "ohe", "nohe", "part"]
    pick = F.get(F.array(*[F.lit(e) for e in encodings]), F.pmod("event_id", F.lit(4)).cast("int"))
    log = t.events.select(F.col("event_type").alias("library"), pick.alias("encoding"), F.col("value").alias("score"))
    out = runlog.compare_grid(log, encodings)
    return out.withColumns({e: r6(F.col(e)) for e in encodings})


LATENCY_SQL = """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos,
      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n_calls, count(*) AS n_kept, round(avg(value), 6) AS mean_seconds
    FROM r WHERE pos > n // 2 GROUP BY 1
    """


@query("latency_summary", LATENCY_SQL)
def _(t: Tables):
    out = runlog.latency_summary(t.events, "event_type", "event_id", "value")
    return out.withColumn("mean_seconds", r6("mean_seconds"))


@query("latency_summary_bucketed", LATENCY_SQL)
def _(t: Tables):
    """The same on the path that large tables take."""
    out = runlog.latency_summary(t.events, "event_type", "event_id", "value", n_buckets=8)
    return out.withColumn("mean_seconds", r6("mean_seconds"))


@query(
    "latest_scores",
    f"""
    SELECT run, dataset, metric, max(round) AS round, arg_max(score, round) AS score
    FROM ({fx.EVAL_SQL}) GROUP BY 1, 2, 3
    """,
)
def _(t: Tables):
    return runlog.latest_scores(fx.eval_log(t))


PROGRESS_SQL = f"""
    SELECT *, min(score) OVER w AS best_so_far, round(score - lag(score) OVER w, 6) AS change FROM ({fx.EVAL_SQL})
    WINDOW w AS (PARTITION BY run, dataset, metric ORDER BY round)
    """


@query("score_progress", PROGRESS_SQL)
def _(t: Tables):
    return runlog.score_progress(fx.eval_log(t)).withColumn("change", r6("change"))


@query("score_progress_bucketed", PROGRESS_SQL)
def _(t: Tables):
    return runlog.score_progress(fx.eval_log(t), n_buckets=8).withColumn("change", r6("change"))


def documents(t: Tables):
    """One result document per fifty events: options, timers per event type and scores in event order.

    A document holds the log of one run, so its size is bounded by the run, here by fifty events.
    """
    e = t.events.withColumn("run", fx.batch_number("event_id", 50).cast("string"))
    per_name = e.groupBy("run", "event_type").agg(
        F.sum("value").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("scores"),
    )
    per_run = per_name.groupBy("run").agg(
        F.map_from_entries(
            F.collect_list(F.struct("event_type", F.create_map(F.lit("total"), F.col("total"))))
        ).alias("timer"),
        F.map_from_entries(F.collect_list(F.struct("event_type", "scores"))).alias("metrics"),
        F.sum("n").alias("n"),
    )
    return per_run.select(
        "run",
        F.struct(F.col("n").alias("n_samples_per_batch"), F.lit(8).cast("bigint").alias("max_depth")).alias("opts"),
        "timer",
        F.create_map(F.lit("Train"), F.col("metrics")).alias("evals"),
    )


def _stored_documents(t: Tables):
    path = scratch_path(t.spark, "results")
    results.save_results(documents(t), path)
    return results.read_results(t.spark, path)


@query(
    "results_scan",
    """
    SELECT CAST(event_id // 50 AS VARCHAR) AS run, event_type AS name, 'total' AS proc, round(sum(value), 6) AS seconds,
      max(n) AS n_samples_per_batch, 8::BIGINT AS max_depth
    FROM (SELECT *, count(*) OVER (PARTITION BY event_id // 50) AS n FROM events) GROUP BY 1, 2
    """,
)
def _(t: Tables):
    docs = _stored_documents(t).select("run", "opts.n_samples_per_batch", "opts.max_depth", "timer")
    return runlog.explode_timers(docs).withColumn("seconds", r6("seconds"))


@query(
    "eval_rounds",
    """
    SELECT CAST(event_id // 50 AS VARCHAR) AS run, 'Train' AS dataset, event_type AS metric,
      CAST(row_number() OVER (PARTITION BY event_id // 50, event_type ORDER BY event_id) - 1 AS INTEGER) AS round,
      value AS score FROM events
    """,
)
def _(t: Tables):
    return runlog.eval_rounds(_stored_documents(t).select("run", "evals"))


@query(
    "doc_key_diff",
    """
    WITH k AS (SELECT DISTINCT event_id AS run, '/opts/' || event_type AS path FROM events
      UNION SELECT event_id, '/timer/Train/' || (event_id % 3) FROM events
      UNION SELECT event_id, '/run' FROM events)
    SELECT path, count(*) AS n_runs FROM k GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM events)
    """,
)
def _(t: Tables):
    e = t.events
    doc = F.to_json(
        F.struct(
            F.col("event_id").alias("run"),
            F.create_map(F.col("event_type"), F.col("value")).alias("opts"),
            F.create_map(
                F.lit("Train"), F.create_map(F.pmod("event_id", F.lit(3)).cast("string"), F.col("value"))
            ).alias("timer"),
        )
    )
    return runlog.doc_key_diff(e.select(F.col("event_id").alias("run"), doc.alias("doc")))
