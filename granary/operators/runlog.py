"""Analytics over timing, evaluation and cross-validation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.arith import int_div
from granary.operators.scan import running


def accumulate_timers(df: DataFrame) -> DataFrame:
    """Total seconds per (name, proc)."""
    return df.groupBy("name", "proc").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n_calls"))


def explode_timers(df: DataFrame, column: str = "timer") -> DataFrame:
    """``MAP<name, MAP<proc, seconds>>`` to one row per (name, proc)."""
    rest = [c for c in df.columns if c != column]
    return (
        df.select(*rest, F.explode(column).alias("name", "procs"))
        .select(*rest, "name", F.explode("procs").alias("proc", "seconds"))
    )


def merge_timers(workers: DataFrame, client: DataFrame) -> DataFrame:
    """The slowest worker per (name, proc); a client value, where there is one, takes its place."""
    slowest = workers.groupBy("name", "proc").agg(F.max("seconds").alias("seconds"))
    own = client.select("name", "proc", F.col("seconds").alias("client_seconds"))
    return slowest.join(own, ["name", "proc"], "left").select(
        "name", "proc", F.coalesce("client_seconds", "seconds").alias("seconds")
    )


def merge_shapes(workers: DataFrame) -> DataFrame:
    """One row: batches summed, sparsity averaged, shape taken from the workers with a consistency flag."""
    return workers.agg(
        F.sum("n_batches").alias("n_batches"),
        F.avg("sparsity").alias("sparsity"),
        F.max_by("n_features", "worker").alias("n_features"),
        F.max_by("n_samples_per_batch", "worker").alias("n_samples_per_batch"),
        (
            (F.min("n_features") == F.max("n_features"))
            & (F.min("n_samples_per_batch") == F.max("n_samples_per_batch"))
        ).alias("consistent"),
    )


def merge_params(opts: DataFrame, params: DataFrame) -> DataFrame:
    """Union of key/value rows per run; a key that both hold with different values is flagged."""
    a = opts.select("run", "key", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    b = params.select("run", "key", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    joined = a.join(b, ["run", "key"], "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return joined.select(
        "run",
        "key",
        F.when(F.col("in_a").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("value"),
        (both & ~F.col("a").eqNullSafe(F.col("b"))).alias("conflict"),
    )


def cv_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Mean fit time, mean absolute score and population deviation of the score."""
    return df.groupBy(*keys).agg(
        F.avg("fit_time").alias("fit_time"),
        F.avg(F.abs("score")).alias("test_score_mean"),
        F.stddev_pop("score").alias("test_score_std"),
    )


def compare(df: DataFrame) -> DataFrame:
    """All algorithms side by side, with ranks and the spread of fit times over algorithms.

    The ranks run over one row per algorithm.
    """
    from pyspark.sql.window import Window

    summary = cv_summary(df, "algo")
    everything = Window.partitionBy(F.lit(0))
    return summary.withColumns(
        {
            "fit_time_std": F.stddev_pop("fit_time").over(everything),
            "time_rank": F.rank().over(everything.orderBy("fit_time", "algo")),
            "score_rank": F.rank().over(everything.orderBy("test_score_mean", "algo")),
        }
    )


def compare_grid(df: DataFrame, encodings: list[str]) -> DataFrame:
    """Mean absolute score as library by encoding."""
    return df.groupBy("library").pivot("encoding", encodings).agg(F.avg(F.abs("score")))


SIZES_BROADCAST_KEYS = 1_000_000


def latency_summary(df: DataFrame, key: str, order: str, seconds: str, n_buckets: int | None = None) -> DataFrame:
    """Per key: mean latency after the first half of the calls is dropped as warm-up.

    The calls per key are one row per key; up to ``SIZES_BROADCAST_KEYS`` keys (counted) they are broadcast to the
    ranked calls, so a key that holds a third of all calls is not gathered in one task by the join.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_calls"))
    if sizes.count() <= SIZES_BROADCAST_KEYS:
        sizes = F.broadcast(sizes)
    ranked = running(df.select(key, order, seconds), [key], [order], {"at": ("count", F.lit(1))}, n_buckets)
    kept = ranked.join(sizes, key).where(F.col("at") > int_div(F.col("n_calls"), 2))
    return kept.groupBy(key).agg(
        F.max("n_calls").alias("n_calls"), F.count(F.lit(1)).alias("n_kept"), F.avg(seconds).alias("mean_seconds")
    )


def eval_rounds(df: DataFrame, column: str = "evals") -> DataFrame:
    """``MAP<dataset, MAP<metric, ARRAY<score>>>`` to one row per round."""
    rest = [c for c in df.columns if c != column]
    return (
        df.select(*rest, F.explode(column).alias("dataset", "metrics"))
        .select(*rest, "dataset", F.explode("metrics").alias("metric", "scores"))
        .select(*rest, "dataset", "metric", F.posexplode("scores").alias("round", "score"))
    )


def latest_scores(df: DataFrame) -> DataFrame:
    """Score of the last round per (run, dataset, metric)."""
    return df.groupBy("run", "dataset", "metric").agg(
        F.max("round").alias("round"), F.max_by("score", "round").alias("score")
    )


def score_progress(df: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Per round: change from the previous round and the best score so far (smaller is better)."""
    from granary.operators.scan import neighbours

    keys = ["run", "dataset", "metric"]
    seen = neighbours(df, keys, ["round"], ["score"], n_buckets).drop("next_score")
    best = running(seen, keys, ["round"], {"best_so_far": ("min", F.col("score"))}, n_buckets)
    return best.withColumn("change", F.col("score") - F.col("prev_score")).drop("prev_score")


def doc_depth(df: DataFrame, document: str = "doc") -> int:
    """The deepest nesting of braces in any document, which no document's objects exceed.

    String literals are removed first (a quote, then anything but quotes and backslashes or an escaped character, then a
    quote), so braces inside strings do not count; what is left of a valid document has braces only around objects.
    """
    bare = F.regexp_replace(document, r'"(?:[^"\\]|\\.)*"', '""')
    signs = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    step = lambda s, c: F.struct((s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(s["top"], s["now"] + 1).alias("top"))
    deepest = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda s: s["top"])
    return df.agg(F.max(deepest)).first()[0] or 1


def doc_leaves(df: DataFrame, document: str = "doc", depth: int | None = None) -> DataFrame:
    """Leaf paths of JSON documents, one row per (run, path).

    A value that is not an object is a leaf. Objects are opened in place, as deep as the deepest document
    goes, so only the paths are exploded.
    """
    depth = depth or doc_depth(df, document)

    def entries(json: Column, prefix: Column) -> Column:
        opened = F.map_entries(F.from_json(json, "map<string,string>"))
        return F.transform(
            opened, lambda e: F.struct(F.concat(prefix, F.lit("/"), e["key"]).alias("path"), e["value"].alias("json"))
        )

    def descend(e: Column) -> Column:
        nested = F.coalesce(F.ltrim(e["json"]).startswith("{"), F.lit(False))
        return F.when(nested, entries(e["json"], e["path"])).otherwise(F.array(e))

    found = entries(F.col(document), F.lit(""))
    for _ in range(depth - 1):
        found = F.flatten(F.transform(found, descend))
    return df.select("run", F.explode(found).alias("leaf")).select("run", "leaf.path")


def doc_key_diff(df: DataFrame, document: str = "doc") -> DataFrame:
    """Leaf paths that not every run has, with the number of runs that do."""
    leaves = doc_leaves(df, document).distinct()
    counts = leaves.groupBy("path").agg(F.count(F.lit(1)).alias("n_runs"))
    total = df.agg(F.count_distinct("run")).scalar()
    return counts.where(F.col("n_runs") < total)
