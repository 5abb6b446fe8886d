"""Seconds per headline query at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from granary import plans  # noqa: E402
from granary.operators.quantile import approx_cuts, bin_arrays, collect_cuts  # noqa: E402
from granary.operators.train import train_gbt  # noqa: E402
from granary.session import local_session, scratch_path  # noqa: E402
from granary.sources import striped, synth  # noqa: E402

HEADLINE = [
    "mortgage_join", "trip_features", "clean_trips", "outlier_filter", "minmax_label", "categorical_profile", "profile",
    "diff_tables", "locate_rows", "split_tail_batch", "kfold_stratified", "stripe_roundtrip", "range_read", "csv_scan",
    "gen_dense_cells", "gen_labels_multi", "gen_batches", "ordinal_encode", "onehot_encode", "quantile_cuts",
    "quantile_bin", "peak_memory", "peak_memory_bucketed", "alloc_lifecycle", "latency_summary", "score_progress",
    "metric_auc_bucketed", "metric_auc_ovr", "gbt_histogram", "gbt_best_split", "train_gbt", "predict_gbt",
]


def noop(df) -> None:
    """Compute every row without a sink."""
    df.write.format("noop").mode("overwrite").save()


def published_run(spark) -> dict[str, float]:
    """The steps of the one published run: 32768 x 512 values, 256 bins, two rounds of depth six."""
    n, m = 32768, 512
    path = scratch_path(spark, "bench")
    begin = time.perf_counter()
    synth.datagen(synth.row_range(spark, n), path, n, m, n_shards=8)
    out = {"run_datagen": time.perf_counter() - begin}
    from pyspark.sql import functions as F

    begin = time.perf_counter()
    noop(striped.read_striped(spark, path))
    out["run_load"] = time.perf_counter() - begin
    stored = striped.read_striped(spark, path).select("features", F.get("labels", F.lit(0)).alias("y"))
    begin = time.perf_counter()
    cuts = collect_cuts(approx_cuts(stored, "features", 256), range(m))
    noop(stored.select(bin_arrays(F.col("features"), list(cuts.values()))))
    out["run_quantile"] = time.perf_counter() - begin
    begin = time.perf_counter()
    model = train_gbt(stored, "features", "y", {"max_bin": 256, "max_depth": 6}, 2)
    out["run_train_2_rounds"] = time.perf_counter() - begin
    out["run_rmse_last"] = model.history[-1]["train", "rmse"]
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else None
    spark = local_session("granary-bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    plans.load()
    noop(plans.QUERIES["mortgage_join"](spark, sf_dir))
    noop(plans.QUERIES["predict_stump"](spark, sf_dir))
    seconds: dict[str, float] = {}
    for name in [n for n in HEADLINE if only is None or n in only]:
        best = None
        for _ in range(1 if name.startswith(("train", "predict")) else 2):
            begin = time.perf_counter()
            noop(plans.QUERIES[name](spark, sf_dir))
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    rmse = None
    if only is None or "run" in only:
        run = published_run(spark)
        rmse = run.pop("run_rmse_last")
        seconds.update({k: round(v, 3) for k, v in run.items()})
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": cores,
                "run_rmse_last": rmse,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
