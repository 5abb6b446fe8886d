"""Quantile binning: cuts learnt on training data, bins looked up by a JVM binary search."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.arith import int_div
from granary.operators.scan import running
from granary.session import materialize

MAX_BIN = 256
MISSING = -1
# sketches an aggregating task may hold for an array column before it sorts instead
ARRAY_WIDTH = 4096


def _cells(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """One row per non-missing cell: ``feature, value``.

    ``columns`` names the feature columns, or one array column whose positions are the features.
    """
    if isinstance(columns, str):
        cells = df.select(F.posexplode(F.col(columns).cast("array<double>")).alias("feature", "value"))
        return cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    cells = df.select(F.inline(pairs))
    return cells.where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_cuts(df: DataFrame, columns: Sequence[str] | str, max_bin: int = MAX_BIN, n_buckets: int | None = None) -> DataFrame:
    """``feature, cuts``: distinct discrete quantiles at k/max_bin, k = 1 .. max_bin-1.

    Equal values are combined first, then a bucketed running count finds the values at which
    a quantile boundary is crossed; at most max_bin - 1 rows per feature are gathered. The counts are
    written, so that ``df`` is evaluated once, not for each step that reads them.
    """
    counts = materialize(_cells(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    upto = running(counts, ["feature"], ["value"], {"upto": ("sum", F.col("n"))}, n_buckets)
    # one row per feature: broadcast when the features are named (their number bounds it); the positions of an array
    # column are known only from the data, so that join is left to adaptive execution, which broadcasts by measured size
    if not isinstance(columns, str):
        totals = F.broadcast(totals)
    upto = upto.join(totals, "feature")
    bins = F.lit(max_bin)
    reached = F.least(int_div(F.col("upto") * bins, F.col("total")), bins - F.lit(1))
    before = int_div((F.col("upto") - F.col("n")) * bins, F.col("total"))
    crossed = upto.where(reached > before)
    return crossed.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("cuts"))


def approx_cuts(df: DataFrame, columns: Sequence[str] | str, max_bin: int = MAX_BIN, accuracy: int | None = None) -> DataFrame:
    """The same from mergeable sketches: nothing but sketches is shuffled, one per feature and task."""
    probs = [k / max_bin for k in range(1, max_bin)]
    sketch = F.percentile_approx("value", probs, accuracy or 20 * max_bin)
    # with many features the hash aggregate would fall back to sorting all cells
    limit = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    wide = ARRAY_WIDTH if isinstance(columns, str) else len(columns)
    if int(df.sparkSession.conf.get(limit)) <= wide:
        df.sparkSession.conf.set(limit, str(wide + 1))
    return (
        _cells(df, columns)
        .groupBy("feature")
        .agg(F.array_sort(F.array_distinct(sketch)).alias("cuts"))
    )


def quantile_cuts(df: DataFrame, columns: Sequence[str] | str, max_bin: int = MAX_BIN, exact: bool = False) -> DataFrame:
    return exact_cuts(df, columns, max_bin) if exact else approx_cuts(df, columns, max_bin)


def collect_cuts(cuts: DataFrame, columns: Sequence) -> dict:
    """Cuts as plain numbers: at most max_bin - 1 per feature. A feature without values has none."""
    found = {r["feature"]: list(r["cuts"]) for r in cuts.collect()}
    return {c: found.get(c, []) for c in columns}


def bins_of(x: np.ndarray, tables: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows x features: the number of cuts <= value, and -1 for NaN."""
    out = np.empty(x.shape, dtype=np.int16)
    for j, table in enumerate(tables):
        out[:, j] = np.searchsorted(table, x[:, j], side="right")
    out[np.isnan(x)] = MISSING
    return out


def bin_arrays(features: Column, cuts: Sequence[Sequence[float]]) -> Column:
    """Bins of an array column, as SMALLINT: for matrices too wide for one column per feature.

    Every array must hold one value per table of cuts; a row of another length is refused (ValueError), not re-cut into
    rows of that width. A null array gets the missing bin for every feature, as does a null or NaN value.
    """
    tables = [np.asarray(c, dtype=np.float64) for c in cuts]
    width = len(tables)

    def bins(values: pa.Array) -> pa.Array:
        absent = values.is_null().to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
        wrong = ~absent & (np.nan_to_num(lengths.astype(np.float64), nan=width) != width)
        if wrong.any():
            raise ValueError(f"bin_arrays: a row holds {int(lengths[np.flatnonzero(wrong)[0]])} values for {width} tables of cuts")
        x = np.full((len(values), width), np.nan)
        x[~absent] = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        out = bins_of(x, tables)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * len(tables)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return F.arrow_udf(bins, "array<smallint>")(features)


def apply_cuts(df: DataFrame, cuts: dict[str, list[float]], suffix: str = "_bin") -> DataFrame:
    """Add the bin of each column: the number of cuts <= value, and -1 for a missing value."""
    # a bucket boundary needs at least three ends, so features without cuts are constant zero
    split = {c: v for c, v in cuts.items() if v}
    raw = {c: f"__raw_{c}" for c in split}
    valid = {c: f"__in_{c}" for c in split}
    out = df
    if split:
        # NULL and NaN are replaced for the lookup and mapped to -1 afterwards
        out = out.withColumns({valid[c]: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in split})
        out = Bucketizer(
            inputCols=[valid[c] for c in split],
            outputCols=[raw[c] for c in split],
            splitsArray=[[-math.inf, *v, math.inf] for v in split.values()],
        ).transform(out)
    bins: dict[str, Column] = {}
    for c in cuts:
        missing = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        code = F.col(raw[c]).cast("smallint") if c in split else F.lit(0).cast("smallint")
        bins[f"{c}{suffix}"] = F.when(missing, F.lit(MISSING).cast("smallint")).otherwise(code)
    return out.withColumns(bins).drop(*raw.values(), *valid.values())
