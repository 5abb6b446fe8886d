"""Ordered scans (running totals, ranks, neighbours) that do not need a whole group in one task.

A plain window sorts every group in one task, so a key that holds a third of the table becomes the
slowest task of the job. Here the order column is cut into buckets of about equal row count; a
window runs inside each (key, bucket), one small row per (key, bucket) is carried forward over the
buckets of its key, and the carry is joined back. No task sees more than a bucket of a key.

The first order column must be nearly unique inside a key: rows that tie on it share a bucket.
Cuts are collected as plain numbers (``MAX_CUTS`` at most), so that recomputing a lost partition meets exactly
the same buckets. Larger tables get more buckets by dividing the stretch between two cuts evenly, so a
bucket stays at about ``ROWS_PER_BUCKET`` rows whatever the table's size (texts are divided at cuts only).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.arith import count_at_most

ROWS_PER_BUCKET = 1_000_000
MAX_CUTS = 4096
_BUCKET = "__bucket"


def order_cuts(df: DataFrame, order: str, n_buckets: int | None = None) -> list:
    """Boundaries that cut ``order`` into parts of about equal row count.

    With ``n_buckets=None`` the row count decides; a table that fits in one bucket gets no
    boundary, since then no group of it can be large either.
    """
    return _divide(df, order, n_buckets)[0]


def _divide(df: DataFrame, order: str, n_buckets: int | None) -> tuple[list, int]:
    """Cuts, and the number of even parts between two of them."""
    if n_buckets is None:
        n_buckets = -(-df.count() // ROWS_PER_BUCKET)
    if n_buckets <= 1:
        return [], 1
    at_cuts, parts = min(n_buckets, MAX_CUTS), -(-n_buckets // MAX_CUTS)
    kind = dict(df.dtypes)[order]
    if kind == "string":
        return _string_cuts(df, order, at_cuts), 1
    value = F.unix_micros(order) if kind == "timestamp" else F.col(order)
    # with parts between cuts the outermost stretches need an end as well
    probs = [i / at_cuts for i in (range(1, at_cuts) if parts == 1 else range(at_cuts + 1))]
    cuts = df.select(F.percentile_approx(value, probs, 10 * at_cuts)).first()[0]
    return sorted(set(cuts or [])), parts


def _string_cuts(df: DataFrame, order: str, n_buckets: int) -> list:
    """Boundaries from about fifty sampled values per bucket; only the balance depends on them."""
    wanted = 50 * n_buckets
    total = df.count()
    sample = df.select(order).where(F.col(order).isNotNull())
    if total > wanted:
        sample = sample.sample(wanted / total, seed=7)
    values = sorted(r[0] for r in sample.collect())  # ``wanted`` of them in the mean, whatever the table's size
    return sorted({values[len(values) * i // n_buckets] for i in range(1, n_buckets)}) if values else []


def _bucketed(df: DataFrame, order: str, cuts: list, parts: int = 1) -> DataFrame:
    value = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order)
    bucket = count_at_most(value, cuts)
    if parts == 1:
        return df.withColumn(_BUCKET, bucket)
    ends = F.array(*[F.lit(c) for c in cuts])
    rows = df.withColumn(_BUCKET, bucket)
    low, high = F.get(ends, F.col(_BUCKET) - 1), F.get(ends, F.col(_BUCKET))
    part = F.floor((value - low).cast("double") / (high - low).cast("double") * parts).cast("bigint")
    part = F.coalesce(F.greatest(F.least(part, F.lit(parts - 1).cast("bigint")), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return rows.withColumn(_BUCKET, F.col(_BUCKET).cast("bigint") * parts + part)


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, _BUCKET]
    renamed = carry.withColumnsRenamed({k: f"__k_{k}" for k in on})
    cond = None
    for k in on:
        part = rows[k].eqNullSafe(renamed[f"__k_{k}"])
        cond = part if cond is None else cond & part
    return rows.join(renamed, cond, "left").drop(*[f"__k_{k}" for k in on])


_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    n_buckets: int | None = None,
) -> DataFrame:
    """Add inclusive running aggregates; ``aggs`` maps a new name to (sum|count|min|max, column)."""
    keys, order = list(keys), list(order)
    cuts, parts = _divide(df, order[0], n_buckets)
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: _AGG[f](c).over(w) for n, (f, c) in aggs.items()})

    rows = _bucketed(df, order[0], cuts, parts)
    inner = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry_fn = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}

    local = rows.withColumns({f"__l_{n}": _AGG[f](c).over(inner) for n, (f, c) in aggs.items()})
    parts = rows.groupBy(*keys, _BUCKET).agg(*[_AGG[f](c).alias(f"__p_{n}") for n, (f, c) in aggs.items()])
    carry = parts.select(
        *keys, _BUCKET, *[carry_fn[f](f"__p_{n}").over(before).alias(f"__c_{n}") for n, (f, _) in aggs.items()]
    )
    joined = _join_carry(local, carry, keys)
    out = {}
    for n, (f, _) in aggs.items():
        here, earlier = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if f in ("sum", "count"):
            out[n] = F.coalesce(here + earlier, here, earlier)
        else:
            out[n] = (F.greatest if f == "max" else F.least)(here, earlier)
    joined = joined.withColumns(out)
    return joined.drop(_BUCKET, *[f"__{p}_{n}" for n in aggs for p in "lc"])


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, n_buckets: int | None = None
) -> DataFrame:
    """Add the 1-based position of a row inside its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, n_buckets)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    n_buckets: int | None = None,
) -> DataFrame:
    """Add ``prev_c`` and ``next_c`` for each column, the values of the adjacent rows of the key."""
    keys, order, columns = list(keys), list(order), list(columns)
    cuts, parts = _divide(df, order[0], n_buckets)
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(
            {f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns}
        )
    rows = _bucketed(df, order[0], cuts, parts)
    w = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    local = rows.withColumns(
        {f"__p_{c}": F.lag(c).over(w) for c in columns}
        | {f"__n_{c}": F.lead(c).over(w) for c in columns}
        | {"__first": F.lag(F.lit(1)).over(w).isNull(), "__last": F.lead(F.lit(1)).over(w).isNull()}
    )
    values, at = F.struct(*columns), F.struct(*order)
    edges = rows.groupBy(*keys, _BUCKET).agg(
        F.min_by(values, at).alias("__head"), F.max_by(values, at).alias("__tail")
    )
    wb = Window.partitionBy(*keys).orderBy(_BUCKET)
    carry = edges.select(
        *keys, _BUCKET, F.lag("__tail").over(wb).alias("__before"), F.lead("__head").over(wb).alias("__after")
    )
    joined = _join_carry(local, carry, keys)
    out = {}
    for c in columns:
        out[f"prev_{c}"] = F.when(F.col("__first"), F.col("__before")[c]).otherwise(F.col(f"__p_{c}"))
        out[f"next_{c}"] = F.when(F.col("__last"), F.col("__after")[c]).otherwise(F.col(f"__n_{c}"))
    joined = joined.withColumns(out)
    return joined.drop(
        _BUCKET, "__first", "__last", "__before", "__after", *[f"__{p}_{c}" for c in columns for p in "pn"]
    )


def prefix_by_bucket(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    delta: Column,
    n_buckets: int | None = None,
) -> DataFrame:
    """Per key: ``total`` and ``peak`` of the running sum of ``delta`` (``peak`` is at least 0).

    Rows are reduced to one (total, peak) pair per (key, bucket); no join back is needed.
    """
    keys, order = list(keys), list(order)
    cuts, parts = _divide(df, order[0], n_buckets)
    rows = _bucketed(df, order[0], cuts, parts)
    inner = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        rows.withColumns({"__d": delta, "__r": F.sum(delta).over(inner)})
        .groupBy(*keys, _BUCKET)
        .agg(F.sum("__d").alias("__total"), F.max("__r").alias("__peak"))
    )
    return fold_peaks(parts, keys, _BUCKET)


def fold_peaks(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Combine ordered (``__total``, ``__peak``) parts of each key into one ``total`` and ``peak``."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__carry", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    return carried.groupBy(*keys).agg(
        F.sum("__total").alias("total"),
        F.greatest(F.max(F.col("__carry") + F.col("__peak")), F.lit(0).cast("bigint")).alias("peak"),
    )
