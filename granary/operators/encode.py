"""Ordinal and one-hot encoding by dictionaries learnt on training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.clean import categorical_columns
from granary.operators.scan import rank_within

# A one-hot column per value is only sensible for small dictionaries; beyond this many use
# ``onehot_sparse``.
MAX_WIDE_VALUES = 1024


def dictionary(df: DataFrame, column: str, n_buckets: int | None = None) -> DataFrame:
    """``value, code``: sorted distinct values numbered from 0. NULL has no code.

    Values are combined before the ranking, and the ranking is a bucketed scan, so neither a hot value
    nor a large dictionary ends in one task.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranked = rank_within(values, [], ["value"], "code", n_buckets)
    return ranked.select("value", (F.col("code") - F.lit(1)).cast("int").alias("code"))


def apply_dictionary(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Attach codes; a value the dictionary lacks becomes NULL. AQE broadcasts a small dictionary.

    The dictionary has one row per value, so a hot value only makes the other side long,
    which AQE splits.
    """
    d = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    joined = df.join(d, F.col(column) == F.col("__value"), "left").drop("__value")
    kept = [F.col("__code").alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        kept.append(F.col("__code").alias(out))
    return joined.select(*kept)


def ordinal_fit(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    return {c: dictionary(df, c) for c in categorical_columns(df, columns)}


def ordinal_transform(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """Encoded columns first, all others after them."""
    for column, codes in dictionaries.items():
        df = apply_dictionary(df, codes, column, column)
    return df.select(*dictionaries, *[c for c in df.columns if c not in dictionaries])


def onehot_fit(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list]:
    """Sorted values per column, bounded by ``MAX_WIDE_VALUES`` since each becomes a column."""
    out = {}
    for c in categorical_columns(df, columns):
        rows = df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(MAX_WIDE_VALUES + 1).collect()
        if len(rows) > MAX_WIDE_VALUES:
            raise ValueError(f"{c} has more than {MAX_WIDE_VALUES} values: use onehot_sparse")
        out[c] = [r[0] for r in rows]
    return out


def onehot_transform(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """0/1 columns named ``column=value``; an unseen value is all zeros. No join, no shuffle."""
    hot: list[Column] = []
    for c, vs in values.items():
        hot += [F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}={v}") for v in vs]
    return df.select(*hot, *[c for c in df.columns if c not in values])


def onehot_sparse(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Wide dictionaries as (index, 1.0) pairs: the row keeps the code of its only non-zero."""
    coded = apply_dictionary(df, codes, column, "__code")
    return coded.withColumn(
        out, F.when(F.col("__code").isNotNull(), F.create_map("__code", F.lit(1.0))).otherwise(F.create_map())
    ).drop("__code")
