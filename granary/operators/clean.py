"""Column cleaning, coercion, filters and feature/label separation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.scan import rank_within


def normalise_names(df: DataFrame) -> DataFrame:
    """Strip and lower-case all column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the named columns, in that order; an absent one is an error."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select(*names)


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the declared types; text that cannot be read as such becomes NULL."""
    columns = []
    for field in schema.fields:
        source = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType) and isinstance(df.schema[field.name].dataType, T.StringType):
            columns.append(F.try_to_timestamp(source).alias(field.name))
        else:
            columns.append(source.try_cast(field.dataType).alias(field.name))
    return df.select(*columns)


def fill_missing(df: DataFrame, value: float = -1, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL and NaN in numbers and NULL in strings; dates are left alone."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if columns is None or field.name in columns:
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                c = F.when(F.isnan(c), None).otherwise(c)
                c = F.coalesce(c, F.lit(value).cast(field.dataType))
            elif isinstance(field.dataType, T.NumericType):
                c = F.coalesce(c, F.lit(value).cast(field.dataType))
            elif isinstance(field.dataType, T.StringType):
                c = F.coalesce(c, F.lit(f"{value:g}"))
        out.append(c.alias(field.name))
    return df.select(*out)


def between_open(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows strictly inside every interval; NULL is outside. The conjunction reaches the scan."""
    tests: list[Column] = []
    for name, (low, high) in bounds.items():
        if low is not None:
            tests.append(F.col(name) > low)
        if high is not None:
            tests.append(F.col(name) < high)
    return df.filter(reduce(and_, tests)) if tests else df


def feature_columns(df: DataFrame, *labels: str) -> list[str]:
    """All columns but the labels, sorted by name."""
    return sorted(c for c in df.columns if c not in labels)


def split_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(features sorted by name, label)."""
    return df.select(*feature_columns(df, label)), df.select(label)


def features_then_label(df: DataFrame, label: str) -> DataFrame:
    """One table with the features sorted by name and the label last: no pairing needed later."""
    return df.select(*feature_columns(df, label), label)


def split_label_at(df: DataFrame, position: int) -> tuple[DataFrame, DataFrame]:
    """Separate the label by position; the features keep their order."""
    label = df.columns[position]
    return df.select(*[c for c in df.columns if c != label]), df.select(label)


def dates_to_day(df: DataFrame) -> DataFrame:
    """Replace each date or timestamp column by its day of month."""
    dates = {
        f.name: F.dayofmonth(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    }
    return df.withColumns(dates) if dates else df


def binarise(c: Column) -> Column:
    return (c > 0).cast("int")


def clip_nonpositive(c: Column) -> Column:
    return F.when(c <= 0, F.lit(0)).otherwise(c)


def minmax(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Scale a column to [0, 1]; a column without range becomes NULL.

    The range is a scalar subquery: one aggregate over that column, no join.
    """
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("ends")).scalar()
    return minmax_with(df, column, ends, out)


def minmax_with(df: DataFrame, column: str, ends: Column, out: str | None = None) -> DataFrame:
    span = (ends["hi"] - ends["lo"]).cast("double")
    scaled = (F.col(column) - ends["lo"]).cast("double") / F.nullif(span, F.lit(0.0))
    return df.withColumn(out or column, scaled)


def categorical_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The listed columns, or else all string and boolean columns."""
    if columns is not None:
        return [c for c in df.columns if c in columns]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Only the ``category`` or only the ``number`` columns."""
    cats = categorical_columns(df)
    if kind == "category":
        return df.select(*cats)
    if kind == "number":
        return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    raise ValueError(f"unknown kind: {kind}")


def categorical_mask(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, in column order: is it categorical, and how many values it holds."""
    cats = categorical_columns(df, columns)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(c in cats).alias("is_categorical"),
                F.col(c).alias("n_values"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.inline(rows))


def check_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> None:
    """Only FLOAT columns, or arrays of FLOAT, can be stored as a matrix."""
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        kind = f.dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.FloatType):
            raise TypeError(f"only FLOAT is supported, {f.name} is {f.dataType.simpleString()}")


def preview(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by key: a top-k, not a global sort."""
    return df.orderBy(key).limit(n)


def label_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Replace a label by its position among the sorted distinct labels; missing becomes -1."""
    from granary.operators.encode import apply_dictionary, dictionary

    coded = apply_dictionary(df, dictionary(df, column), column, out)
    return coded.withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def with_dense_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Number rows 0.. by a unique order, for tables that carry no dense key."""
    return rank_within(df, [], order, name).withColumn(name, F.col(name) - F.lit(1))
