"""Shape and content summaries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.clean import categorical_columns


def present(df: DataFrame, name: str) -> Column:
    """A value that is neither NULL nor NaN."""
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[name] in ("float", "double") else c.isNotNull()


def profile(df: DataFrame, features: Sequence[str], n_targets: int = 1, batch: str | None = None) -> DataFrame:
    """One row: rows, columns, non-missing cells, density, sparsity, batches and rows per batch.

    Batches may be ragged, hence the smallest, largest and mean batch.
    """
    nonmissing = [F.count_if(present(df, c)).alias(f"__n_{c}") for c in features]
    by_batch = df.groupBy(F.col(batch).alias("__b") if batch else F.lit(0).alias("__b")).agg(
        F.count(F.lit(1)).alias("__rows"), *nonmissing
    )
    total = sum((F.col(f"__n_{c}") for c in features[1:]), F.col(f"__n_{features[0]}"))
    out = by_batch.agg(
        F.sum("__rows").alias("n_rows"),
        F.sum(total).alias("n_nonmissing"),
        F.count(F.lit(1)).alias("n_batches"),
        F.min("__rows").alias("min_rows_per_batch"),
        F.max("__rows").alias("max_rows_per_batch"),
        F.avg("__rows").alias("avg_rows_per_batch"),
    )
    density = F.col("n_nonmissing") / (F.col("n_rows") * F.lit(len(features)))
    return out.withColumns(
        {
            "n_features": F.lit(len(features)),
            "n_targets": F.lit(n_targets),
            "density": density,
            "sparsity": F.lit(1.0) - density,
        }
    )


def class_balance(df: DataFrame, y: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(y) == 1).alias("n_positive"),
        F.count_if(F.col(y) == 0).alias("n_negative"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: kind, number of distinct values, missing values.

    The exact form stacks the columns and counts each (column, value) before counting values: one
    shuffle of already combined rows whatever the number of columns. ``approximate=True`` uses
    HyperLogLog++ and needs no shuffle of values at all.
    """
    cats = categorical_columns(df, columns)
    if approximate:
        aggs = []
        for c in df.columns:
            aggs.append(F.approx_count_distinct(c).alias(f"{c}__d"))
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__m"))
        one = df.agg(*aggs)
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit("category" if c in cats else "number").alias("kind"),
                    F.col(f"{c}__d").alias("cardinality"),
                    F.col(f"{c}__m").alias("n_missing"),
                )
                for c in df.columns
            ]
        )
        return one.select(F.inline(rows)).withColumn("has_missing", F.col("n_missing") > 0)
    stacked = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns]
            )
        ).alias("cell")
    ).select("cell.*")
    counted = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("column_name")
        .agg(
            F.count("value").alias("cardinality"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        )
        .withColumns(
            {
                "kind": F.when(F.col("column_name").isin(cats), "category").otherwise("number"),
                "has_missing": F.col("n_missing") > 0,
            }
        )
    )


def row_sum(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """(Weighted) sum over columns of one row; missing counts as zero."""
    terms = []
    for i, name in enumerate(columns):
        term = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        terms.append(term * F.lit(float(weights[i])) if weights else term)
    return sum(terms[1:], terms[0])


def array_sum(values: Column) -> Column:
    """Sum of an array column; NULL elements count as zero."""
    return F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0))
    )


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Distinct values over values. Values are counted first, so a hot value is combined early."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values")).withColumn(
        "ratio", F.col("n_distinct") / F.col("n_values")
    )
