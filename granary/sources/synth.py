"""Synthetic tables whose cells depend on the cell number alone.

Cell ``row * n_cols + col + seed`` fixes a value. Rows come from any table with a dense row id, or
from ``row_range``, and nothing is shuffled. Long form is generated by column expressions; rows with
an array of cells go through an Arrow function, since per-element lambdas are interpreted by Spark
and take ten times as long. Both use the same formula.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import mix
from granary.operators.profile import array_sum
from granary.operators.split import with_batches


def row_range(spark: SparkSession, n_rows: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + n_rows).select(F.col("id").alias("row_id"))


# cells drawn at a time inside a task, to bound its memory whatever the number of columns
CHUNK_CELLS = 1 << 20


def _drawn(row_id: np.ndarray, n_cols: int, seed: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    cell = (row_id[:, None] * n_cols + (np.arange(n_cols) + seed)).ravel()
    return mix.scrambled(cell, lane, cell // mix.MODULUS)


def _row_chunks(row_id: pa.Array, n_cols: int):
    rows = row_id.to_numpy(zero_copy_only=False).astype(np.int64)
    step = max(1, CHUNK_CELLS // n_cols)
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _mask_lane(mask: str) -> int:
    lanes = {"independent": mix.MASK_LANE, "coupled": mix.VALUE_LANE}
    if mask not in lanes:
        raise ValueError(f"unknown mask: {mask}")
    return lanes[mask]


def _dense_udf(n_cols: int, seed: int, sparsity: float, mask: str):
    lane = _mask_lane(mask)

    def cells(row_id: pa.Array) -> pa.Array:
        parts = []
        for rows in _row_chunks(row_id, n_cols):
            x, z = _drawn(rows, n_cols, seed, mix.VALUE_LANE)
            gone = None
            if sparsity > 0:
                gone = mix.uniform_of(_drawn(rows, n_cols, seed, lane)[0]) < sparsity
            parts.append(pa.array(mix.SCALE * mix.normal_of(x, z, np), mask=gone))
        values = pa.concat_arrays(parts) if parts else pa.array([], pa.float64())
        return _lists(np.full(len(row_id), n_cols), values)

    return F.arrow_udf(cells, "array<double>")


def _sparse_udf(n_cols: int, seed: int, sparsity: float):
    def entries(row_id: pa.Array) -> pa.Array:
        at, drawn, lengths = [np.empty(0, np.int32)], [np.empty(0)], [np.empty(0, np.int64)]
        for rows in _row_chunks(row_id, n_cols):
            kept = mix.uniform_of(_drawn(rows, n_cols, seed, mix.MASK_LANE)[0]) >= sparsity
            at.append((np.flatnonzero(kept) % n_cols).astype(np.int32))
            drawn.append(mix.uniform_of(_drawn(rows, n_cols, seed, mix.VALUE_LANE)[0])[kept])
            lengths.append(kept.reshape(-1, n_cols).sum(axis=1))
        pairs = pa.StructArray.from_arrays([np.concatenate(at), np.concatenate(drawn)], names=["i", "v"])
        return _lists(np.concatenate(lengths), pairs)

    return F.arrow_udf(entries, "array<struct<i: int, v: double>>")


def dense_rows(
    rows: DataFrame,
    n_cols: int,
    seed: int = 0,
    sparsity: float = 0.0,
    mask: str = "independent",
    row_id: str = "row_id",
) -> DataFrame:
    """Add ``features ARRAY<DOUBLE>`` with cells drawn from N(0, 1.5).

    A cell is missing (NULL) with probability ``sparsity``. ``mask="coupled"`` decides that from
    the draw of the value itself, so that missing values are not missing at random.
    """
    return rows.withColumn("features", _dense_udf(n_cols, seed, sparsity, mask)(F.col(row_id).cast("bigint")))


def dense_cells(
    rows: DataFrame, n_cols: int, seed: int = 0, sparsity: float = 0.0, mask: str = "independent", row_id: str = "row_id"
) -> DataFrame:
    """The same cells in long form: ``row_id, col_idx, value``, generated column-wise in one stage."""
    cells = rows.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col_idx"),
    )
    number = F.col("row_id") * F.lit(n_cols) + F.col("col_idx").cast("bigint") + F.lit(seed)
    cells = mix.with_pair(cells, number, mix.VALUE_LANE, "__v")
    value = F.lit(mix.SCALE) * mix.normal_of(F.col("__v_x"), F.col("__v_z"))
    if sparsity > 0:
        cells = mix.with_pair(cells, number, _mask_lane(mask), "__m")
        value = F.when(mix.uniform_of(F.col("__m_x")) >= F.lit(float(sparsity)), value)
    return cells.select("row_id", "col_idx", value.alias("value"))


def linear_labels(df: DataFrame, n_targets: int = 1, features: str = "features", out: str = "labels") -> DataFrame:
    """Add ``labels ARRAY<DOUBLE>``: one coefficient per target times the sum of the present cells."""
    total = array_sum(F.col(features))
    return df.withColumn(out, F.array(*[total * F.lit(c) for c in mix.target_coefficients(n_targets)]))


def binary_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """1 where the linear label is positive."""
    return df.withColumn(labels, F.transform(labels, lambda y: F.when(y > 0, 1.0).otherwise(0.0)))


def sparse_cells(
    rows: DataFrame, n_cols: int, sparsity: float, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Non-zero cells only: ``row_id, col_idx, value`` with values from U(0, 1)."""
    entries = _sparse_udf(n_cols, seed, sparsity)(F.col(row_id).cast("bigint"))
    cells = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.explode(entries).alias("__e"))
    return cells.select("row_id", F.col("__e.i").alias("col_idx"), F.col("__e.v").alias("value"))


def sparse_rows(
    rows: DataFrame, n_cols: int, sparsity: float, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Sparse rows as ``indices, values`` arrays with ``label`` = row sum + N(0, 0.5); no shuffle."""
    out = rows.withColumn("__e", _sparse_udf(n_cols, seed, sparsity)(F.col(row_id).cast("bigint")))
    noise_cell = F.col(row_id).cast("bigint") + F.lit(seed)
    out = mix.with_pair(out, noise_cell, mix.NOISE_LANE, "__z")
    noise = F.lit(0.5) * mix.normal_of(F.col("__z_x"), F.col("__z_z"))
    return out.withColumns(
        {
            "indices": F.col("__e.i"),
            "values": F.col("__e.v"),
            "label": array_sum(F.col("__e.v")) + noise,
        }
    ).drop("__e", "__z_x", "__z_z")


def batches(
    rows: DataFrame,
    n_rows_per_batch: int,
    n_cols: int,
    n_targets: int = 1,
    sparsity: float = 0.0,
    target_type: str = "reg",
    seed: int = 0,
) -> DataFrame:
    """Batched data: the same cells however the rows are cut into batches.

    Batch b starts at the cell count of the batches before it, which with a dense row id is the
    row id times the number of columns.
    """
    out = dense_rows(with_batches(rows, "row_id", n_rows_per_batch), n_cols, seed, sparsity)
    out = linear_labels(out, n_targets)
    if target_type == "bin":
        out = binary_labels(out)
    elif target_type != "reg":
        raise ValueError(f"unknown target type: {target_type}")
    return out


def as_stored(df: DataFrame) -> DataFrame:
    """Features and labels narrowed to FLOAT, the only type a stored matrix has."""
    return df.withColumns(
        {"features": F.col("features").cast("array<float>"), "labels": F.col("labels").cast("array<float>")}
    )


def datagen(
    rows: DataFrame,
    path: str,
    n_rows_per_batch: int,
    n_cols: int,
    n_shards: int = 1,
    n_targets: int = 1,
    sparsity: float = 0.0,
    target_type: str = "reg",
    seed: int = 0,
) -> None:
    """Generate all batches and store them striped."""
    from granary.sources.striped import write_striped

    data = batches(rows, n_rows_per_batch, n_cols, n_targets, sparsity, target_type, seed)
    write_striped(as_stored(data), path, n_shards)


def stored_bytes(df: DataFrame) -> DataFrame:
    """Cells and bytes of the features, at 4 bytes per cell."""
    n = F.sum(F.size("features")).alias("n_cells")
    return df.agg(n).withColumn("n_bytes", F.col("n_cells") * F.lit(4))


def source(
    spark: SparkSession,
    load_from: str | None,
    n_rows: int = 0,
    n_rows_per_batch: int = 1,
    n_cols: int = 1,
    **kwargs,
) -> DataFrame:
    """Stored data when a path is given, else the same columns generated on the fly."""
    from granary.sources.striped import read_striped

    if load_from:
        return read_striped(spark, load_from).drop("shard_idx")
    return as_stored(batches(row_range(spark, n_rows), n_rows_per_batch, n_cols, **kwargs))


