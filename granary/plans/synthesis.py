"""Queries that generate data for the row ids of a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import mix
from granary.plans.registry import Tables, query, r6
from granary.session import scratch_path
from granary.sources import striped, synth
from granary.operators.relate import bag_difference

COLS = 8
P = mix.MODULUS


def rows(t: Tables):
    """Row ids of the orders: the generated data grows with the table."""
    return t.orders.select(F.col("o_orderkey").alias("row_id"))


def pair_sql(source: str, cell: str, lane: int, tag: str) -> str:
    """SQL for the scrambled pair ``{tag}x, {tag}z`` of the cell number, added to ``source``."""
    x, z = f"{tag}x", f"{tag}z"
    sql = (
        f"SELECT *, (({cell}) % {P} + ({cell}) // {P} * {mix.MUL_A} + {lane * mix.LANE_X + 11}) % {P} AS {x}, "
        f"(({cell}) % {P} * {mix.MUL_B} + ({cell}) // {P} * {mix.MUL_C} + {(lane + 1) * mix.LANE_Z}) % {P} AS {z} "
        f"FROM ({source})"
    )
    for a, b in mix.ROUNDS:
        sql = (
            f"SELECT * REPLACE (({x} * {x} % {P} * {a} + {z} + 13) % {P} AS {x}, "
            f"({z} * {z} % {P} * {b} + {x} + 7) % {P} AS {z}) FROM ({sql})"
        )
    return sql


def normal_sql(tag: str) -> str:
    return (
        f"(sqrt(-2.0e0 * ln(({tag}x + 1) / 2147483648.0e0)) "
        f"* cos(6.283185307179586e0 * ({tag}z + 1) / 2147483648.0e0))"
    )


def cells_sql(n_cols: int = COLS, seed: int = 0) -> str:
    base = f"SELECT o_orderkey AS row_id, CAST(unnest(range({n_cols})) AS INTEGER) AS col_idx FROM orders"
    cell = f"(row_id * {n_cols} + col_idx + {seed})"
    return pair_sql(pair_sql(base, cell, mix.VALUE_LANE, "v"), cell, mix.MASK_LANE, "m")


VALUE = f"1.5e0 * {normal_sql('v')}"
GONE = f"mx / {float(P)!r}e0 < 0.3e0".replace("e0e0", "e0")
COEF = mix.target_coefficients(3)


@query("gen_dense_cells", f"SELECT row_id, col_idx, round({VALUE}, 6) AS value FROM ({cells_sql(seed=7)})")
def _(t: Tables):
    return synth.dense_cells(rows(t), COLS, seed=7).withColumn("value", r6("value"))


@query(
    "gen_missing",
    f"SELECT row_id, col_idx, round(CASE WHEN NOT {GONE} THEN {VALUE} END, 6) AS value FROM ({cells_sql()})",
)
def _(t: Tables):
    return synth.dense_cells(rows(t), COLS, sparsity=0.3).withColumn("value", r6("value"))


@query(
    "gen_missing_coupled",
    f"""
    SELECT row_id, col_idx, round(CASE WHEN NOT {GONE.replace('mx', 'vx')} THEN {VALUE} END, 6) AS value
    FROM ({cells_sql()})
    """,
)
def _(t: Tables):
    return synth.dense_cells(rows(t), COLS, sparsity=0.3, mask="coupled").withColumn("value", r6("value"))


@query(
    "gen_labels",
    f"SELECT row_id, round({COEF[0]!r}e0 * sum({VALUE}), 6) AS label FROM ({cells_sql()}) GROUP BY 1",
)
def _(t: Tables):
    out = synth.linear_labels(synth.dense_rows(rows(t), COLS))
    return out.select("row_id", r6(F.get("labels", F.lit(0))).alias("label"))


@query(
    "gen_labels_multi",
    "SELECT row_id, "
    + ", ".join(
        f"round({c!r}e0 * coalesce(sum(CASE WHEN NOT {GONE} THEN {VALUE} END), 0) + 0.0e0, 6) AS y{i}" for i, c in enumerate(COEF)
    )
    + f" FROM ({cells_sql()}) GROUP BY 1",
)
def _(t: Tables):
    out = synth.linear_labels(synth.dense_rows(rows(t), COLS, sparsity=0.3), 3)
    return out.select("row_id", *[r6(F.get("labels", F.lit(i))).alias(f"y{i}") for i in range(3)])


@query(
    "gen_binary",
    f"""
    SELECT row_id, CASE WHEN {COEF[0]!r}e0 * sum({VALUE}) > 0 THEN 1.0e0 ELSE 0.0e0 END AS label
    FROM ({cells_sql()}) GROUP BY 1
    """,
)
def _(t: Tables):
    out = synth.binary_labels(synth.linear_labels(synth.dense_rows(rows(t), COLS)))
    return out.select("row_id", F.get("labels", F.lit(0)).alias("label"))


SPARSE_SQL = f"""SELECT *, vx / {float(P)!r}e0 AS value FROM ({cells_sql(16)})
  WHERE mx / {float(P)!r}e0 >= 0.6e0""".replace("e0e0", "e0")


@query("gen_sparse", f"SELECT row_id, col_idx, round(value, 6) AS value FROM ({SPARSE_SQL})")
def _(t: Tables):
    return synth.sparse_cells(rows(t), 16, 0.6).withColumn("value", r6("value"))


@query(
    "gen_sparse_rows",
    f"""
    WITH c AS (SELECT row_id, count(*) AS nnz, sum(value) AS total FROM ({SPARSE_SQL}) GROUP BY 1)
    SELECT row_id, coalesce(nnz, 0) AS nnz, round(coalesce(total, 0) + 0.5e0 * {normal_sql('n')}, 6) AS label
    FROM ({pair_sql('SELECT o_orderkey AS row_id FROM orders', 'row_id', mix.NOISE_LANE, 'n')}) LEFT JOIN c USING (row_id)
    """,
)
def _(t: Tables):
    out = synth.sparse_rows(rows(t), 16, 0.6)
    return out.select("row_id", F.size("indices").cast("bigint").alias("nnz"), r6("label").alias("label"))


def _first_last(df):
    return df.select(
        "row_id",
        "batch_idx",
        "row_in_batch",
        *[r6(F.get("features", F.lit(i))).alias(f"f{i}") for i in (0, COLS - 1)],
        r6(F.get("labels", F.lit(0))).alias("label"),
    )


@query(
    "gen_batches",
    f"""
    SELECT row_id, row_id // 1024 AS batch_idx, row_id % 1024 AS row_in_batch,
      round(sum(CASE WHEN col_idx = 0 THEN {VALUE} END), 6) AS f0,
      round(sum(CASE WHEN col_idx = {COLS - 1} THEN {VALUE} END), 6) AS f{COLS - 1},
      round({COEF[0]!r}e0 * sum({VALUE}), 6) AS label FROM ({cells_sql()}) GROUP BY 1
    """,
)
def _(t: Tables):
    return _first_last(synth.batches(rows(t), 1024, COLS))


@query(
    "gen_batch_invariance",
    f"SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, TRUE AS equal, count(DISTINCT row_id) AS n_rows, "
    f"round(sum({VALUE}), 3) AS total FROM ({cells_sql()})",
)
def _(t: Tables):
    """Batches of 1024 and of 2048 rows hold the same cells and labels; with the number of rows and the sum of all cells."""
    from granary.operators.profile import array_sum

    a = synth.batches(rows(t), 1024, COLS, n_targets=3).select("row_id", "features", "labels")
    b = synth.batches(rows(t), 2048, COLS, n_targets=3).select("row_id", "features", "labels")
    sums = {"n_rows": F.lit(1).cast("long"), "total": array_sum(F.col("features"))}
    return bag_difference(a, b, sums).withColumn("total", F.round("total", 3))


@query(
    "datagen_roundtrip",
    f"""
    WITH c AS (SELECT row_id, row_id // 2048 AS batch_idx, sum(CAST({VALUE} AS FLOAT)) AS total,
      count(*) AS n FROM ({cells_sql()}) GROUP BY 1),
    r AS (SELECT *, row_id % 2048 // ((count(*) OVER (PARTITION BY batch_idx) + 1) // 2) AS shard_idx FROM c)
    SELECT batch_idx, shard_idx, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(n) * 4 AS BIGINT) AS n_bytes,
      round(sum(total), 3) AS total FROM r GROUP BY 1, 2
    """,
)
def _(t: Tables):
    path = scratch_path(t.spark, "datagen")
    synth.datagen(rows(t), path, 2048, COLS, n_shards=2)
    stored = striped.read_striped(t.spark, path)
    from granary.operators.profile import array_sum

    return stored.groupBy("batch_idx", "shard_idx").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("features")).alias("n_cells"),
        (F.sum(F.size("features")) * F.lit(4)).alias("n_bytes"),
        F.round(F.sum(array_sum(F.col("features"))), 3).alias("total"),
    )


@query(
    "source_equivalence",
    "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, TRUE AS equal, count(*) AS n_rows FROM orders",
)
def _(t: Tables):
    """Stored and on-the-fly data are the same bag of rows; with the number of stored rows."""
    n = t.orders.count()
    args = dict(n_rows_per_batch=1024, n_cols=COLS, sparsity=0.1)
    path = scratch_path(t.spark, "source")
    synth.datagen(rows(t), path, n_shards=3, **args)
    stored = synth.source(t.spark, path)
    fly = synth.source(t.spark, None, n_rows=n, **args)
    return bag_difference(stored.select(*fly.columns), fly, {"n_rows": F.lit(1).cast("long")})
