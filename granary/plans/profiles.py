"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import profile
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6


@query(
    "profile",
    f"""
    WITH b AS (SELECT l_suppkey % 8 AS batch, count(*) AS n, CAST(sum(CAST(l_quantity IS NOT NULL AS INTEGER)
        + CAST(l_discount IS NOT NULL AS INTEGER) + CAST(o_totalprice IS NOT NULL AS INTEGER)) AS BIGINT) AS nz
      FROM ({fx.ENRICHED_SQL}) GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(nz) AS BIGINT) AS n_nonmissing, count(*) AS n_batches,
      min(n) AS min_rows_per_batch, max(n) AS max_rows_per_batch, round(avg(n), 6) AS avg_rows_per_batch,
      3 AS n_features, 1 AS n_targets, round(sum(nz) / (sum(n) * 3.0e0), 6) AS density,
      round(1 - sum(nz) / (sum(n) * 3.0e0), 6) AS sparsity FROM b
    """,
)
def _(t: Tables):
    df = fx.enriched(t).withColumn("batch", F.pmod("l_suppkey", F.lit(8)))
    out = profile.profile(df, ["l_quantity", "l_discount", "o_totalprice"], batch="batch")
    return out.withColumns({c: r6(F.col(c)) for c in ("avg_rows_per_batch", "density", "sparsity")})


@query(
    "class_balance",
    """
    SELECT count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative,
      count(*) AS n_rows FROM labels
    """,
)
def _(t: Tables):
    return profile.class_balance(t.labels, "quality")


def _cat_sql(columns: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS cardinality, count(*) - count({c}) AS n_missing, "
        f"'{k}' AS kind, count(*) > count({c}) AS has_missing FROM {table}"
        for c, k in columns.items()
    )


@query(
    "categorical_profile",
    _cat_sql(
        {"p_partkey": "number", "p_name": "category", "p_brand": "category", "p_type": "category", "p_size": "number",
         "p_retailprice": "number"},
        "part",
    )
    + " UNION ALL "
    + _cat_sql(
        {"c_custkey": "number", "c_name": "category", "c_nationkey": "number", "c_acctbal": "number",
         "c_mktsegment": "category"},
        "(SELECT * REPLACE (CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment) FROM customer)",
    ),
)
def _(t: Tables):
    customer = t.customer.withColumn(
        "c_mktsegment", F.when(F.pmod("c_custkey", F.lit(4)) != 0, F.col("c_mktsegment"))
    )
    return profile.categorical_profile(t.part).unionByName(profile.categorical_profile(customer))


@query("categorical_profile_approx")
def _(t: Tables):
    return profile.categorical_profile(t.lineitem.drop("l_shipdate"), approximate=True)


@query(
    "row_sum",
    f"""
    SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + coalesce(o_totalprice, 0), 6) AS total,
      round(0.5e0 * l_quantity + 2 * l_discount - coalesce(o_totalprice, 0), 6) AS weighted
    FROM ({fx.ENRICHED_SQL})
    """,
)
def _(t: Tables):
    columns = ["l_quantity", "l_discount", "o_totalprice"]
    return fx.enriched(t).select(
        "l_orderkey",
        "l_linenumber",
        r6(profile.row_sum(columns)).alias("total"),
        r6(profile.row_sum(columns, [0.5, 2.0, -1.0])).alias("weighted"),
    )


@query(
    "embedding_sum",
    "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
)
def _(t: Tables):
    return t.embeddings.select("vec_id", r6(profile.array_sum(F.col("embedding"))).alias("total"))


@query(
    "uniqueness",
    """
    SELECT count(DISTINCT l_extendedprice) AS n_distinct, count(l_extendedprice) AS n_values,
      count(DISTINCT l_extendedprice) / CAST(count(l_extendedprice) AS DOUBLE) AS ratio FROM lineitem
    """,
)
def _(t: Tables):
    return profile.uniqueness(t.lineitem, "l_extendedprice")
