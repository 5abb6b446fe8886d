"""Encoding and binning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import encode, quantile
from granary.plans.registry import Tables, query
from granary.plans import fixtures as fx


@query(
    "ordinal_encode",
    """
    WITH known AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM
      (SELECT DISTINCT p_type FROM part WHERE p_partkey % 3 <> 0 AND p_type <> 'SMALL')),
    brands AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM
      (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 3 <> 0 AND p_type <> 'SMALL'))
    SELECT CAST(k.code AS INTEGER) AS p_type, CAST(b.code AS INTEGER) AS p_brand, p.p_partkey, p.p_size
    FROM part p LEFT JOIN known k ON p.p_type = k.p_type LEFT JOIN brands b ON p.p_brand = b.p_brand
    """,
)
def _(t: Tables):
    """Codes learnt on part of the rows; a type unknown there becomes missing."""
    train = t.part.where((F.pmod("p_partkey", F.lit(3)) != 0) & (F.col("p_type") != "SMALL"))
    codes = encode.ordinal_fit(train, ["p_type", "p_brand"])
    return encode.ordinal_transform(t.part.select("p_partkey", "p_size", "p_type", "p_brand"), codes)


@query(
    "ordinal_encode_customer",
    """
    SELECT c_custkey, c_acctbal, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment,
      CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name FROM customer
    """,
)
def _(t: Tables):
    """A dictionary with one entry per row, ranked on the path that large dictionaries take."""
    df = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    codes = {"c_mktsegment": encode.dictionary(df, "c_mktsegment"), "c_name": encode.dictionary(df, "c_name", 8)}
    return encode.ordinal_transform(df, codes)


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "onehot_encode",
    "SELECT p_partkey, p_size, "
    + ", ".join(f"CASE WHEN p_type = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS \"p_type={v}\"" for v in TYPES)
    + " FROM part",
)
def _(t: Tables):
    df = t.part.select("p_partkey", "p_type", "p_size")
    return encode.onehot_transform(df, encode.onehot_fit(df, ["p_type"]))


@query(
    "onehot_sparse",
    """
    SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS position, 1.0e0 AS hot FROM part
    """,
)
def _(t: Tables):
    df = t.part.select("p_partkey", "p_brand")
    out = encode.onehot_sparse(df, encode.dictionary(df, "p_brand"), "p_brand", "onehot")
    return out.select("p_partkey", F.explode("onehot").alias("position", "hot"))


FEATURES = ("l_quantity", "l_discount", "l_tax", "o_totalprice")
CELLS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM src" for c in FEATURES)


def cuts_sql(source: str, bins: int = 16) -> str:
    """Distinct discrete quantiles of each feature of ``source``."""
    return f"""
    WITH src AS ({source}), cells AS (SELECT * FROM ({CELLS_SQL}) WHERE value IS NOT NULL),
    ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS pos,
      count(*) OVER (PARTITION BY feature) AS n FROM cells)
    SELECT DISTINCT feature, value AS cut FROM ranked, (SELECT unnest(range(1, {bins})) AS k)
    WHERE pos = (k * n + {bins - 1}) // {bins}
    """


@query("quantile_cuts", cuts_sql(fx.ENRICHED_SQL))
def _(t: Tables):
    cuts = quantile.exact_cuts(fx.enriched(t), FEATURES, 16)
    return cuts.select("feature", F.explode("cuts").alias("cut"))


@query("quantile_cuts_bucketed", cuts_sql(fx.ENRICHED_SQL))
def _(t: Tables):
    cuts = quantile.exact_cuts(fx.enriched(t), FEATURES, 16, n_buckets=8)
    return cuts.select("feature", F.explode("cuts").alias("cut"))


@query("quantile_cuts_approx")
def _(t: Tables):
    cuts = quantile.approx_cuts(fx.enriched(t), FEATURES, 256)
    return cuts.select("feature", F.posexplode("cuts").alias("position", "cut"))


def binned_sql(rows: str, source: str, bins: int = 16) -> str:
    cols = ", ".join(
        f"CAST(CASE WHEN {c} IS NULL THEN -1 ELSE (SELECT count(*) FROM cuts WHERE feature = '{c}' AND cut <= {c}) END"
        f" AS SMALLINT) AS {c}_bin"
        for c in FEATURES
    )
    return f"WITH cuts AS ({cuts_sql(source, bins)}) SELECT l_orderkey, l_linenumber, {cols} FROM ({rows})"


def _bins(train, rows, bins=16):
    cuts = quantile.collect_cuts(quantile.exact_cuts(train, FEATURES, bins), FEATURES)
    return quantile.apply_cuts(rows, cuts).select("l_orderkey", "l_linenumber", *[f"{c}_bin" for c in FEATURES])


@query("quantile_bin", binned_sql(fx.ENRICHED_SQL, fx.ENRICHED_SQL))
def _(t: Tables):
    return _bins(fx.enriched(t), fx.enriched(t))


@query(
    "quantile_bin_ref",
    binned_sql(
        f"SELECT * FROM ({fx.ENRICHED_SQL}) WHERE day(l_shipdate) >= 25",
        f"SELECT * FROM ({fx.ENRICHED_SQL}) WHERE day(l_shipdate) < 25",
    ),
)
def _(t: Tables):
    """Validation rows binned with the cuts of the training rows."""
    df = fx.enriched(t)
    day = F.dayofmonth("l_shipdate")
    return _bins(df.where(day < 25), df.where(day >= 25))
