"""Cleaning, filters and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import clean
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6
from granary.sources.datasets import clean_trips as clean_trip_table
from granary.sources.datasets import mortgage_table


def messy_trips(t: Tables):
    """Orders as a raw trip file: odd names, text where numbers belong, unreadable and absent values."""
    k = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.orders.select(
        F.when(F.pmod(k, F.lit(11)) != 0, stamp).alias(" tpep_Pickup_datetime"),
        F.when(F.pmod(k, F.lit(9)) == 0, "unknown").otherwise(stamp).alias("tpep_dropoff_datetime "),
        F.pmod(k, F.lit(7)).alias("Passenger_Count"),
        F.when(F.pmod(k, F.lit(8)) == 0, "n/a").otherwise((k / F.lit(4)).cast("string")).alias(" trip_distance"),
        F.when(F.pmod(k, F.lit(5)) != 0, F.lit(-74.5)).alias("pickup_longitude"),
        F.lit(40.5).alias("pickup_latitude"),
        F.when(F.pmod(k, F.lit(3)) != 0, F.pmod(k, F.lit(6))).alias("RateCodeID"),
        F.lit(-74.25).alias("dropoff_longitude"),
        F.lit(41.0).alias("dropoff_latitude"),
        F.col("o_totalprice").alias("Fare_Amount"),
        F.col("o_orderpriority").alias("vendor"),
    )


@query(
    "clean_trips",
    """
    SELECT CAST(CASE WHEN o_orderkey % 11 <> 0 THEN epoch_ms(o_orderdate) END AS BIGINT) AS pickup_ms,
      CAST(CASE WHEN o_orderkey % 9 <> 0 THEN epoch_ms(o_orderdate) END AS BIGINT) AS dropoff_ms,
      CAST(o_orderkey % 7 AS INTEGER) AS passenger_count,
      CAST(CASE WHEN o_orderkey % 8 = 0 THEN -1 ELSE o_orderkey / 4.0e0 END AS FLOAT) AS trip_distance,
      CAST(CASE WHEN o_orderkey % 5 <> 0 THEN -74.5 ELSE -1 END AS FLOAT) AS pickup_longitude,
      CAST(40.5 AS FLOAT) AS pickup_latitude,
      CAST(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 6 ELSE -1 END AS INTEGER) AS rate_code,
      CAST(-74.25 AS FLOAT) AS dropoff_longitude, CAST(41 AS FLOAT) AS dropoff_latitude,
      CAST(o_totalprice AS FLOAT) AS fare_amount
    FROM orders
    """,
)
def _(t: Tables):
    out = clean_trip_table(messy_trips(t))
    return out.select(
        F.unix_millis("pickup_datetime").alias("pickup_ms"),
        F.unix_millis("dropoff_datetime").alias("dropoff_ms"),
        *[c for c in out.columns if not c.endswith("datetime")],
    )


@query(
    "coerce_types",
    """
    SELECT event_id, CAST(user_id AS INTEGER) AS user_id, CAST(value AS FLOAT) AS value,
      CAST(TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS FLOAT) AS props, CAST(NULL AS FLOAT) AS event_type
    FROM events
    """,
)
def _(t: Tables):
    raw = t.events.withColumn("props", F.regexp_extract("props", "[0-9]+", 0)).drop("ts")
    return clean.coerce(
        raw, T.StructType.fromDDL("event_id BIGINT, user_id INT, value FLOAT, props FLOAT, event_type FLOAT")
    )


@query(
    "fill_missing",
    f"""
    SELECT l_orderkey, l_quantity, coalesce(o_totalprice, -1) AS o_totalprice,
      coalesce(o_orderpriority, '-1') AS o_orderpriority
    FROM ({fx.ENRICHED_SQL})
    """,
)
def _(t: Tables):
    return clean.fill_missing(fx.enriched(t).select("l_orderkey", "l_quantity", "o_totalprice", "o_orderpriority"))


@query(
    "outlier_filter",
    """
    SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_extendedprice FROM lineitem
    WHERE l_quantity > 5 AND l_quantity < 45 AND l_discount > 0.01 AND l_discount < 0.09 AND l_extendedprice > 1000
    """,
)
def _(t: Tables):
    kept = clean.between_open(
        t.lineitem, {"l_quantity": (5, 45), "l_discount": (0.01, 0.09), "l_extendedprice": (1000, None)}
    )
    return kept.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")


@query(
    "split_label",
    "SELECT l_discount, l_orderkey, l_quantity, l_tax, l_extendedprice AS label FROM lineitem",
)
def _(t: Tables):
    df = t.lineitem.select("l_tax", "l_quantity", "l_orderkey", "l_discount", F.col("l_extendedprice").alias("label"))
    return clean.features_then_label(df, "label")


@query(
    "split_label_at",
    """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal AS label FROM supplier
    """,
)
def _(t: Tables):
    features, label = clean.split_label_at(t.supplier, -1)
    return t.supplier.select(*features.columns, F.col(label.columns[0]).alias("label"))


@query(
    "dates_to_day",
    """
    SELECT l_orderkey, l_linenumber, CAST(day(l_shipdate) AS INTEGER) AS l_shipdate, l_returnflag FROM lineitem
    """,
)
def _(t: Tables):
    return clean.dates_to_day(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"))


@query("binarise_label", "SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS label FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", clean.binarise(F.col("c_acctbal")).alias("label"))


@query("clip_label", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 0 ELSE c_acctbal END AS label FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", clean.clip_nonpositive(F.col("c_acctbal")).alias("label"))


@query(
    "minmax_label",
    """
    SELECT l_orderkey, round((l_extendedprice - lo) / (hi - lo), 6) AS label
    FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    """,
)
def _(t: Tables):
    scaled = clean.minmax(t.lineitem.select("l_orderkey", "l_extendedprice"), "l_extendedprice", "label")
    return scaled.select("l_orderkey", r6("label").alias("label"))


@query(
    "label_codes",
    """
    SELECT c_custkey, CAST(CASE WHEN c_mktsegment IS NULL THEN -1
      ELSE dense_rank() OVER (ORDER BY c_mktsegment NULLS LAST) - 1 END AS INTEGER) AS label
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment END AS c_mktsegment FROM customer)
    """,
)
def _(t: Tables):
    df = t.customer.select(
        "c_custkey", F.when(F.pmod("c_custkey", F.lit(10)) != 3, F.col("c_mktsegment")).alias("c_mktsegment")
    )
    return clean.label_codes(df, "c_mktsegment", "label").select("c_custkey", "label")


@query(
    "categorical_mask",
    """
    SELECT * FROM (
      SELECT 0 AS position, 'p_partkey' AS column_name, FALSE AS is_categorical, count(p_partkey) AS n_values FROM part
      UNION ALL SELECT 1, 'p_name', TRUE, count(p_name) FROM part
      UNION ALL SELECT 2, 'p_brand', TRUE, count(p_brand) FROM part
      UNION ALL SELECT 3, 'p_type', TRUE, count(p_type) FROM part
      UNION ALL SELECT 4, 'p_size', FALSE, count(p_size) FROM part
      UNION ALL SELECT 5, 'p_retailprice', FALSE, count(p_retailprice) FROM part)
    """,
)
def _(t: Tables):
    return clean.categorical_mask(t.part)


@query(
    "select_kind",
    "SELECT p_brand, p_name, p_type FROM part",
)
def _(t: Tables):
    return clean.select_kind(t.part, "category")


@query("preview", "SELECT * EXCLUDE (o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t: Tables):
    return clean.preview(t.orders.drop("o_orderdate"), 5, "o_orderkey")


MORTGAGE_SQL = f"""
    WITH perf AS ({fx.PERF_SQL}), acq AS ({fx.ACQ_SQL}),
    ends AS (SELECT min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM perf)
    SELECT p.loan_id, p.l_partkey, p.l_suppkey, p.l_quantity, p.l_extendedprice, p.l_discount, p.l_tax,
      p.l_returnflag, p.l_linestatus, CAST(day(p.l_shipdate) AS INTEGER) AS l_shipdate,
      a.o_custkey, a.o_orderstatus, a.o_totalprice, CAST(day(a.o_orderdate) AS INTEGER) AS o_orderdate,
      a.o_orderpriority, (p.l_linenumber - e.lo) / CAST(e.hi - e.lo AS DOUBLE) AS l_linenumber
    FROM perf p LEFT JOIN acq a ON p.loan_id = a.loan_id, ends e
    """


@query("mortgage_join", MORTGAGE_SQL)
def mortgage_join(t: Tables):
    """Join, date reduction, label scaling and sorted features in one lazy plan."""
    return mortgage_table(fx.perf(t), fx.acq(t), "l_linenumber")
