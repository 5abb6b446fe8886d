"""Queries that write tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6
from granary.session import scratch_path
from granary.sources import datasets, files, striped

STORED_BATCH = 4000
STRIPED_COLUMNS = ("event_id", "batch_idx", "row_in_batch", "value")


STORED_SQL = (
    f"SELECT event_id, event_id // {STORED_BATCH} AS batch_idx, event_id % {STORED_BATCH} AS row_in_batch, value FROM events"
)


def striped_events(t: Tables, n_shards: int = 3) -> str:
    path = scratch_path(t.spark, "striped")
    striped.write_striped(fx.event_batches(t, STORED_BATCH).select(*STRIPED_COLUMNS), path, n_shards)
    return path


@query(
    "stripe_roundtrip",
    f"""
    SELECT event_id, batch_idx, row_in_batch, value,
      row_in_batch // ((count(*) OVER (PARTITION BY batch_idx) + 2) // 3) AS shard_idx
    FROM ({STORED_SQL})
    """,
)
def _(t: Tables):
    return striped.read_striped(t.spark, striped_events(t))


@query(
    "range_read",
    f"""
    SELECT event_id, batch_idx, row_in_batch, value FROM (
      SELECT *, count(*) OVER (PARTITION BY batch_idx) AS n FROM ({STORED_SQL}))
    WHERE row_in_batch >= CAST(trunc(n * 0.25e0) AS BIGINT) AND row_in_batch < CAST(trunc(n * 0.5e0) AS BIGINT)
    """,
)
def _(t: Tables):
    """The second quarter of every batch, in one scan of the stored table."""
    out = striped.range_of_each(t.spark, striped_events(t), 0.25, 0.5)
    return out.select(*STRIPED_COLUMNS)


@query(
    "load_all",
    STORED_SQL,
)
def _(t: Tables):
    """Two stored sets with disjoint batches read as one table."""
    b = fx.event_batches(t, STORED_BATCH).select(*STRIPED_COLUMNS)
    paths = []
    for parity in (0, 1):
        path = scratch_path(t.spark, "half")
        striped.write_striped(b.where(F.pmod("batch_idx", F.lit(2)) == parity), path, 2)
        paths.append(path)
    return striped.load_all(t.spark, paths).select(*STRIPED_COLUMNS)


LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP"
)


@query("csv_scan", "SELECT * EXCLUDE (l_shipdate), CAST(day(l_shipdate) AS INTEGER) AS ship_day FROM lineitem")
def _(t: Tables):
    path = scratch_path(t.spark, "csv")
    t.lineitem.write.option("sep", "|").option("header", True).csv(path)
    out = files.read_delimited(t.spark, path, LINEITEM, sep="|", header=True)
    return out.withColumn("ship_day", F.dayofmonth("l_shipdate")).drop("l_shipdate")


@query(
    "read_dir",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def _(t: Tables):
    path = scratch_path(t.spark, "dir")
    e = t.events.select("event_id", "user_id", "event_type", "value")
    e.withColumn("kind", F.col("event_type")).write.option("sep", "|").option("header", True).partitionBy("kind").csv(path)
    return files.read_dir(t.spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE")


@query("csv_gzip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables):
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    paths = []
    for codec, parity in (("gzip", 0), ("bzip2", 1)):
        path = scratch_path(t.spark, codec)
        half = t.orders.select(*columns).where(F.pmod("o_orderkey", F.lit(2)) == parity)
        half.write.option("compression", codec).csv(path)
        paths.append(path)
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"
    return files.read_compressed(t.spark, paths, schema)


@query(
    "etl_cache",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY 1, 2
    """,
)
def _(t: Tables):
    """The second call must find the table of the first and not build again."""
    path = scratch_path(t.spark, "cache")

    def build():
        return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
            F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n")
        )

    def refuse():
        raise AssertionError("the cached table was not found")

    files.cached_table(t.spark, path, build)
    return files.cached_table(t.spark, path, refuse)


@query(
    "libsvm_roundtrip",
    """
    SELECT label, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first,
      round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS total
    FROM (SELECT CAST(label AS DOUBLE) AS label, embedding FROM embeddings) GROUP BY 1
    """,
)
def _(t: Tables):
    from granary.operators.profile import array_sum

    paths = []
    for parity in (0, 1):
        path = scratch_path(t.spark, "libsvm")
        files.write_libsvm(t.embeddings.where(F.pmod("vec_id", F.lit(2)) == parity), path, "label", "embedding")
        paths.append(path)
    rows = files.libsvm_arrays(files.read_libsvm(t.spark, paths, 64))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.get("features", F.lit(0))), 4).alias("first"),
        F.round(F.sum(array_sum(F.col("features"))), 4).alias("total"),
    )


def mortgage_files(t: Tables) -> str:
    """Line items and orders written as loan files in the pipe-separated layout."""
    root = scratch_path(t.spark, "loans")
    known = {
        "perf": (
            datasets.PERFORMANCE,
            fx.perf(t),
            {
                "loan_id": "loan_id",
                "monthly_reporting_period": "l_shipdate",
                "servicer": "l_returnflag",
                "interest_rate": "l_discount",
                "current_actual_upb": "l_quantity",
                "current_loan_delinquency_status": "l_linenumber",
            },
        ),
        "acq": (
            datasets.ACQUISITION,
            fx.acq(t),
            {"loan_id": "loan_id", "orig_channel": "o_orderstatus", "orig_upb": "o_custkey", "orig_date": "o_orderdate"},
        ),
    }
    from pyspark.sql import types as T

    for part, (ddl, df, columns) in known.items():
        schema = T.StructType.fromDDL(ddl)
        out = df.select(
            *[
                (F.col(columns[f.name]) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ]
        )
        out.write.option("sep", "|").option("header", True).csv(f"{root}/{part}")
    return root


def trip_files(t: Tables) -> str:
    """Trips written with the column names of a later year, as comma-separated text."""
    path = scratch_path(t.spark, "trips")
    k = F.col("trip_id")
    fx.trips(t).select(
        F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss").alias(" tpep_pickup_datetime"),
        F.date_format("dropoff_datetime", "yyyy-MM-dd HH:mm:ss").alias("tpep_dropoff_datetime"),
        F.pmod(k, F.lit(8)).alias("passenger_count"),
        F.pmod(k, F.lit(50)).alias("trip_distance"),
        "pickup_longitude",
        "pickup_latitude",
        F.pmod(k, F.lit(6)).alias("RateCodeID"),
        "dropoff_longitude",
        "dropoff_latitude",
        (F.col("fare_amount") / F.lit(400)).alias("fare_amount"),
        F.lit("x").alias("store_and_fwd_flag"),
    ).write.option("header", True).csv(path)
    return path


@query(
    "dataset_registry",
    f"""
    WITH perf AS ({fx.PERF_SQL}),
    ends AS (SELECT min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM perf),
    trips AS (SELECT *, CAST(fare_amount / 400 AS FLOAT) AS fare, trip_id % 8 AS people,
      CAST(pickup_latitude AS FLOAT) AS la1, CAST(pickup_longitude AS FLOAT) AS lo1,
      CAST(dropoff_latitude AS FLOAT) AS la2, CAST(dropoff_longitude AS FLOAT) AS lo2 FROM ({fx.TRIPS_SQL}))
    SELECT 'mortgage' AS name, 'binary:logistic' AS task, count(*) AS n_rows, 55 AS n_features,
      round(sum((l_linenumber - lo) / CAST(hi - lo AS DOUBLE)), 3) AS label_sum FROM perf, ends
    UNION ALL SELECT 'taxi', 'reg:squarederror', count(*), 19, round(sum(CAST(fare AS DOUBLE)), 3) FROM trips
    WHERE fare > 0 AND fare < 500 AND people > 0 AND people < 6 AND lo1 > -75 AND lo1 < -73 AND lo2 > -75 AND lo2 < -73
      AND la1 > 40 AND la1 < 42 AND la2 > 40 AND la2 < 42
    """,
)
def _(t: Tables):
    out = None
    for name, path in (("mortgage", mortgage_files(t)), ("taxi", trip_files(t))):
        df, task = datasets.dataset(t.spark, name, path)
        label = datasets.REGISTRY[name].label
        one = df.agg(
            F.lit(name).alias("name"),
            F.lit(task).alias("task"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len([c for c in df.columns if c not in (label, "part")])).alias("n_features"),
            F.round(F.sum(F.col(label).cast("double")), 3).alias("label_sum"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dataset_mortgage",
    f"""
    WITH perf AS ({fx.PERF_SQL}), acq AS ({fx.ACQ_SQL}),
    ends AS (SELECT min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM perf)
    SELECT p.loan_id, CAST(day(p.l_shipdate) AS INTEGER) AS monthly_reporting_period, p.l_returnflag AS servicer,
      round(CAST(CAST(p.l_discount AS FLOAT) AS DOUBLE), 6) AS interest_rate,
      round(CAST(CAST(p.l_quantity AS FLOAT) AS DOUBLE), 6) AS current_actual_upb,
      a.o_orderstatus AS orig_channel, a.o_custkey AS orig_upb, CAST(day(a.o_orderdate) AS INTEGER) AS orig_date,
      (p.l_linenumber - lo) / CAST(hi - lo AS DOUBLE) AS label
    FROM perf p LEFT JOIN acq a ON p.loan_id = a.loan_id, ends
    """,
)
def _(t: Tables):
    df, _task = datasets.dataset(t.spark, "mortgage", mortgage_files(t))
    return df.select(
        "loan_id",
        "monthly_reporting_period",
        "servicer",
        r6(F.col("interest_rate").cast("double")).alias("interest_rate"),
        r6(F.col("current_actual_upb").cast("double")).alias("current_actual_upb"),
        "orig_channel",
        "orig_upb",
        "orig_date",
        F.col(datasets.MORTGAGE_LABEL).alias("label"),
    )
