"""Date, distance and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import trip
from granary.plans import fixtures as fx
from granary.plans.registry import Tables, query, r6


@query(
    "date_parts",
    """
    SELECT event_id, CAST(hour(ts) AS INTEGER) AS "hour", CAST(year(ts) AS INTEGER) AS "year",
      CAST(month(ts) AS INTEGER) AS "month", CAST(day(ts) AS INTEGER) AS "day" FROM events
    """,
)
def _(t: Tables):
    return t.events.select("event_id", *[c.alias(n) for n, c in trip.date_parts(F.col("ts")).items()])


@query(
    "trip_duration",
    """
    SELECT l_orderkey, l_linenumber, CAST(epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS BIGINT) AS diff
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def _(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", trip.duration_ms(F.col("o_orderdate"), F.col("l_shipdate")).alias("diff")
    )


SNAPS = ("pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")


@query(
    "grid_snap",
    "SELECT trip_id, "
    + ", ".join(f"round(floor({c} / 0.01e0) * 0.01e0, 6) AS {c}_r" for c in SNAPS)
    + f" FROM ({fx.TRIPS_SQL})",
)
def _(t: Tables):
    return fx.trips(t).select("trip_id", *[r6(trip.grid_snap(F.col(c))).alias(f"{c}_r") for c in SNAPS])


HAVERSINE_SQL = """round(2 * 6371.0e0 * asin(sqrt(least(1.0e0,
  pow(sin((radians(dropoff_latitude) - radians(pickup_latitude)) / 2), 2)
  + cos(radians(pickup_latitude)) * cos(radians(dropoff_latitude))
  * pow(sin((radians(dropoff_longitude) - radians(pickup_longitude)) / 2), 2)))), 6)"""


@query("haversine", f"SELECT trip_id, {HAVERSINE_SQL} AS h_distance FROM ({fx.TRIPS_SQL})")
def _(t: Tables):
    return fx.trips(t).select("trip_id", r6(trip.haversine_km(*[F.col(c) for c in SNAPS])).alias("h_distance"))


def _legacy(ts: str) -> str:
    early = f"(CASE WHEN month({ts}) < 3 THEN 1 ELSE 0 END)"
    year = f"(year({ts}) - {early} - 2000)"
    raw = (
        f"(day({ts}) + floor((month({ts}) + {early} * month({ts}) + 1) * 2.6e0) + {year}"
        f" + floor({year} / 4.0e0) + 5 - 40)"
    )
    return f"CAST((({raw} % 7) + 7) % 7 AS INTEGER)"


def _calendar(ts: str) -> str:
    return f"CAST((dayofweek({ts}) + 1) % 7 AS INTEGER)"


@query(
    "day_of_week",
    f"""
    SELECT o_orderkey, {_calendar('o_orderdate')} AS calendar, {_legacy('o_orderdate')} AS legacy FROM orders
    """,
)
def _(t: Tables):
    return t.orders.select(
        "o_orderkey",
        trip.day_of_week(F.col("o_orderdate")).alias("calendar"),
        trip.day_of_week(F.col("o_orderdate"), "legacy").alias("legacy"),
    )


@query(
    "day_of_week_events",
    f"SELECT event_id, {_calendar('ts')} AS calendar, {_legacy('ts')} AS legacy FROM events",
)
def _(t: Tables):
    return t.events.select(
        "event_id",
        trip.day_of_week(F.col("ts")).alias("calendar"),
        trip.day_of_week(F.col("ts"), "legacy").alias("legacy"),
    )


@query(
    "is_weekend",
    f"""
    SELECT o_orderkey, CAST({_calendar('o_orderdate')} < 2 AS FLOAT) AS is_weekend,
      CAST({_legacy('o_orderdate')} < 2 AS FLOAT) AS is_weekend_legacy FROM orders
    """,
)
def _(t: Tables):
    return t.orders.select(
        "o_orderkey",
        trip.is_weekend(trip.day_of_week(F.col("o_orderdate"))).alias("is_weekend"),
        trip.is_weekend(trip.day_of_week(F.col("o_orderdate"), "legacy")).alias("is_weekend_legacy"),
    )


@query(
    "trip_features",
    f"""
    SELECT trip_id, fare_amount, pickup_latitude, pickup_longitude, dropoff_latitude, dropoff_longitude,
      CAST(hour(pickup_datetime) AS INTEGER) AS "hour", CAST(year(pickup_datetime) AS INTEGER) AS "year",
      CAST(month(pickup_datetime) AS INTEGER) AS "month", CAST(day(pickup_datetime) AS INTEGER) AS "day",
      CAST(epoch_ms(dropoff_datetime) - epoch_ms(pickup_datetime) AS BIGINT) AS diff,
      {", ".join(f"round(floor({c} / 0.01e0) * 0.01e0, 6) AS {c}_r" for c in SNAPS)},
      {HAVERSINE_SQL} AS h_distance, {_legacy('pickup_datetime')} AS day_of_week,
      CAST({_legacy('pickup_datetime')} < 2 AS FLOAT) AS is_weekend
    FROM ({fx.TRIPS_SQL})
    """,
)
def _(t: Tables):
    out = trip.trip_features(fx.trips(t), "legacy")
    rounded = {c: r6(F.col(c)) for c in [*[f"{c}_r" for c in SNAPS], "h_distance"]}
    return out.withColumns(rounded)


@query(
    "human_size",
    """
    SELECT doc_id, n_bytes, CASE WHEN n_bytes < 1024 THEN n_bytes || ' B'
      WHEN n_bytes < 1048576 THEN CAST(n_bytes / 1024.0e0 AS VARCHAR) || ' KB'
      WHEN n_bytes < 1073741824 THEN CAST(n_bytes / 1048576.0e0 AS VARCHAR) || ' MB'
      ELSE CAST(n_bytes / 1073741824.0e0 AS VARCHAR) || ' GB' END AS size
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 ELSE n_chars * 4000000 END
      AS n_bytes FROM documents)
    """,
)
def _(t: Tables):
    n = F.col("n_chars")
    scaled = (
        F.when(F.pmod("doc_id", F.lit(3)) == 0, n)
        .when(F.pmod("doc_id", F.lit(3)) == 1, n * F.lit(1000))
        .otherwise(n * F.lit(4000000))
    )
    sized = t.documents.select("doc_id", scaled.alias("n_bytes"))
    return sized.withColumn("size", trip.human_size(F.col("n_bytes")))


@query(
    "split_paths",
    """
    SELECT c_custkey, part.i - 1 AS position, part.p AS path FROM (
      SELECT c_custkey, unnest([{'i': 1, 'p': c_name}, {'i': 2, 'p': c_mktsegment}]) AS part FROM customer)
    """,
)
def _(t: Tables):
    lists = t.customer.select("c_custkey", F.concat_ws(",", "c_name", "c_mktsegment").alias("paths"))
    return lists.select("c_custkey", F.posexplode(trip.split_paths(F.col("paths"))).alias("position", "path"))
