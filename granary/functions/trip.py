"""Date, distance and text expressions. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
GRID = 0.01


def date_parts(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}


def duration_ms(begin: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, as BIGINT so that long spans do not wrap."""
    return F.unix_millis(end) - F.unix_millis(begin)


def grid_snap(x: Column, step: float = GRID) -> Column:
    """Lower edge of the grid cell holding ``x`` (rounds toward minus infinity)."""
    return F.floor(x.cast("double") / F.lit(step)).cast("double") * F.lit(step)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is held at 1 against rounding."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / F.lit(2.0)
    half_lon = (F.radians(lon2) - F.radians(lon1)) / F.lit(2.0)
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def day_of_week(ts: Column, mode: str = "calendar") -> Column:
    """Day number with Saturday as 0 and Sunday as 1.

    ``mode="legacy"`` is the congruence the original data was prepared with. It agrees with the
    calendar from March to December, is one day behind in January and two ahead in February.
    """
    if mode == "calendar":
        return F.pmod(F.dayofweek(ts), F.lit(7))
    if mode != "legacy":
        raise ValueError(f"unknown mode: {mode}")
    month, early = F.month(ts), F.month(ts) < 3
    term = month + F.when(early, month).otherwise(F.lit(0)) + F.lit(1)
    year = F.year(ts) - F.when(early, F.lit(1)).otherwise(F.lit(0)) - F.lit(2000)
    days = F.dayofmonth(ts) + F.floor(term * F.lit(2.6)) + year + F.floor(year / F.lit(4)) - F.lit(35)
    return F.pmod(days, F.lit(7)).cast("int")


def is_weekend(dow: Column) -> Column:
    return (dow < 2).cast("float")


def trip_features(df, mode: str = "calendar"):
    """All trip features in one projection; the two source timestamps are dropped."""
    pick, drop = F.col("pickup_datetime"), F.col("dropoff_datetime")
    corners = ("pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")
    new = {
        **date_parts(pick),
        "diff": duration_ms(pick, drop),
        **{f"{c}_r": grid_snap(F.col(c)) for c in corners},
        "h_distance": haversine_km(*[F.col(c).cast("double") for c in corners]),
        "day_of_week": day_of_week(pick, mode),
        "is_weekend": is_weekend(day_of_week(pick, mode)),
    }
    return df.withColumns(new).drop("pickup_datetime", "dropoff_datetime")


def human_size(n_bytes: Column) -> Column:
    """Bytes as text in B, KB, MB or GB."""
    b = n_bytes.cast("double")
    return (
        F.when(b < 1024, F.concat(n_bytes.cast("bigint").cast("string"), F.lit(" B")))
        .when(b < 1024.0**2, F.concat((b / 1024.0).cast("string"), F.lit(" KB")))
        .when(b < 1024.0**3, F.concat((b / 1024.0**2).cast("string"), F.lit(" MB")))
        .otherwise(F.concat((b / 1024.0**3).cast("string"), F.lit(" GB")))
    )


def split_paths(paths: Column) -> Column:
    """A comma-separated list of paths as an array."""
    return F.split(paths, ",")
