"""Named datasets: where their columns are, which is the label and what the task is.

``dataset(spark, name, path)`` reads files that are already at ``path`` and returns one table with
the features sorted by name and the label last.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.trip import trip_features
from granary.operators import clean, encode
from granary.operators.relate import enrich, union_all
from granary.sources.files import read_compressed, read_dir, read_libsvm

REGRESSION = "reg:squarederror"
BINARY = "binary:logistic"
MULTICLASS = "multi:softprob"

# The column layouts of the public datasets.
PERFORMANCE = (
    "loan_id BIGINT, monthly_reporting_period TIMESTAMP, servicer STRING, interest_rate FLOAT, "
    "current_actual_upb FLOAT, loan_age FLOAT, remaining_months_to_legal_maturity FLOAT, "
    "adj_remaining_months_to_maturity FLOAT, maturity_date TIMESTAMP, msa FLOAT, "
    "current_loan_delinquency_status INT, mod_flag STRING, zero_balance_code STRING, "
    "zero_balance_effective_date TIMESTAMP, last_paid_installment_date TIMESTAMP, foreclosed_after TIMESTAMP, "
    "disposition_date TIMESTAMP, foreclosure_costs FLOAT, prop_preservation_and_repair_costs FLOAT, "
    "asset_recovery_costs FLOAT, misc_holding_expenses FLOAT, holding_taxes FLOAT, net_sale_proceeds FLOAT, "
    "credit_enhancement_proceeds FLOAT, repurchase_make_whole_proceeds FLOAT, other_foreclosure_proceeds FLOAT, "
    "non_interest_bearing_upb FLOAT, principal_forgiveness_upb FLOAT, repurchase_make_whole_proceeds_flag STRING, "
    "foreclosure_principal_write_off_amount FLOAT, servicing_activity_indicator STRING"
)
ACQUISITION = (
    "loan_id BIGINT, orig_channel STRING, seller_name STRING, orig_interest_rate DOUBLE, orig_upb BIGINT, "
    "orig_loan_term BIGINT, orig_date TIMESTAMP, first_pay_date TIMESTAMP, orig_ltv DOUBLE, orig_cltv DOUBLE, "
    "num_borrowers DOUBLE, dti DOUBLE, borrower_credit_score DOUBLE, first_home_buyer STRING, loan_purpose STRING, "
    "property_type STRING, num_units BIGINT, occupancy_status STRING, property_state STRING, zip BIGINT, "
    "mortgage_insurance_percent DOUBLE, product_type STRING, coborrow_credit_score DOUBLE, "
    "mortgage_insurance_type DOUBLE, relocation_mortgage_indicator STRING, something BIGINT"
)
MORTGAGE_LABEL = "current_loan_delinquency_status"
TAXI = (
    "pickup_datetime TIMESTAMP, dropoff_datetime TIMESTAMP, passenger_count INT, trip_distance FLOAT, "
    "pickup_longitude FLOAT, pickup_latitude FLOAT, rate_code INT, dropoff_longitude FLOAT, "
    "dropoff_latitude FLOAT, fare_amount FLOAT"
)
TAXI_ALIASES = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
    "ratecodeid": "rate_code",
}
# Bounds of usable trips.
TAXI_BOUNDS = {
    "fare_amount": (0, 500),
    "passenger_count": (0, 6),
    "pickup_longitude": (-75, -73),
    "dropoff_longitude": (-75, -73),
    "pickup_latitude": (40, 42),
    "dropoff_latitude": (40, 42),
}
TAXI_TRAIN_DAYS = 25
# Columns of the flight table, and those that hold text.
AIRLINE = (
    "Year", "Month", "DayofMonth", "DayofWeek", "CRSDepTime", "CRSArrTime", "UniqueCarrier", "FlightNum",
    "ActualElapsedTime", "Origin", "Dest", "Distance", "Diverted", "ArrDelay",
)
AIRLINE_TEXT = ("UniqueCarrier", "Origin", "Dest")
# Columns used of the house prices.
HOUSE_CATEGORIES = (
    "BldgType", "GarageFinish", "LotConfig", "Functional", "MasVnrType", "HouseStyle", "FireplaceQu", "ExterCond",
    "ExterQual", "PoolQC",
)
HOUSE_NUMBERS = (
    "3SsnPorch", "Fireplaces", "BsmtHalfBath", "HalfBath", "GarageCars", "TotRmsAbvGrd", "BsmtFinSF1", "BsmtFinSF2",
    "GrLivArea", "ScreenPorch",
)
EPSILON_FEATURES = 2000
URL_FEATURES = 3231961


def mortgage_table(perf: DataFrame, acq: DataFrame, label: str = MORTGAGE_LABEL, key: str = "loan_id") -> DataFrame:
    """Loan performance enriched with the acquisition of the loan; the label is scaled to [0, 1].

    Every performance row survives the left join, so the label range is taken from the performance
    table alone: the scan for it reads one column and no join.
    """
    ends = perf.agg(F.struct(F.min(label).alias("lo"), F.max(label).alias("hi")).alias("ends")).scalar()
    scaled = clean.minmax_with(clean.dates_to_day(perf), label, ends)
    return clean.features_then_label(enrich(scaled, clean.dates_to_day(acq), key), label)


def clean_trips(raw: DataFrame) -> DataFrame:
    """Names normalised and unified, needed columns kept, declared types, missing numbers set to -1."""
    named = clean.rename(clean.normalise_names(raw), TAXI_ALIASES)
    schema = T.StructType.fromDDL(TAXI)
    return clean.fill_missing(clean.coerce(clean.require(named, schema.names), schema), -1)


def taxi_table(raw: DataFrame, weekday: str = "calendar") -> DataFrame:
    """Trip features of the rows inside all bounds; ``part`` is train for the first days of a month."""
    return taxi_features(clean_trips(raw), weekday)


def taxi_features(cleaned: DataFrame, weekday: str = "calendar") -> DataFrame:
    trips = trip_features(clean.between_open(cleaned, TAXI_BOUNDS), weekday)
    part = F.when(F.col("day") < TAXI_TRAIN_DAYS, "train").otherwise("test")
    return clean.features_then_label(trips, "fare_amount").withColumn("part", part)


def _mortgage(spark: SparkSession, path: str) -> DataFrame:
    return mortgage_table(read_dir(spark, f"{path}/perf", PERFORMANCE), read_dir(spark, f"{path}/acq", ACQUISITION))


def _taxi(spark: SparkSession, path: str) -> DataFrame:
    """Column names and their order differ by year, so files are read by header and united after cleaning."""
    parts = []
    for names, files in headers(spark, path).items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(clean_trips(spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)))
    return taxi_features(union_all(parts))


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files below ``path`` by the column names of their first line. One row per file comes to the driver."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "at").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(tuple(next(csv.reader([row["line"]]))), []).append(row["file"])
    return found


def airline_table(raw: DataFrame) -> DataFrame:
    delayed = raw.withColumn("ArrDelayBinary", clean.binarise(F.col("ArrDelay"))).drop("ArrDelay")
    return clean.features_then_label(delayed, "ArrDelayBinary")


def _airline(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{c} {'STRING' if c in AIRLINE_TEXT else 'FLOAT'}" for c in AIRLINE)
    return airline_table(read_compressed(spark, path, fields))


def _higgs(spark: SparkSession, path: str) -> DataFrame:
    names = ["label", *[f"feat-{i:02d}" for i in range(1, 29)]]
    df = read_compressed(spark, path, ", ".join(f"`{n}` FLOAT" for n in names))
    return clean.features_then_label(df, "label")


def _headerless(position: int) -> Callable[[SparkSession, str], DataFrame]:
    """Headerless numbers with the label in the first or the last column."""

    def load(spark: SparkSession, path: str) -> DataFrame:
        line = spark.read.text(path).first()
        width = line["value"].count(",") + 1 if line else 0
        df = spark.read.schema(", ".join(f"_c{i} FLOAT" for i in range(width))).csv(path)
        label = df.columns[position]
        return df.select(*[c for c in df.columns if c != label], F.col(label).alias("label"))

    return load


def _covtype(spark: SparkSession, path: str) -> DataFrame:
    return _headerless(-1)(spark, path).withColumn("label", F.col("label").cast("int"))


def _epsilon(spark: SparkSession, path: str) -> DataFrame:
    df = read_libsvm(spark, [f"{path}/epsilon_normalized", f"{path}/epsilon_normalized.t"], EPSILON_FEATURES)
    return df.select(
        vector_to_array("features", "float32").alias("features"), clean.clip_nonpositive(F.col("label")).alias("label")
    )


def _url(spark: SparkSession, path: str) -> DataFrame:
    # rows stay sparse: a dense array of three million columns per row would not do
    df = read_libsvm(spark, [path], URL_FEATURES)
    return df.select("features", clean.clip_nonpositive(F.col("label")).alias("label"))


def _house(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    features = [F.col(c) for c in HOUSE_CATEGORIES]
    features += [F.col(c).try_cast("double").alias(c) for c in HOUSE_NUMBERS]
    return raw.select(*features, F.col("SalePrice").try_cast("double").alias("label"))


def _categorical(label: str, missing: str = "?") -> Callable[[SparkSession, str], DataFrame]:
    """A table with a header; text columns are categories and the label is coded by sorted value."""

    def load(spark: SparkSession, path: str) -> DataFrame:
        df = spark.read.option("header", True).option("inferSchema", True).option("nullValue", missing).csv(path)
        return clean.label_codes(df, label, "label").select(*[c for c in df.columns if c != label], "label")

    return load


@dataclass(frozen=True)
class Dataset:
    """How to load a dataset, its label column and its learning task."""

    load: Callable[[SparkSession, str], DataFrame]
    label: str
    task: str
    n_classes: int | None = None


REGISTRY: dict[str, Dataset] = {
    "mortgage": Dataset(_mortgage, MORTGAGE_LABEL, BINARY),
    "taxi": Dataset(_taxi, "fare_amount", REGRESSION),
    "airline": Dataset(_airline, "ArrDelayBinary", BINARY),
    "higgs": Dataset(_higgs, "label", BINARY),
    "year": Dataset(_headerless(0), "label", REGRESSION),
    "covtype": Dataset(_covtype, "label", MULTICLASS, 10),
    "epsilon": Dataset(_epsilon, "label", BINARY),
    "url": Dataset(_url, "label", BINARY),
    "ames_housing": Dataset(_house, "label", REGRESSION),
    "adult": Dataset(_categorical("class"), "label", BINARY),
    "employee": Dataset(_categorical("target"), "label", BINARY),
    "kick": Dataset(_categorical("IsBadBuy"), "label", BINARY),
}
MORTGAGE_YEARS = (1, 2, 4, 8, 16, 17)


def resolve(name: str) -> tuple[Dataset, str | None]:
    """The entry of ``name`` or ``name:years``, and the years."""
    base, _, years = name.partition(":")
    if base not in REGISTRY:
        raise ValueError(f"unknown dataset: {name}")
    if years and (base != "mortgage" or years not in {str(y) for y in MORTGAGE_YEARS}):
        raise ValueError(f"unknown years: {name}")
    return REGISTRY[base], years or None


def dataset(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, str]:
    """(table, task). ``mortgage:N`` looks in ``<path>/mortgage-N``, other names in ``path``."""
    entry, years = resolve(name)
    return entry.load(spark, f"{path}/mortgage-{years}" if years else path), entry.task


def encoded(df: DataFrame, encoding: str, label: str) -> tuple[DataFrame, list[bool] | None]:
    """Features encoded as ``ord``, ``ohe``, ``nohe`` or ``part``, label last, and the categorical mask.

    The two native encodings keep integer codes and leave the split style to the trainer.
    """
    features = df.drop(label)
    cats = clean.categorical_columns(features)
    if encoding == "ohe":
        wide = encode.onehot_transform(df, encode.onehot_fit(df, cats))
        return wide.select(*[c for c in wide.columns if c != label], label), None
    if encoding not in ("ord", "nohe", "part"):
        raise ValueError(f"unknown encoding: {encoding}")
    coded = encode.ordinal_transform(df, encode.ordinal_fit(df, cats))
    names = [c for c in coded.columns if c != label]
    return coded.select(*names, label), [c in cats for c in names]
