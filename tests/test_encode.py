"""Encoders, bins and cleaning rules beyond what the oracles cover."""

import datetime
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import trip
from granary.operators import clean, encode, metrics, quantile
from granary.sources import datasets, files


def test_unseen_category_is_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c STRING")
    test = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "c STRING, n INT")
    got = encode.ordinal_transform(test, encode.ordinal_fit(train)).orderBy("n").collect()
    assert [r["c"] for r in got] == [0, None, None]
    hot = encode.onehot_transform(test, encode.onehot_fit(train)).orderBy("n").collect()
    assert [(r["c=a"], r["c=b"]) for r in hot] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_wide_onehot_is_refused(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_WIDE_VALUES", 3)
    with pytest.raises(ValueError):
        encode.onehot_fit(spark.range(5).select(F.col("id").cast("string").alias("c")), ["c"])


def test_bins_of_missing_and_extreme_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (None,), (math.nan,), (math.inf,), (-math.inf,)], "x DOUBLE")
    got = [r["x_bin"] for r in quantile.apply_cuts(df, {"x": [2.0, 4.0]}).collect()]
    assert got == [0, 1, 2, -1, -1, 2, 0]


def test_feature_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x DOUBLE, y DOUBLE")
    cuts = quantile.collect_cuts(quantile.exact_cuts(df, ["x", "y"], 4), ["x", "y"])
    assert cuts["x"] == [] and [r["x_bin"] for r in quantile.apply_cuts(df, cuts).collect()] == [-1, -1]


def test_approximate_cuts_are_close(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).cast("double").alias("x"))
    cuts = quantile.collect_cuts(quantile.approx_cuts(df, ["x"], 16), ["x"])["x"]
    assert len(cuts) == 15 and all(abs(c - 1250 * (k + 1)) <= 80 for k, c in enumerate(cuts))


def test_legacy_weekday_differs_in_january_and_february_only(spark):
    days = spark.range(365).select(F.date_add(F.lit("2013-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    diff = F.pmod(trip.day_of_week(F.col("d"), "legacy") - trip.day_of_week(F.col("d")), F.lit(7))
    got = {(r[0], r[1]) for r in days.select(F.month("d"), diff).distinct().collect()}
    assert got == {(1, 6), (2, 2)} | {(m, 0) for m in range(3, 13)}


def test_weekday_convention(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 6, 1, 12),)], "t TIMESTAMP")  # a Saturday
    assert df.select(trip.day_of_week(F.col("t"))).first()[0] == 0


def test_absent_column_is_named():
    with pytest.raises(ValueError, match="b"):
        clean.require(_Columns(["a"]), ["a", "b"])


class _Columns:
    def __init__(self, columns):
        self.columns = columns


def test_constant_label_scales_to_missing(spark):
    df = spark.createDataFrame([(3,), (3,)], "y INT")
    assert [r["y"] for r in clean.minmax(df, "y").collect()] == [None, None]


def test_unreadable_text_becomes_missing(spark):
    df = spark.createDataFrame([("2014-01-02 03:04:05", "1.5"), ("soon", "many")], "t STRING, x STRING")
    got = clean.coerce(df, T.StructType.fromDDL("t TIMESTAMP, x FLOAT")).collect()
    assert got[0]["x"] == 1.5 and got[0]["t"].hour == 3 and got[1]["x"] is None and got[1]["t"] is None


def test_nan_is_filled(spark):
    df = spark.createDataFrame([(math.nan, None, None)], "a DOUBLE, b STRING, c TIMESTAMP")
    assert tuple(clean.fill_missing(df).first()) == (-1.0, "-1", None)


def test_auc_edges(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y INT, s DOUBLE")
    assert metrics.auc(df, "y", "s").first()["auc"] == pytest.approx(0.875)
    assert metrics.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_csv_loaders(spark, tmp_path):
    (tmp_path / "airline.csv").write_text("1987,10,14,3,741,912,PS,1451,91,SAN,SFO,447,0,23\n1987,10,15,4,729,903,PS,1451,94,SAN,SFO,447,0,-2\n")
    df, task = datasets.dataset(spark, "airline", str(tmp_path / "airline.csv"))
    assert task == "binary:logistic" and df.columns[-1] == "ArrDelayBinary" and "ArrDelay" not in df.columns
    assert sorted(r["ArrDelayBinary"] for r in df.collect()) == [0, 1]
    (tmp_path / "year.txt").write_text("2001,1.5,2.5\n1999,3.5,4.5\n")
    df, task = datasets.dataset(spark, "year", str(tmp_path / "year.txt"))
    assert task == "reg:squarederror" and sorted(r["label"] for r in df.collect()) == [1999.0, 2001.0]
    (tmp_path / "cov.csv").write_text("1.5,2.5,7\n3.5,4.5,2\n")
    df, task = datasets.dataset(spark, "covtype", str(tmp_path / "cov.csv"))
    assert task == "multi:softprob" and dict(df.dtypes)["label"] == "int"
    (tmp_path / "higgs.csv").write_text(",".join(["1.0"] + ["0.5"] * 28) + "\n")
    df, _ = datasets.dataset(spark, "higgs", str(tmp_path / "higgs.csv"))
    assert len(df.columns) == 29 and df.first()["label"] == 1.0


def test_svm_loaders(spark, tmp_path):
    (tmp_path / "epsilon_normalized").write_text("-1 1:0.5 2000:0.25\n")
    (tmp_path / "epsilon_normalized.t").write_text("1 2:0.75\n")
    df, _ = datasets.dataset(spark, "epsilon", str(tmp_path))
    got = sorted((r["label"], sum(r["features"])) for r in df.collect())
    assert got == [(0.0, 0.75), (1.0, 0.75)]


def test_categorical_loader_and_encodings(spark, tmp_path):
    (tmp_path / "adult.csv").write_text("age,work,class\n30,Private,>50K\n40,?,<=50K\n50,State,<=50K\n")
    df, task = datasets.dataset(spark, "adult", str(tmp_path / "adult.csv"))
    assert task == "binary:logistic"
    assert {r["age"]: r["label"] for r in df.collect()} == {30: 1, 40: 0, 50: 0}
    for encoding, width in (("ord", 3), ("nohe", 3), ("part", 3), ("ohe", 4)):
        out, mask = datasets.encoded(df, encoding, "label")
        assert len(out.columns) == width and (mask is None) == (encoding == "ohe")
    with pytest.raises(ValueError):
        datasets.encoded(df, "other", "label")


def test_registry_names():
    assert datasets.resolve("mortgage:4")[1] == "4"
    for bad in ("mortgage:3", "nothing", "taxi:1"):
        with pytest.raises(ValueError):
            datasets.resolve(bad)


def test_interrupted_cache_is_built_again(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(3).write.parquet(f"{path}/data")
    assert files.cached_table(spark, path, lambda: spark.range(5)).count() == 5
    assert files.cached_table(spark, path, lambda: spark.range(9)).count() == 5
