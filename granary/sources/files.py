"""Text, compressed, LIBSVM and cached Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.relate import union_all


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = False,
    block_bytes: int | None = None,
    recursive: bool = False,
    glob: str | None = None,
) -> DataFrame:
    """Delimited text with declared names and types; a header line is skipped, not interpreted.

    ``block_bytes`` sets the split size of the scan for this session.
    """
    if block_bytes is not None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def read_dir(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "|", header: bool = True) -> DataFrame:
    """Every file below a directory as one table, in one scan."""
    return read_delimited(spark, path, schema, sep, header, recursive=True)


def read_compressed(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", partitions: int | None = None
) -> DataFrame:
    """gzip or bzip2 text, by file extension.

    A gzip file is read by one task; ``partitions`` spreads its rows before expensive work.
    """
    df = read_delimited(spark, path, schema, sep)
    return df.repartition(partitions) if partitions else df


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored below ``path``; it is built and written first if there is none.

    A one-row table beside it is written last, so a build that was cut short is done again.
    """
    if not _exists(spark, f"{path}/complete"):
        build().write.mode("overwrite").parquet(f"{path}/data")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/complete")
    return spark.read.parquet(f"{path}/data")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("id BIGINT").parquet(path)
        return True
    except AnalysisException:
        return False


def write_libsvm(df: DataFrame, path: str, label: str, features: str) -> None:
    """``label`` and an array column as LIBSVM text; zeros are not written."""
    from pyspark.ml.functions import array_to_vector

    df.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features")).write.format(
        "libsvm"
    ).save(path)


def read_libsvm(spark: SparkSession, paths: list[str], n_features: int) -> DataFrame:
    """All files appended: ``label DOUBLE, features VECTOR``. Naming the width avoids a counting pass."""
    read = [spark.read.format("libsvm").option("numFeatures", n_features).load(p) for p in paths]
    return union_all(read)


def libsvm_arrays(df: DataFrame) -> DataFrame:
    return df.select("label", vector_to_array("features").alias("features"))
