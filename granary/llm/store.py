"""Written intermediate tables of few bytes a row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from granary.session import materialize


def narrow(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder with the tasks that compute it, and read it back.

    The computation keeps its own partitions (``spark.sql.shuffle.partitions`` after a shuffle); tables of ids, counts
    and links are far smaller than the texts that they come from, and the scan of the written table packs their small
    files into splits of ``spark.sql.files.maxPartitionBytes``, so no stage is pulled into fewer tasks to write fewer files.
    """
    return materialize(df, label)
