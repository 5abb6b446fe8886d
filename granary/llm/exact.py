"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table of (digest, keep_id, n_rows, batch), bucketed and sorted by digest. A new batch is
aggregated to one row per digest and deduplicated by a sort-merge anti-join with the index: digests that the
index lacks are appended with the smallest id of the batch as the row that stays, digests that it has are
appended as further counts for the row that already stays. The index is append-only, so a lost
executor costs a retried task and a rerun batch is recognised by its name.

Null text counts as empty; a null id stays only where no copy has an id. An empty batch appends nothing. Copies that arrive later never replace the row that
stays, so ids should rise from batch to batch if the smallest id of all is to stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.store import narrow
from granary.session import scratch_path

WHITE = r"[\x20\x09-\x0D]+"
#: A digest with this share of all rows or more is joined by broadcast: at most 1/HEAVY of them can exist.
HEAVY = 0.001


def normalised(text):
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest_of(text):
    """SHA-256 of a normalised text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def join_counted(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key; ``size``: rows of the key), safe for hot keys.

    Keys that hold a thousandth of all rows are at most a thousand, so they are broadcast and their
    rows stay where they are; all others take a sort-merge join.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_heavy = F.col(size) >= F.lit(max(2.0, total * HEAVY))
    heavy = groups.filter(is_heavy)
    light = groups.filter(~is_heavy)
    near = rows.join(F.broadcast(heavy), key, "inner")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.hint("merge"), key, how)
    return near.unionByName(rest)


class DigestIndex:
    """The index at ``path``: ``buckets`` files' worth of sorted digests, registered under a table name of this session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def entries(self) -> DataFrame:
        """The log of appended rows as it stands."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def known(self) -> DataFrame:
        """One row per digest: the row that stays and all rows counted. Buckets make this free of shuffles."""
        return self.entries().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))

    def add(self, digests: DataFrame, batch: str) -> None:
        """Deduplicate a batch of (doc_id, digest) against the index and append what is new.

        A batch whose name the index holds is left out, so a job may be rerun.
        """
        if self.entries().filter(F.col("batch") == batch).limit(1).count():
            return
        fresh = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
        fresh = narrow(fresh, "digest-batch")
        known = self.entries().groupBy("digest").agg(F.min("keep_id").alias("keep_id")).hint("merge")
        new = fresh.join(known, "digest", "left_anti").withColumn("keep_id", F.col("first_id"))
        again = fresh.join(known, "digest", "inner")
        columns = [F.col("digest"), F.col("keep_id"), F.col("n_rows"), F.lit(batch).alias("batch")]
        both = new.select(*columns).unionByName(again.select(*columns))
        # written apart first: a table can't be read and appended to in one job
        both = narrow(both, "digest-append")
        (
            both.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )


def dedup(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """Add ``docs`` to the index in ``batches`` of rising ids and tell what stays.

    One row per document: doc_id, keep_id, group_size, kept, digest.
    """
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(normalised(F.col("text"))).alias("digest"))
    digests = narrow(digests, "digests")
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        step = -(-(high - low + 1) // batches)
        for k in range(batches):
            begin = low + k * step
            part = (F.col("doc_id") >= begin) & (F.col("doc_id") < begin + step)
            # rows without an id come first
            rows = digests.filter(part | F.col("doc_id").isNull() if k == 0 else part)
            index.add(rows, f"{begin}-{begin + step}/{_checksum(rows)}")
    elif digests.limit(1).count():
        index.add(digests, f"no ids/{_checksum(digests)}")
    found = join_counted(digests, index.known(), "digest", "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _checksum(rows: DataFrame) -> str:
    """Count and sum of the hashes of a batch's (doc_id, digest) rows: another table under the same id range is another
    batch, and a rerun of the same one is recognised."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def buckets_for(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions, so that a batch is appended without another exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), buckets_for(spark))
