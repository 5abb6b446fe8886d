"""A training corpus from raw documents, as stages that are written and read again between each other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, and
a stage sees only what the one before kept. Columns beyond these pass through unchanged.

1. toxicity: the classifier learns from ``labels``; documents that it rejects go.
2. exact dedup: of equal texts (white space normalised) the smallest doc_id stays.
3. near dedup: one document of each group linked by shingle similarity stays, that with the smallest doc_id.
4. decontamination: documents that overlap with an item of ``benchmark`` go.
5. packing: what is left, as sequences of tokens; one row per piece.

Null texts are empty texts, and one of them stays. Rows that repeat a doc_id and its text stay once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, exact, jaccard, pack, toxic
from granary.llm.registry import table
from granary.llm.store import narrow
from granary.session import materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every document; those at 0.5 or above go."""
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxic.with_scores(docs, model)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the ids that ``found`` (doc_id, kept) never keeps; rows that repeat id and text stay once.

    The ids that go are written first. Up to a million of them go to the texts by broadcast, so texts aren't dealt out; more
    of them are joined by shuffle.
    """
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    out = decontam.without(docs, narrow(gone, "gone"), lambda g: docs["doc_id"].eqNullSafe(g["_gone"]))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    # ids tell documents apart; only a table in which some don't is dealt out again
    return out.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else out


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deduplicate through a fresh digest index."""
    return _without(docs, exact.dedup(docs, exact.fresh_index(spark)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each class."""
    found = jaccard.near_duplicates(docs)
    return _without(docs, found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what overlaps with the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each piece in the packed sequences."""
    packing = pack.pack(docs)
    cut = packing.pieces.select("piece_key", "doc_id", "piece", "start", "length")
    return cut.join(packing.plan, "piece_key").drop("piece_key")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier and the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
