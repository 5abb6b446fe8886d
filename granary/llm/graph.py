"""Connected components of a table of edges, by alternating stars; nothing of the graph is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import narrow

ROUNDS = 60


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and the node) to its smallest neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    linked = both.join(low, "a")
    if larger:
        new = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        new = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return new.filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, low) for each node of (a, b): the smallest node that it is connected with. Each round is written to the shared folder."""
    now = narrow(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        now = narrow(_star(_star(now, True), False), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {ROUNDS} rounds")
    low = now.groupBy("a").agg(F.min("b").alias("low"))
    return low.select(F.col("a").alias("node"), "low").unionByName(low.select(F.col("low").alias("node"), "low").distinct())
