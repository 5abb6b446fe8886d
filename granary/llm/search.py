"""Ranked lexical search of whole documents for a set of query texts, by presence-mask grouping.

Scoring (all integer except the term weight, which is floored from doubles):

* Terms are the maximal runs of ``TERM`` (ASCII letters and digits, and every non-ASCII character) with A-Z lower-cased;
  a null text has none. N is the number of documents with at least one term, L the number of all their terms with
  repeats, n one document's terms with repeats, df the number of documents holding a term, tf its count in a document.
* w = floor(1000 * ln((2N + 2) / (2 df + 1))); m = 25 + (75 n N) div L;
  score = sum over the query's terms, repeats included, of w * ((10**9 tf) div (1000 tf + 8 m)).

Method: the query's distinct terms are numbered and each (query, document) pair that shares a term gets a presence mask,
the bitmap (in words of 64 bits) of the query terms that the document holds, with its score. Documents are grouped by
(query, mask); each group knows its highest score. Masks are then evaluated in descending order of that maximum: first
those needed to reach ``k`` documents, whose exact top ``k`` gives a bound; then every other mask whose maximum reaches
that bound; masks below it are finished without looking at their documents. The evaluated documents' top ``k`` is the
result. All orderings per query run in two steps (per query and hash salt, then per query) so that a query that matches
every document is still ranked by many tasks.

Each row of the documents table is a document; rows that repeat a doc_id and text count as often as they occur and may
take several ranks. A null doc_id is ranked after every id among equal scores. Query rows are keyed by item_id and text
(null item_ids included, by null-safe joins); a query without terms, or whose documents all score 0, returns nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.store import narrow
from granary.session import scratch_path

# fixed values of the contract: the term pattern and the constants of the score
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the characters that TERM excludes
K1000 = 1000
B_FIXED, B_SCALED = 25, 75
SCALE = 1_000_000_000
TF_SCALE, M_SCALE = 1000, 8
TOP = 10
SALTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_BROADCAST_ROWS = 2_000_000


def terms(text: Column) -> Column:
    """The terms of a text, in order (an empty array for null): the maximal matches of ``TERM``, found as the non-empty
    pieces between runs of ``BETWEEN``, which splits several times faster than extracting the matches."""
    pieces = F.split(F.translate(text, UPPER, LOWER), BETWEEN)
    return F.coalesce(F.filter(pieces, lambda piece: piece != ""), F.array().cast("array<string>"))


def _text_key(text: Column) -> Column:
    """A 64-bit key of a text that tells null from empty."""
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, int, int]:
    """(_id, _dkey, _copies, term, tf, m) for every occurrence of a ``vocabulary`` term in a document; with N and L.

    N and L count all terms of all documents. Each text is split into terms once: a marker row (null term) per row
    carries its number of terms beside the occurrences of query terms. Texts are never shuffled: rows that repeat a
    doc_id and text are counted by their keys alone, and only the query terms of each text are dealt out.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), _text_key(F.col("text")).alias("_dkey"), terms(F.col("text")).alias("_t"))
    marked = rows.select("_id", "_dkey", F.size("_t").cast("long").alias("n"),
                         F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("_t"))).alias("term"))
    flagged = vocabulary.select("term", F.lit(True).alias("_q"))
    if vocabulary.count() <= _BROADCAST_ROWS:
        flagged = F.broadcast(flagged)
    kept = marked.join(flagged, "term", "left").filter(F.col("term").isNull() | F.col("_q"))
    counted = kept.groupBy("_id", "_dkey", "term").agg(F.count(F.lit(1)).alias("_occ"), F.max("n").alias("n"))
    # copies of a row: the count of its marker; they add equal counts of each term, so the count of one is the quotient
    row = Window.partitionBy("_id", "_dkey")
    copies = F.max(F.when(F.col("term").isNull(), F.col("_occ"))).over(row)
    post = counted.withColumn("_copies", copies).select("_id", "_dkey", "_copies", "term", "n",
                                                        (F.col("_occ") / F.col("_copies")).cast("long").alias("tf"))
    post = _by_row(post, "search-postings")
    totals = post.filter(F.col("term").isNull() & (F.col("n") > 0)).agg(
        F.sum("_copies").alias("N"), F.sum(F.col("n") * F.col("_copies")).alias("L")).first()
    big_n, big_l = int(totals["N"] or 0), int(totals["L"] or 0)
    if big_n == 0:
        return None, 0, 0
    m = F.lit(B_FIXED).cast("long") + F.expr(f"({B_SCALED}L * n * {big_n}L) div {big_l}L")
    sized = post.filter(F.col("term").isNotNull()).select("_id", "_dkey", "_copies", "term", "tf", m.alias("m"))
    return sized, big_n, big_l


def _by_row(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in as many buckets of (_id, _dkey) as there are shuffle partitions.

    ``df`` already comes partitioned so (by the window over rows), so each task writes its own buckets; reading the table
    back keeps that partitioning, and the sums per (query, row) of the hits need no exchange of the hits.
    """
    spark = df.sparkSession
    name = f"search_postings_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "_id", "_dkey").option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def weights(post: DataFrame, big_n: int) -> DataFrame:
    """(term, w) with w = floor(1000 ln((2N + 2) / (2 df + 1)))."""
    df = post.groupBy("term").agg(F.sum("_copies").alias("df"))
    w = F.floor(F.lit(float(K1000)) * F.log((F.lit(2.0 * big_n + 2.0)) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    return df.select("term", w.cast("long").alias("w"))


def _top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows per ``by`` in the order (score desc, doc_id asc nulls last, digest), in two steps by a salt."""
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_dkey"), F.col("_copy")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("_id", "_dkey", "_copy"), F.lit(SALTS)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    second = first.drop("_r", "_salt").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return second.filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each query item's k best documents with score above 0 (ties by ascending doc_id).

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored.
    """
    schema = "item_id long, rank int, doc_id long, score long"
    spark = docs.sparkSession
    queries = items.select(
        F.col("item_id").alias("_item"),
        F.xxhash64(F.col("item_id").isNull(), F.coalesce(F.col("item_id"), F.lit(0)), _text_key(F.col("text"))).alias("_qkey"),
        F.explode(terms(F.col("text"))).alias("term"),
    )
    qterms = queries.groupBy("_item", "_qkey", "term").agg(F.count(F.lit(1)).alias("qc"))
    number = Window.partitionBy("_item", "_qkey").orderBy("term")
    qterms = narrow(qterms.withColumn("bit", F.row_number().over(number) - 1), "search-queries")
    widest = qterms.agg(F.max("bit")).first()[0]
    if widest is None:
        return spark.createDataFrame([], schema)
    post, big_n, big_l = postings(docs, qterms.select("term").distinct())
    if big_n == 0:
        return spark.createDataFrame([], schema)
    w = weights(post, big_n)
    words = int(widest) // 64 + 1
    qside = qterms.join(w, "term")
    if qside.count() <= _BROADCAST_ROWS:
        qside = F.broadcast(qside)
    hits = post.join(qside, "term")
    part = F.expr(f"(({SCALE}L * tf) div ({TF_SCALE}L * tf + {M_SCALE}L * m))")
    hits = hits.withColumn("_gain", F.col("qc") * F.col("w") * part)
    masks = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, cast(bit % 64 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"_mask{i}") for i in range(words)]
    scored = hits.groupBy("_item", "_qkey", "_id", "_dkey", "_copies").agg(F.sum("_gain").alias("score"), *masks)
    scored = narrow(scored.filter(F.col("score") > 0), "search-scored")
    mask_cols = [f"_mask{i}" for i in range(words)]
    item = ["_qkey"]  # a query's key (of item_id and text), never null unlike item_id; rows carry _item to the end
    groups = scored.groupBy(*item, *mask_cols).agg(F.max("score").alias("_best"), F.sum("_copies").alias("_count"))
    groups = narrow(groups, "search-masks")
    # masks in descending order of their best score, as many as first reach k documents (two steps per query)
    before = Window.partitionBy(*item, "_salt").orderBy(F.col("_best").desc(), *mask_cols).rowsBetween(Window.unboundedPreceding, -1)
    salted = groups.withColumn("_salt", F.pmod(F.xxhash64(*mask_cols), F.lit(SALTS)))
    salted = salted.withColumn("_ahead", F.coalesce(F.sum("_count").over(before), F.lit(0))).filter(F.col("_ahead") < k).drop("_ahead", "_salt")
    overall = Window.partitionBy(*item).orderBy(F.col("_best").desc(), *mask_cols).rowsBetween(Window.unboundedPreceding, -1)
    first = salted.withColumn("_ahead", F.coalesce(F.sum("_count").over(overall), F.lit(0))).filter(F.col("_ahead") < k)
    first = first.select(*item, *mask_cols)
    expanded = _copies(scored)
    seed = _top(expanded.join(first, [*item, *mask_cols]), item, k)
    # the bound: the k-th score of the first masks, or 0 while fewer than k documents were found
    bound = seed.groupBy(*item).agg(F.count(F.lit(1)).alias("_found"), F.min("score").alias("_kth"))
    bound = bound.select(*item, F.when(F.col("_found") >= k, F.col("_kth")).otherwise(F.lit(0)).alias("_bound"))
    rest = groups.join(bound, item).filter(F.col("_best") >= F.col("_bound")).select(*item, *mask_cols)
    rest = narrow(rest, "search-evaluated")
    ranked = _top(expanded.join(rest, [*item, *mask_cols]), item, k)
    return ranked.select(F.col("_item").alias("item_id"), F.col("rank").cast("int"), F.col("_id").alias("doc_id"), F.col("score").cast("long"))


def _copies(scored: DataFrame) -> DataFrame:
    """One row per copy of a repeated (doc_id, text) row, numbered by ``_copy``; copies beyond the k-th can take no rank."""
    return scored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_copies"), F.lit(TOP).cast("long")))))

