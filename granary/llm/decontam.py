"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A seed is a window of tokens of which a fixed mask keeps some; the positions it ignores may differ. The masks depend on the
length of the item (``SEEDS``) and miss no overlap that counts: tests lay them over every substitution pattern.
Seeds of the benchmark and of the documents meet by hash, and each hit gives a diagonal (document
position minus item position). The diagonals are written without the texts; then each document that has some is read once more,
and on each diagonal the whole item is laid over the part of the document that it covers: no row but that of a document holds all
its tokens, so memory does not grow with the hits of a document times its length. The pair counts as contaminated when some ``WINDOW`` consecutive aligned tokens (all of a shorter item) agree in at least ``AGREE`` of
their places, so substituted words don't hide a passage.

Tokens are runs of letters and digits, lower-cased. Items of four tokens or fewer are found as they stand, so an item of one
token is in every document with that token. Items of equal tokens are looked for once. Null or empty texts have no tokens. Documents are told apart by id and text, so repeated or
null ids are safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.store import narrow

#: Masks over consecutive tokens (1 counts, 0 is ignored) for items of so many tokens up to the next number. Each set
#: meets all ways to place the differences that ``AGREE`` allows in that many tokens, and so in more of them up to ``WINDOW``.
SEEDS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "1011"), 6: ("1111", "11011"), 8: ("110111", "11111"),
    10: ("110111", "11001011", "11111"), 11: ("1101011", "1100111"), 12: ("11010111", "111001101", "111111"),
    15: ("1101111", "11100010011", "10001101011"),
}
#: The sparser masks that the SQL of the query compares with; it finds no more than ``SEEDS`` do.
MASKS = ("11101101011", "11011010111", "10111011011")
SPAN = len(MASKS[0])
WINDOW, AGREE = 16, 0.8
#: Benchmark seeds are broadcast up to this many (24 bytes each), else both sides are shuffled.
BROADCAST_SEEDS = 1_000_000
#: Rows to take out are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_for(n_tokens: int) -> tuple[str, ...]:
    """The masks that find an item of so many tokens."""
    return SEEDS[max(n for n in SEEDS if n <= n_tokens)]


def _seeds(rows: DataFrame, at: str, masks: list[str]) -> DataFrame:
    """One row per seed of the token array ``h``: its position and its key; other columns are kept."""
    least = min(map(len, masks))
    places = rows.filter(F.size("h") >= least).withColumn(at, F.explode(F.sequence(F.lit(0), F.size("h") - least)))
    keys = [
        F.when(
            F.col(at) + len(mask) <= F.size("h"),
            F.xxhash64(F.lit(mask), *[F.get("h", F.col(at) + i) for i, c in enumerate(mask) if c == "1"]),
        )
        for mask in masks
    ]
    return places.withColumn("seed", F.explode(F.array(*keys))).filter(F.col("seed").isNotNull())


def _item_seeds(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """The seeds of all items by the masks for their lengths, and the masks in use."""
    n = F.size("h")
    lengths = [r[0] for r in items.filter(n > 0).select(F.least(n, F.lit(max(SEEDS)))).distinct().collect()]
    by_masks: dict[tuple[str, ...], list[int]] = {}
    for length in sorted(lengths):
        by_masks.setdefault(masks_for(length), []).append(length)
    columns = ["item_key", "n_item", "item_at", "seed"]
    out = items.select("item_key", n.alias("n_item"), F.lit(0).alias("item_at"), F.lit(0).cast("long").alias("seed")).limit(0)
    for masks, own in by_masks.items():
        some = items.filter(F.least(n, F.lit(max(SEEDS))).isin(own)).withColumn("n_item", n)
        out = out.unionByName(_seeds(some, "item_at", list(masks)).select(*columns))
    return out.distinct(), sorted({m for masks in by_masks for m in masks})


def _parts(docs: DataFrame, hits: DataFrame, broadcast_rows: int) -> DataFrame:
    """The tokens that an item covers in a document, for each of ``hits``, a written table: one row per hit.

    Documents with hits get them as one row; its tokens are cut where the hits are taken apart, before a row is handed on.
    """
    laid = hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_key", "n_item", "diagonal")).alias("laid"))
    laid = (F.broadcast(laid) if hits.count() <= broadcast_rows else laid).alias("laid")
    docs = docs.alias("docs")
    same = F.col("docs.doc_id").eqNullSafe(F.col("laid.doc_id")) & (F.col("docs.text_key") == F.col("laid.text_key"))
    rows = docs.join(laid, same).select("docs.doc_id", "docs.text_key", tokens(F.col("docs.text")).alias("h"), "laid.laid")
    rows = rows.select("doc_id", "text_key", "h", F.inline("laid"))
    skip = F.greatest(F.lit(0), -F.col("diagonal"))
    n_aligned = F.least(F.col("n_item") - skip, F.size("h") - F.col("diagonal") - skip)
    part = F.slice("h", F.col("diagonal") + skip + 1, F.greatest(n_aligned, F.lit(0)))
    return rows.select("doc_id", "text_key", "item_key", "n_item", "diagonal", part.alias("part"))


def _agreement(rows: DataFrame) -> DataFrame:
    """Item tokens ``g`` laid over the ``part`` that they cover along ``diagonal``: how many agree, and how many in the best window.

    One pass along the aligned tokens keeps the last ``WINDOW`` of them as bits; only diagonals that count are handed on.
    """
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    theirs = F.slice("g", F.greatest(F.lit(0), -F.col("diagonal")) + 1, F.size("part"))
    same = F.zip_with("part", theirs, lambda a, b: (a == b).cast("int"))
    state = lambda bits, at, n, best: F.struct(bits.alias("bits"), at.alias("at"), n.alias("n"), best.alias("best"))

    def step(x: Column, equal: Column) -> Column:
        bits = F.shiftleft(x["bits"], 1).bitwiseOR(equal).bitwiseAND((1 << WINDOW) - 1)
        # an item shorter than WINDOW counts as a whole, which the same bits hold
        best = F.when(x["at"] + 1 >= width, F.greatest(x["best"], F.bit_count(bits))).otherwise(x["best"])
        return state(bits, x["at"] + 1, x["n"] + equal, best)

    found = rows.withColumn("run", F.aggregate(same, state(F.lit(0), F.lit(0), F.lit(0), F.lit(-1)), step))
    return found.filter(F.col("run.best") >= F.ceil(width * AGREE)).select(
        "doc_id", "text_key", "item_key", "diagonal", "n_item",
        F.col("run.at").alias("n_aligned"), F.col("run.n").alias("n_matched"), F.col("run.best").alias("best"),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Pairs of document and benchmark item that overlap.

    One row per (doc_id, text_key, item_id): where the item would begin in the document (in tokens), its
    length, the aligned tokens, the equal ones among them, and the equal ones of the best window.
    """
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    docs = docs.select("doc_id", text_key.alias("text_key"), "text")
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("h")).filter(F.size("h") > 0)
    items = narrow(items.distinct().withColumn("item_key", F.xxhash64("h")), "items")
    whole = items.select("item_key", "h").distinct()
    theirs, masks = _item_seeds(whole)
    theirs, masks = narrow(theirs, "item-seeds"), masks or list(SEEDS[max(SEEDS)])
    few = theirs.count() <= broadcast_seeds
    places = _seeds(docs.select("doc_id", "text_key", tokens(F.col("text")).alias("h")), "doc_at", masks)
    places = places.select("doc_id", "text_key", "doc_at", "seed")
    hits = places.join(F.broadcast(theirs) if few else theirs, "seed")
    hits = hits.select("doc_id", "text_key", "item_key", "n_item", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    parts = _parts(docs, narrow(hits, "hits"), broadcast_rows)
    whole = whole.withColumnRenamed("h", "g")
    found = _agreement(parts.join(F.broadcast(whole) if few else whole, "item_key"))
    pair = ["doc_id", "text_key", "item_id"]
    found = found.join(items.select("item_id", "item_key"), "item_key")
    best = F.max(F.struct("best", "n_matched", "n_aligned", -F.col("diagonal"), F.col("n_item").alias("n_item"))).alias("top")
    return found.groupBy(*pair).agg(best).select(
        *pair, (-F.col("top.col4")).cast("int").alias("doc_begin"), F.col("top.n_item").alias("n_item"),
        F.col("top.n_aligned").alias("n_aligned"), F.col("top.n_matched").alias("n_matched"), F.col("top.best").alias("best"),
    )


def without(docs: DataFrame, gone: DataFrame, matches: Callable[[DataFrame], Column]) -> DataFrame:
    """``docs`` without the rows that match one of ``gone``, a written table: by broadcast up to ``BROADCAST_ROWS`` of these."""
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, matches(gone), "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return without(docs, narrow(bad, "contaminated"), lambda g: docs["doc_id"].eqNullSafe(g["_bad_id"]) & (key == g["_bad_key"]))
