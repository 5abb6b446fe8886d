"""A Merkle manifest of a table of documents, with proofs by checkpoint-and-recompute.

Each row is a leaf: H of the concatenation, field by field (doc_id, source, lang, n_chars, text), of ``-`` for null or
else the UTF-8 byte count of the value's text, ``:`` and the text (integers in decimal). H is lowercase hex SHA-256 and an
interior node is H of its children's hex digests concatenated.

* Per lang, leaves ascend by doc_id (nulls first; equal ids by leaf, so repeated rows are consecutive and any order of them
  gives the same hashes). At each level every two consecutive nodes become their H; a last lone node becomes H of itself.
  What remains is the lang's subroot; a lang with one leaf has that leaf as subroot. Subroots, ordered by lang (null first,
  then UTF-8 bytewise), give the root in the same way.
* Levels are built in aligned blocks of ``2**STRIDE`` nodes: one grouped pass computes ``STRIDE`` levels at once, and only
  every ``STRIDE``-th level is written to the shared folder. Proof extraction recomputes the interior nodes of each aligned
  block from its stored level, emits each node's siblings within the block and discards the interior; paths are then
  joined top-down from the highest stored level, so every join meets a table ``2**STRIDE`` times smaller.
* Positions are taken from a global sort by (lang, doc_id, leaf): each sorted partition's first row per lang gets an offset
  from a table of (partition, lang) counts, so a lang that holds a third of all rows is still numbered by many tasks.
* A proof is the list of siblings leaf to root (lone levels have none); proof_sha256 is H of their digests concatenated in
  that order (H of the empty string when there is none). ``fold`` recomputes the root from a leaf and its proof.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.llm.store import narrow

STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:boolean,h:string>>"
_OFFSETS_BROADCAST = 1_000_000


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def positions(leaves: DataFrame, group: str, order: list) -> DataFrame:
    """``leaves`` with ``idx``, the 0-based position within its ``group`` by ``order``, numbered by a global sort."""
    ordered = leaves.sort(F.col(group).asc_nulls_first(), *order)
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ordered = narrow(ordered, "merkle-sorted")
    runs = ordered.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_group = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(by_group), F.lit(0)))
    runs = narrow(runs.select("_part", group, "_first", "_before"), "merkle-runs")
    if runs.count() <= _OFFSETS_BROADCAST:
        runs = F.broadcast(runs)
    cond = (ordered["_part"] == runs["_part"]) & ordered[group].eqNullSafe(runs[group])
    out = ordered.join(runs, cond).select(ordered["*"], (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"))
    return out.drop("_part", "_at")


def _block_levels(hashes: dict[int, str], first: int, count_at, top: int, base: int) -> list[dict[int, str]]:
    """Levels base..top of one aligned block whose base-level nodes are ``hashes`` (index -> digest)."""
    levels = [hashes]
    for level in range(base + 1, top + 1):
        below, width = levels[-1], count_at(level - 1)
        start = first >> (level - base)
        up = {}
        for i in range(start, start + (1 << (base + STRIDE - level))):
            if 2 * i >= width:
                break
            left = below[2 * i]
            up[i] = _h(left + below[2 * i + 1]) if 2 * i + 1 < width else _h(left)
        levels.append(up)
    return levels


def _counts(n0: int):
    return lambda level: -(-n0 // (1 << level))


def _up(base: int):
    """Grouped function: STRIDE levels (or up to the top) above one aligned block of level ``base``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n0, top = int(pdf["n0"].iloc[0]), int(pdf["top"].iloc[0])
        hashes = dict(zip(pdf["idx"].astype("int64"), pdf["h"]))
        first = (int(pdf["idx"].min()) >> STRIDE) << STRIDE
        levels = _block_levels(hashes, first, _counts(n0), min(top, base + STRIDE), base)
        last = levels[-1]
        return pd.DataFrame({"g": pdf["g"].iloc[0], "idx": list(last), "h": list(last.values()), "n0": n0, "top": top})

    return run


def _siblings(base: int):
    """Grouped function: for each node of one aligned block of level ``base``, its siblings up to the block's top."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n0, top = int(pdf["n0"].iloc[0]), int(pdf["top"].iloc[0])
        count_at = _counts(n0)
        hashes = dict(zip(pdf["idx"].astype("int64"), pdf["h"]))
        first = (int(pdf["idx"].min()) >> STRIDE) << STRIDE
        high = min(top, base + STRIDE)
        levels = _block_levels(hashes, first, count_at, high, base)
        paths = []
        for idx in hashes:
            path = []
            for j in range(high - base):
                at = idx >> j
                mate = at ^ 1
                if mate < count_at(base + j):
                    path.append({"left": bool(mate < at), "h": levels[j][mate]})
                else:
                    path.append({"left": False, "h": None})
            paths.append(path)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "idx": list(hashes), "path": paths})

    return run


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (g, idx, h) per group g: (tops: g, h of the top; paths: g, idx, path of each node to its top).

    Only every STRIDE-th level is written; proofs recompute the interior of each aligned block from it.
    """
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n0"))
    # levels above the leaves: the bit length of n0 - 1, in integers
    top = F.when(F.col("n0") <= 1, F.lit(0)).otherwise(F.length(F.bin(F.col("n0") - 1)))
    sizes = narrow(sizes.withColumn("top", top), "merkle-sizes")
    stored = [narrow(nodes.join(sizes, "g").select("g", "idx", "h", "n0", "top"), "merkle-level")]
    base = 0
    while True:
        open_ = stored[-1].filter(F.col("top") > base)
        if open_.isEmpty():
            break
        grouped = open_.groupBy("g", F.shiftright("idx", STRIDE).alias("_block"))
        upper = grouped.applyInPandas(_up(base), "g string, idx long, h string, n0 long, top int")
        stored.append(narrow(upper, "merkle-level"))
        base += STRIDE
    # a group's top lives in the first stored level at or above it, as its only node
    tops = None
    for s, level in enumerate(stored):
        here = level.filter(F.ceil(F.col("top") / STRIDE) == s).select("g", "h")
        tops = here if tops is None else tops.unionByName(here)
    # paths, top-down: a node's path is its siblings within its block followed by the path of its block's top
    above = None
    for s in range(len(stored) - 1, -1, -1):
        level = stored[s].filter(F.col("top") > s * STRIDE)
        grouped = level.groupBy("g", F.shiftright("idx", STRIDE).alias("_block"))
        own = grouped.applyInPandas(_siblings(s * STRIDE), f"g string, idx long, path {PATH}")
        if above is not None:
            join = (own["g"] == above["g"]) & (F.shiftright(own["idx"], STRIDE) == above["idx"])
            own = own.join(above, join, "left").select(own["g"], own["idx"], F.concat(own["path"], F.coalesce(above["path"], F.array().cast(PATH))).alias("path"))
        above = narrow(own, "merkle-paths")
    base_nodes = stored[0].select("g", "idx")
    if above is None:
        paths = base_nodes.withColumn("path", F.array().cast(PATH))
    else:
        paths = base_nodes.join(above, ["g", "idx"], "left").select("g", "idx", F.coalesce("path", F.array().cast(PATH)).alias("path"))
    return narrow(tops, "merkle-tops"), paths


def _fold_one(digest: str | None, path) -> str | None:
    if digest is None:
        return None
    for step in path if path is not None else []:
        mate = step["h"]
        if mate is None:
            digest = _h(digest)
        else:
            digest = _h(mate + digest) if step["left"] else _h(digest + mate)
    return digest


@F.pandas_udf(StringType())
def fold(leaves: pd.Series, paths: pd.Series) -> pd.Series:
    """The top reached from each leaf digest by its path (siblings; none on lone levels)."""
    return pd.Series([_fold_one(d, p) for d, p in zip(leaves, paths)], dtype=object)


@F.pandas_udf(StringType())
def proof_digest(paths: pd.Series) -> pd.Series:
    """H of the siblings' digests concatenated in path order."""
    return pd.Series([_h("".join(s["h"] for s in (p if p is not None else []) if s["h"] is not None)) for p in paths], dtype=object)


def manifest(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with leaf, subroot, root and its proof (a path of siblings leaf to root).

    Needs the columns of FIELDS; other columns pass through, those named like the outputs are replaced. An empty table
    gives an empty result.
    """
    outputs = {"leaf", "subroot", "root", "proof", "proof_sha256"}
    base = docs.select(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c not in outputs])
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in base.columns]).alias("_row")
    leaves = base.select(row, leaf(*[F.col(c) for c in FIELDS]).alias("leaf"), F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"))
    leaves = leaves.withColumn("g", F.when(F.col("_lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("_lang"))))
    placed = positions(leaves, "g", [F.col("_id").asc_nulls_first(), F.col("leaf")])
    subtops, subpaths = tree(placed.select("g", "idx", F.col("leaf").alias("h")))
    # subroots in the order of their lang: null first, then bytewise
    langs = placed.select("g", "_lang").dropDuplicates(["g"])
    subs = subtops.join(langs, "g").select(F.lit("root").alias("root_g"), "g", "_lang", F.col("h").alias("subroot"))
    w = Window.partitionBy("root_g").orderBy(F.col("_lang").asc_nulls_first())
    subs = narrow(subs.withColumn("idx", F.row_number().over(w) - 1), "merkle-subroots")
    roots, rootpaths = tree(subs.select(F.col("root_g").alias("g"), "idx", F.col("subroot").alias("h")))
    upper = subs.join(rootpaths, (subs["root_g"] == rootpaths["g"]) & (subs["idx"] == rootpaths["idx"]))
    upper = upper.join(roots, upper["root_g"] == roots["g"]).select(subs["g"], "subroot", F.col("path").alias("root_path"), roots["h"].alias("root"))
    upper = narrow(upper, "merkle-upper")
    if upper.count() <= _OFFSETS_BROADCAST:
        upper = F.broadcast(upper)
    out = placed.join(subpaths, ["g", "idx"]).join(upper, "g")
    out = out.select("_row.*", "leaf", "subroot", "root", F.concat("path", "root_path").alias("proof"))
    return out.withColumn("proof_sha256", proof_digest("proof"))
