"""SimHash near-duplicate detection by pigeonhole blocks.

A document's fingerprint has bit b set when more than half of its shingle hashes have bit b set. Two fingerprints that
differ in at most ``DISTANCE`` bits agree exactly on at least one of ``DISTANCE + 1`` blocks of bits (pigeonhole), so
candidates are the fingerprints that share a (block, value) key; each candidate pair is verified by its Hamming distance,
and verified links give connected components.

* Words are maximal runs of non-white bytes (``[^\\x20\\x09-\\x0D]+``) after lower-casing A-Z only; shingles are
  ``SHINGLE`` consecutive words joined by one space, repeats included. A text of fewer words has one shingle, the whole
  sequence; a text without words (empty, white space only or null) has fingerprint zero and links like any other.
* Shingle hashes are XXH64 of the UTF-8 shingle with seed 42 (Spark's ``xxhash64``), read as unsigned.
* Equal fingerprints are one node: documents are first reduced to their distinct fingerprints (partial aggregation, so a
  fingerprint that a third of all rows share costs one row per task), and only distinct fingerprints are compared.
* A (block, value) key that many fingerprints share is split: its members are dealt into ``ceil(count / GROUP)`` chunks by
  a hash and every pair of chunks is one task, so no task holds more than about ``2 * GROUP`` fingerprints however large
  the key. A task emits only the links of a spanning forest of its verified pairs, not all pairs.
* component_id is the smallest non-null doc_id reachable (null if every row of the component has a null doc_id). Rows that
  repeat a doc_id and text get the same result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granary.llm import graph
from granary.llm.store import narrow

SHINGLE = 3
DISTANCE = 3
BITS = 64
BLOCKS = DISTANCE + 1
GROUP = 512
# keys of at most this many fingerprints are verified by a self-join
SMALL = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The lower-cased (A-Z only) words of a text; [] for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Signed XXH64 (seed 42) of each shingle of ``words`` (a column, not an expression: lambdas re-evaluate what they
    name), in order; [] for no words."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.least(n, F.lit(shingle))), " "))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(grams, lambda g: F.xxhash64(g)))


def _majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints (signed int64) of the documents whose hashes are ``values[offsets[d]:offsets[d + 1]]``."""
    n_docs = len(offsets) - 1
    counts = np.zeros((n_docs, BITS), np.int64)
    owner = np.repeat(np.arange(n_docs), np.diff(offsets))
    u = values.view(np.uint64)
    shifts = np.arange(BITS, dtype=np.uint64)
    for begin in range(0, len(u), 1 << 16):
        part = u[begin : begin + (1 << 16)]
        bits = ((part[:, None] >> shifts) & np.uint64(1)).astype(np.int64)
        # rows of one document are consecutive: add them per run of equal owners
        who = owner[begin : begin + len(part)]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        counts[who[starts]] += np.add.reduceat(bits, starts, axis=0)
    on = (2 * counts > np.diff(offsets)[:, None]).astype(np.uint64)
    return np.bitwise_or.reduce(on << shifts, axis=1).view(np.int64)


def _fingerprint_batches(batches, hashes: str, out: str):
    for batch in batches:
        column = batch.column(hashes)
        offsets = column.offsets.to_numpy()
        offsets = offsets - offsets[0]
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        prints = _majority(values, offsets) if batch.num_rows else np.zeros(0, np.int64)
        at = batch.schema.get_field_index(hashes)
        yield batch.set_column(at, pa.field(out, pa.int64()), pa.array(prints, pa.int64()))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, the 64-bit SimHash of column ``text`` as a signed long (zero for a text without words).

    Shingle hashes are computed in the JVM; bit majorities are counted in NumPy over whole Arrow batches.
    """
    spare = f"{out}_words"
    worded = df.withColumn(spare, words(F.col(text)))
    hashed = worded.withColumn(spare, shingle_hashes(F.col(spare)))
    schema = StructType([f if f.name != spare else StructField(out, LongType()) for f in hashed.schema.fields])
    return hashed.mapInArrow(lambda batches: _fingerprint_batches(batches, spare, out), schema)


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of the unsigned value of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _block(fp: Column, i: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a spanning forest of the verified pairs (at most DISTANCE differing bits) among one task's fingerprints."""
    fps = np.unique(pdf["fp"].to_numpy(np.int64))
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u = fps.view(np.uint64)
    a_out, b_out = [], []
    for i in range(len(u) - 1):
        x = u[i] ^ u[i + 1 :]
        close = np.flatnonzero(np.bitwise_count(x) <= DISTANCE) + i + 1
        for j in close:
            ri, rj = root(i), root(int(j))
            if ri != rj:
                parent[rj] = ri
                a_out.append(fps[i])
                b_out.append(fps[j])
    return pd.DataFrame({"a": np.asarray(a_out, np.int64), "b": np.asarray(b_out, np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``fps`` (column fp) whose components equal those of all close pairs.

    Keys of at most SMALL fingerprints are verified by a self-join on the key in the JVM; larger ones by chunk-pair tasks
    that keep a spanning forest of their verified pairs.
    """
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)])).alias("k"))
    keyed = keyed.select("fp", "k.block", "k.value")
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    sized = keyed.join(sizes.filter(F.col("n") > 1), ["block", "value"])
    small = sized.filter(F.col("n") <= SMALL).select("block", "value", "fp")
    x, y = small.alias("x"), small.alias("y")
    same = (F.col("x.block") == F.col("y.block")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.fp") < F.col("y.fp"))
    near = x.join(y, same).filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE)
    direct = near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    sized = sized.filter(F.col("n") > SMALL)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)).cast("long")
    sized = sized.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    paired = sized.select("block", "value", "fp", "chunk", other)
    paired = paired.select("block", "value", "fp", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    return direct.unionByName(paired.groupBy("block", "value", "lo", "hi").applyInPandas(_forest, "a long, b long"))


def components(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (needs doc_id, text) with fingerprint (hex) and component_id; other columns pass through."""
    taken = {"fingerprint", "component_id", "_simhash_fp"}
    base = docs.select(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c not in taken])
    printed = narrow(with_fingerprint(base, "text", "_simhash_fp"), "simhash")
    nodes = printed.groupBy(F.col("_simhash_fp").alias("fp")).agg(F.min("doc_id").alias("low_id"))
    nodes = narrow(nodes, "simhash-nodes")
    edges = narrow(links(nodes.select("fp")), "simhash-links")
    comp = graph.components(edges)  # (node, low): low is the smallest fingerprint of the component
    labelled = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low_id", F.coalesce("low", "fp").alias("root"))
    best = labelled.groupBy("root").agg(F.min("low_id").alias("component_id"))
    per_fp = narrow(labelled.join(best, "root").select(F.col("fp").alias("_simhash_fp"), "component_id"), "simhash-components")
    out = printed.join(per_fp, "_simhash_fp", "left")
    return out.select(*base.columns, hex_digits(F.col("_simhash_fp")).alias("fingerprint"), "component_id")
