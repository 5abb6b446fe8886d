"""Near-duplicate join on word shingles with Bayesian pruning of candidates.

Texts are sets of hashed five-word shingles. Equal sets are one class, represented by their smallest id; all
that follows is between representatives. Those that agree in a band of MinHash values are candidates. Their
values are compared some at a time, and a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold, given the matches so far and a uniform prior, falls below
``TOLERANCE``. Pairs that outlive all values are verified on the whole sets.

A bucket or cluster of many documents is never paired up in rows: it is cut into blocks, pairs of
blocks are compared in matrices, and only a spanning forest and counts of links leave a task. Bands find a pair at the
threshold with probability 1 - (1 - 0.8**4)**24 > 0.999996.

Words are runs of other signs than white space. A text of fewer than five words has one shingle of all its words;
null and empty texts have none and no links. Rows that share an id are united. Null ids count as the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import graph
from granary.llm import words as W
from granary.llm.exact import join_counted
from granary.llm.repeats import NO_ID
from granary.llm.store import narrow
from granary.session import materialize

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, VALUES, STEP = 24, 4, 128, 16
#: Documents of a block; a bucket or cluster of more is cut. And the ids of clusters that are broadcast at most (16 bytes each).
BUCKET_BLOCK, CLUSTER_BLOCK, BROADCAST_IDS = 4096, 256, 1_000_000

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@dataclass
class Sketches:
    """Shingle sets of some texts (hashes sorted within each text) and their MinHash values."""

    hashes: np.ndarray
    at: np.ndarray  # one more than texts

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)

    def values(self) -> np.ndarray:
        """MinHash values, a row per text; of an empty set all are the largest value."""
        out = np.full((len(self.at) - 1, VALUES), np.iinfo(np.uint32).max, np.uint32)
        full = np.flatnonzero(self.size)
        if len(full):
            low = (self.hashes >> np.uint64(32)).astype(np.uint32)
            for k in range(VALUES):
                out[full, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], self.at[full])
        return out

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that equal sets share."""
        full = np.flatnonzero(self.size)
        out = np.zeros((2, len(self.at) - 1), np.uint64)
        if len(full):
            for k in range(2):
                out[k, full] = np.add.reduceat(W.mix(self.hashes ^ np.uint64(0x51ED27 + k)), self.at[full])
        return out[0].view(np.int64), out[1].view(np.int64)


def shingles(column: pa.Array) -> Sketches:
    data, at = W.raw(column)
    begin, end, first = W.words(data, at)
    units = W.word_hashes(data, begin, end)
    n = np.diff(first)
    grams = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), grams)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + first[owner]
    hashes = W.range_hashes(units, start, np.minimum(start + SHINGLE, first[owner + 1]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return Sketches(hashes[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))]).astype(np.int64))


def _band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.empty((len(values), BANDS), np.uint64)
    for band in range(BANDS):
        x = np.full(len(values), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            x = W.mix(x * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
        keys[:, band] = x
    return keys.view(np.int64)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, values: int = VALUES) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior the similarity given m matches of n is Beta(m + 1, n - m + 1), which exceeds t with the
    probability that a binomial variable of n + 1 trials at t is m or less.
    """
    out = []
    for n in range(step, values + 1, step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row numbers of ``b`` (MinHash values) that are not dropped against the row ``a``."""
    left = np.arange(len(b))
    matches = np.zeros(len(b), np.int32)
    for k, least in enumerate(least_matches()):
        own = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (b[left, own] == a[own]).sum(axis=1)
        kept = matches >= least
        left, matches = left[kept], matches[kept]
        if not len(left):
            break
    return left


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect rows exactly as all surviving pairs do, by search from row to row."""
    rest, edges = np.arange(len(values)), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            found = survivors(values[a], values[rest])
            if len(found):
                new = rest[found]
                edges += [(a, int(b)) for b in new]
                queue += new.tolist()
                rest = np.delete(rest, found)
    return edges


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys of sorted batches."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows


def _blocks(rows: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that holds its own: columns ``one`` and ``two``, and its own ``block``."""
    n = F.ceil(F.col(count) / block).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", count)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key, "one", "two").sortWithinPartitions(key, "one", "two", "doc_id")


def _candidate_edges(sketches: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what survives the pruning within buckets."""
    bands = sketches.select("doc_id", F.explode("keys").alias("key"))
    counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    hits = bands.join(counts, "key").join(sketches.select("doc_id", "values"), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: tuple[list, list] = [], []
        for _, rows in _groups(batches, ["key", "one", "two"]):
            values = np.frombuffer(b"".join(r["values"] for r in rows), np.uint32).reshape(len(rows), VALUES)
            for i, j in forest(values):
                ends[0].append(rows[i]["doc_id"])
                ends[1].append(rows[j]["doc_id"])
            if len(ends[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])
                ends = [], []
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    return _blocks(hits, "key", "n", BUCKET_BLOCK).mapInArrow(run, "a long, b long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair."""
    if len(pairs[0]) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(*pairs, strict=True)], np.int64)
    used, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    width = 1 << 13
    for low in range(0, len(used), width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(a) + len(b), min(width, len(used) - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        total += part[: len(a)] @ part[len(a) :].T
    return np.rint(total[pairs]).astype(np.int64)


def links(a: list[dict], b: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of two blocks (row numbers), or of one with itself."""
    own = b is None
    b = a if own else b
    sets = [[np.frombuffer(r["hashes"], np.uint64) for r in x] for x in (a, b)]
    values = [np.frombuffer(b"".join(r["values"] for r in x), np.uint32).reshape(len(x), VALUES) for x in (a, b)]
    size = [np.array([len(s) for s in x]) for x in sets]
    i, j = np.nonzero(np.minimum.outer(size[0], size[1]) >= THRESHOLD * np.maximum.outer(size[0], size[1]))
    if own:
        i, j = i[i < j], j[i < j]
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (values[0][i, part] == values[1][j, part]).sum(axis=1)
        kept = matches >= least
        i, j, matches = i[kept], j[kept], matches[kept]
    if not len(i):
        return i, j
    both = _overlaps(*sets, (i, j))
    kept = both >= THRESHOLD * (size[0][i] + size[1][j] - both)
    return i[kept], j[kept]


def _verified(members: DataFrame) -> DataFrame:
    """Rows of two kinds from (cluster, n, doc_id, copies, hashes, values): links counted for ``a`` (b null), and edges (a, b) that connect what is linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_texts", pa.int64()), ("n_links", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, two), rows in _groups(batches, ["cluster", "one", "two"]):
            a = [r for r in rows if r["block"] == one]
            b = [r for r in rows if r["block"] == two] if one != two else None
            i, j = links(a, b)
            if not len(i):
                continue
            b, offset = (a, 0) if b is None else (b, len(a))
            nodes = a if offset == 0 else [*a, *b]
            ids, copies = np.array([r["doc_id"] for r in nodes]), np.array([r["copies"] for r in nodes])
            ends = np.concatenate([i, j + offset]), np.concatenate([j + offset, i])
            texts = np.bincount(ends[0], minlength=len(nodes))
            docs = np.bincount(ends[0], copies[ends[1]], len(nodes)).astype(np.int64)
            linked = np.flatnonzero(texts)
            tree = _tree(i, j + offset, len(nodes))
            columns = [
                np.concatenate([ids[linked], ids[tree[0]]]), pa.array([None] * len(linked) + ids[tree[1]].tolist(), pa.int64()),
                np.concatenate([texts[linked], np.zeros(len(tree[0]), np.int64)]), np.concatenate([docs[linked], np.zeros(len(tree[0]), np.int64)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return _blocks(members, "cluster", "n", CLUSTER_BLOCK).mapInArrow(run, "a long, b long, n_texts long, n_links long")


def _tree(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that it is connected with."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    moved = np.flatnonzero(low != np.arange(n))
    return low[moved], moved


def _sketched(docs: DataFrame, columns: list[str], schema: str, make: Callable[[pa.RecordBatch, Sketches], list]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                arrays = make(part, shingles(part.column("text")))
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return docs.select(*columns).mapInArrow(run, schema)


def _bytes(x: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of all that it is linked with, over any number of links),
    copy_id (smallest id with the same set), n_copies (rows with that set), n_texts (other sets at the threshold or above)
    and n_links (other rows at the threshold or above, copies included).
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")

    def first(part: pa.RecordBatch, s: Sketches) -> list:
        values = s.values()
        keys = pa.FixedSizeListArray.from_arrays(pa.array(_band_keys(values).ravel()), BANDS).cast(pa.list_(pa.int64()))
        one, two = s.digests()
        flat = _bytes(values.ravel(), np.arange(len(values) + 1) * VALUES)
        return [part.column("doc_id"), pa.array(s.size.astype(np.int32)), pa.array(one), pa.array(two), flat, keys]

    sketches = materialize(_sketched(docs, ["doc_id", "text"], "doc_id long, size int, one long, two long, values binary, keys array<bigint>", first), "sketches")
    digest = F.struct("one", "two", "size").alias("digest")
    ids = sketches.filter(F.col("size") > 0).select("doc_id", digest)
    classes = narrow(ids.groupBy("digest").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies")), "classes")
    heads = sketches.filter(F.col("size") > 0).join(classes.select(F.col("copy_id").alias("doc_id"), F.col("digest.*")), ["doc_id", "one", "two", "size"], "left_semi")
    heads = materialize(heads.dropDuplicates(["doc_id"]).select("doc_id", "values", "keys"), "heads")

    clusters = graph.components(_candidate_edges(heads)).select(F.col("node").alias("doc_id"), F.col("low").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    clusters = clusters.join(sizes, "cluster").join(classes.select(F.col("copy_id").alias("doc_id"), F.col("n_copies").alias("copies")), "doc_id")
    clusters = narrow(clusters.select("doc_id", "cluster", "n", "copies"), "clusters")
    few = clusters.count() <= BROADCAST_IDS
    inside = docs.join(F.broadcast(clusters) if few else clusters, "doc_id")

    def second(part: pa.RecordBatch, s: Sketches) -> list:
        values = s.values()
        return [*(part.column(n) for n in ("doc_id", "cluster", "n", "copies")), _bytes(s.hashes, s.at), _bytes(values.ravel(), np.arange(len(values) + 1) * VALUES)]

    members = _sketched(inside, ["doc_id", "cluster", "n", "copies", "text"], "doc_id long, cluster long, n long, copies long, hashes binary, values binary", second)
    found = narrow(_verified(members), "links")
    counts = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("linked"))
    joined = graph.components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    about = classes.join(counts, classes["copy_id"] == counts["a"], "left").drop("a")
    about = about.join(joined, about["copy_id"] == joined["node"], "left").select(
        "digest", "copy_id", "n_copies", F.coalesce("low", "copy_id").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        (F.coalesce("linked", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
    )
    about = narrow(about, "classes")
    names = ["doc_id", "class_id", "copy_id", "n_copies", "n_texts", "n_links"]
    alone = sketches.filter(F.col("size") == 0).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
        *[F.lit(n).cast("long").alias(name) for name, n in zip(names[3:], (1, 0, 0), strict=True)],
    )
    out = join_counted(ids, about, "digest", "n_copies").select(*names).unionByName(alone)
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(*[no_id(c) for c in names[:3]], *names[3:])

