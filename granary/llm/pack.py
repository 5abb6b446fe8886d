"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens: the ids of the text and one 0 as separator, cut from the end so that
only the first piece may be shorter. Full pieces fill a sequence alone. The others are dealt by hash into
shards of about ``SHARD`` pieces, and each shard is packed by ``ISLANDS`` islands with populations of their own. A
solution is a set of bins; crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold the same pieces, and puts the displaced pieces back best-fit. Between epochs each island's elite moves to
the next island of its shard. Pieces of badly filled bins of all shards are pooled and packed once more.

Null text is empty, so a piece of one separator. Repeated rows are pieces of their own. All tables between epochs are
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import words as W
from granary.llm.store import narrow
from granary.session import scratch_path

CAPACITY = 2048
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 4, 6
WELL_FILLED = 0.95
#: Texts of these signs only are encoded by the faster of two libraries with the same vocabulary and pattern.
_PLAIN = regex.compile(r"[\x20-\x7E\t\n\rÀ-ɏ]*+")


class Encoder:
    """Token ids of texts by the vocabulary at ``path`` (tokenizers); ``ranks`` is the same vocabulary as ranks."""

    cache: dict[tuple, Encoder] = {}

    def __init__(self, path: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = None
        if ranks is not None:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of(cls, *key) -> Encoder:
        if key not in cls.cache:
            cls.cache[key] = cls(*key)
        return cls.cache[key]

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def public_encoder() -> tuple[str, str, str]:
    """Paths of the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pieces(docs: DataFrame, encoder: tuple, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: a key, doc_id, piece, start, length and its ids (unsigned 32 bits, little-endian)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(*encoder)
        for batch in batches:
            for part in W.slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), 0], "<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((doc_id, k, a, b - a, ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
    cut = cut.select(F.monotonically_increasing_id().alias("piece_key"), "*")
    path = scratch_path(docs.sparkSession, "pieces")
    cut.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(cut.schema).parquet(path)


def best_fit(order: list[int], length: list[int], room: list[int], bins: list[int], capacity: int) -> None:
    """Put the pieces in ``order`` into the fullest bin that takes them, or a new one. room: of each bin; bins: of each piece; both are changed."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room[r].append(b)
            mask |= 1 << r
    for i in order:
        need = length[i]
        fits = mask >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        r -= need
        room[b] = r
        if r:
            by_room[r].append(b)
            mask |= 1 << r


class Island:
    """A population of packings of the same pieces."""

    def __init__(self, length: np.ndarray, seed: int, capacity: int = CAPACITY) -> None:
        self.length, self.capacity = length, capacity
        self.sizes = length.tolist()
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(length.sum()) // capacity)
        self.people: list[np.ndarray] = []

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins, then fuller ones; larger is fitter."""
        fill = np.bincount(bins, self.length) / self.capacity
        return -len(fill), float((fill**2).sum())

    def _filled(self, free: np.ndarray, bins: np.ndarray, room: np.ndarray, jitter: float) -> np.ndarray:
        """Best-fit the free pieces by falling length, with the order disturbed by ``jitter``."""
        key = -self.length[free] * (1 + jitter * self.rng.random(len(free)))
        bins, room = bins.tolist(), room.tolist()
        best_fit(free[np.argsort(key, kind="stable")].tolist(), self.sizes, room, bins, self.capacity)
        return np.array(bins, np.int32)

    def settle(self, size: int) -> None:
        n = len(self.length)
        for k in range(size):
            self.people.append(self._filled(np.arange(n), np.zeros(n, np.int32), np.zeros(0, np.int32), 0.15 * k))

    def child(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Packing ``a`` with some well-filled bins of ``b`` injected."""
        fill = np.bincount(b, self.length)
        good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 2), replace=False)] = True
        injected = chosen[b]
        n_a = int(a.max()) + 1
        broken = np.zeros(n_a, bool)
        broken[a[injected]] = True
        # mutation: some of the emptiest bins are emptied too
        left = np.where(broken, self.capacity, np.bincount(a, self.length, n_a))
        broken[np.argsort(left, kind="stable")[: 1 + n_a // 50]] = True
        stays = ~broken[a] & ~injected
        bins = np.full(len(a), -1, np.int64)
        bins[stays] = a[stays]
        bins[injected] = n_a + b[injected]
        placed = bins >= 0
        used, bins[placed] = np.unique(bins[placed], return_inverse=True)
        room = self.capacity - np.bincount(bins[placed], self.length[placed], len(used)).astype(np.int64)
        return self._filled(np.flatnonzero(~placed), bins, room, 0.05)

    def evolve(self, generations: int) -> None:
        for _ in range(generations):
            self.people.sort(key=self.fitness, reverse=True)
            if self.fitness(self.people[0])[0] == -self.least:
                return
            size = len(self.people)
            for _ in range(size // 2):
                i, j = self.rng.choice(size, 2, replace=False)
                self.people.append(self.child(self.people[min(i, j)], self.people[max(i, j)]))
            self.people = sorted(self.people, key=self.fitness, reverse=True)[:size]


_STATE = "shard long, island int, keys binary, lengths binary, people array<binary>, n_bins int, badness double"
_STATE_ARROW = pa.schema(
    [("shard", pa.int64()), ("island", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("people", pa.list_(pa.binary())), ("n_bins", pa.int32()), ("badness", pa.float64())]
)


def _state(shard: int, number: int, keys: np.ndarray, island: Island) -> pa.RecordBatch:
    island.people.sort(key=island.fitness, reverse=True)
    n_bins, full = island.fitness(island.people[0])
    row = {"shard": shard, "island": number, "keys": keys.tobytes(), "lengths": island.length.astype(np.int32).tobytes(), "people": [p.astype(np.int32).tobytes() for p in island.people], "n_bins": -n_bins, "badness": -full}
    return pa.RecordBatch.from_pylist([row], schema=_STATE_ARROW)


def _settle(items: DataFrame, shards: int, capacity: int) -> DataFrame:
    """First populations from (piece_key, length): one row per shard and island."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.select(F.pmod(F.xxhash64("piece_key"), F.lit(shards)).alias("shard"), "piece_key", F.col("length").cast("int").alias("length"))
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "piece_key")

    def settled(shard: int, keys: list[int], lengths: list[int]) -> Iterator[pa.RecordBatch]:
        for number in range(ISLANDS):
            island = Island(np.array(lengths, np.int64), 1000 * number + shard % 1000, capacity)
            island.settle(POPULATION)
            island.evolve(GENERATIONS)
            yield _state(shard, number, np.array(keys, np.int64), island)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, lengths = None, [], []
        for batch in batches:
            for shard, key, length in zip(*(batch.column(n).to_pylist() for n in ("shard", "piece_key", "length")), strict=True):
                if shard != current:
                    if keys:
                        yield from settled(current, keys, lengths)
                    current, keys, lengths = shard, [], []
                keys.append(key)
                lengths.append(length)
        if keys:
            yield from settled(current, keys, lengths)

    return dealt.mapInArrow(run, _STATE)


def _epoch(states: DataFrame, number: int, capacity: int) -> DataFrame:
    """Each island takes in its neighbour's elite and evolves on."""
    elite = states.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.get("people", F.lit(0)).alias("guest"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                island = Island(np.frombuffer(row["lengths"], np.int32).astype(np.int64), 10_000 * number + 1000 * row["island"] + row["shard"] % 1000, capacity)
                island.people = [np.frombuffer(p, np.int32) for p in [*row["people"][: POPULATION - 1], row["guest"]]]
                island.evolve(GENERATIONS)
                yield _state(row["shard"], row["island"], np.frombuffer(row["keys"], np.int64), island)

    return states.join(elite, ["shard", "island"]).mapInArrow(run, _STATE)


def _evolve(items: DataFrame, shards: int, label: int, capacity: int) -> DataFrame:
    """(piece_key, length, sequence_id, offset, fill) by the best island of each shard."""
    states = narrow(_settle(items, shards, capacity), "islands")
    for number in range(1, EPOCHS):
        states = narrow(_epoch(states, number, capacity), "islands")
    best = states.groupBy("shard").agg(F.min(F.struct("n_bins", "badness", "island")).alias("best"))
    best = best.select("shard", F.col("best.island").alias("island"))
    schema = pa.schema([("piece_key", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, length = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                bins = np.frombuffer(row["people"][0], np.int32).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(length[order])
                fill = np.bincount(bins, length).astype(np.int64)
                offset = np.empty(len(bins), np.int64)
                offset[order] = ends - length[order] - (np.cumsum(fill) - fill)[bins[order]]
                ids = (label << 60) + (row["shard"] << 20) + bins
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, length, ids, offset, fill[bins])], schema=schema)

    found = states.join(best, ["shard", "island"])
    return found.mapInArrow(run, "piece_key long, length long, sequence_id long, offset long, fill long")


@dataclass
class Packing:
    """The pieces, and (piece_key, sequence_id, offset) of each."""

    pieces: DataFrame
    plan: DataFrame

    def sequences(self) -> DataFrame:
        """The packed sequences: their ids in order, one row each."""
        placed = self.pieces.join(self.plan, "piece_key").groupBy("sequence_id")
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # one sequence: no more than its capacity
        return placed.agg(F.sum("length").alias("length"), parts.alias("parts")).select(
            "sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"])).alias("ids")
        )


def pack(docs: DataFrame, encoder: tuple | None = None, capacity: int = CAPACITY) -> Packing:
    """Pack (doc_id, text) rows."""
    cut = pieces(docs, encoder or public_encoder(), capacity)
    full = cut.filter(F.col("length") == capacity).select("piece_key", (-1 - F.col("piece_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cut.filter(F.col("length") < capacity).select("piece_key", "length")
    first = narrow(_evolve(items, max(1, -(-items.count() // SHARD)), 0, capacity), "packed")
    good = F.col("fill") >= WELL_FILLED * capacity
    pool = first.filter(~good).select("piece_key", "length")
    again = narrow(_evolve(pool, max(1, -(-pool.count() // SHARD)), 1, capacity), "packed")
    columns = ["piece_key", "sequence_id", "offset"]
    plan = full.select(*columns).unionByName(first.filter(good).select(*columns)).unionByName(again.select(*columns))
    return Packing(cut, plan)
