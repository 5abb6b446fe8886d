"""Code length of documents by prediction by partial matching over bytes.

The trie of byte contexts is the table of all (``ORDER`` + 1)-grams of the training texts with their counts; shorter
contexts are its marginal sums. A byte is coded in the longest context that has been seen; if it never followed there,
an escape is coded and the next shorter context is tried with the symbols of the longer one excluded. Escapes take half a count from
each different symbol of the context. Beneath order 0 all remaining byte values are equally likely.

A text is the lower-cased bytes (A-Z only) of its words, a space after each but the last and a line feed at its end;
the context of its first byte is line feeds. Null is empty, so only the end is coded.

The trie is broadcast in shards of at most ``SHARD`` grams by the two bytes before the coded one, each with one pass over the
documents; one shard is the usual case. Counts of words meet the documents in two ways: the ``HEAD`` most frequent words
at most are broadcast, all others are joined by shuffle. Words are told apart by 64 bits of their hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import words as W
from granary.session import materialize

ORDER, SHARD, HEAD = 5, 4_000_000, 1 << 17
END, SPACE = 10, 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = [np.uint64((1 << (8 * n)) - 1) for n in range(9)]


def streams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coded bytes of all texts, where each begins (one more: the end), hashes of their words, and words before each text."""
    data, at = W.raw(column)
    data = _LOWER[data]
    begin, end, first = W.words(data, at)
    hashes = W.word_hashes(data, begin, end)
    n_words, size = np.diff(first), end - begin
    bare = n_words == 0
    solid = np.flatnonzero(~W.WHITE[data])
    owner = np.repeat(np.arange(len(n_words)), n_words)
    empty_before = np.cumsum(bare) - bare
    shift = np.arange(len(begin)) + empty_before[owner]
    sums = np.cumsum(size)
    out = np.full(len(solid) + len(begin) + int(bare.sum()), SPACE, np.uint8)
    out[np.arange(len(solid)) + np.repeat(shift, size)] = data[solid]
    letters = np.concatenate([[0], sums])[first]
    stops = letters + first + np.concatenate([[0], np.cumsum(bare)])
    out[stops[1:] - 1] = END
    return out, stops, hashes, first


def grams(stream: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The coded byte and the ``order`` bytes before it as one number, the coded byte lowest."""
    out = stream.astype(np.uint64)
    place = np.arange(len(stream)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, order + 1):
        before = np.full(len(stream), END, np.uint64)
        before[k:] = stream[:-k] if k else stream
        before[place < k] = END
        out |= before << np.uint64(8 * k)
    return out


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): counts of words (kind 0) and of grams (kind 1), added up in each task first."""

    def flush(total: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for kind, parts in total.items():
            if parts:
                key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])
                parts.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {0: [], 1: []}
        held = 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                stream, at, hashes, _ = streams(part.column("text"))
                for kind, keys in ((0, hashes.view(np.int64)), (1, grams(stream, at, order).view(np.int64))):
                    total[kind].append(np.unique(keys, return_counts=True))
                    held += len(total[kind][-1][0])
                if held > 4_000_000:
                    yield from flush(total)
                    held = 0
        yield from flush(total)

    found = docs.select("text").mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


#: The trie that this worker built last, by name.
_CACHE: dict[str, Trie] = {}


class _Table:
    """Places of keys by hashing, many at a time; -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]  # of those that want one slot, one wins
            won = self.places[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.places[slot]
        miss = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            out[miss] = self.places[slot[miss]]
            miss = miss[(out[miss] >= 0) & (self.keys[slot[miss]] != keys[miss])]
        return out


class Trie:
    """Code lengths from grams and counts of one shard, and the counts of pairs (order 1) of all shards."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        self.entries: list[np.ndarray] = []  # sorted keys (context and symbol) of each order
        self.n: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        for k in range(order + 1):
            key, count = (pairs, pair_n) if k < 2 else (keys, n)
            short, where = np.unique(key & _MASK[k + 1], return_inverse=True)
            count = np.bincount(where, count, len(short))
            context, where = np.unique(short >> np.uint64(8), return_inverse=True)
            self.entries.append(short)
            self.n.append(count)
            self.contexts.append(context)
            self.total.append(np.bincount(where, count, len(context)))
            self.symbols.append(np.bincount(where, minlength=len(context)).astype(np.float64))
        # for each context: what its symbols count in the context that is one byte shorter
        self.excluded = [np.zeros(len(self.contexts[0]))]
        for k in range(1, order + 1):
            below = np.searchsorted(self.entries[k - 1], self.entries[k] & _MASK[k])
            where = np.searchsorted(self.contexts[k], self.entries[k] >> np.uint64(8))
            self.excluded.append(np.bincount(where, self.n[k - 1][below], len(self.contexts[k])))
        where = np.searchsorted(self.contexts[order], self.entries[order] >> np.uint64(8))
        self.top = np.log10((self.n[order] - 0.5) / self.total[order][where]) if len(where) else np.zeros(0)
        self.table = _Table(self.entries[order])

    @staticmethod
    def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
        return np.where(sorted_keys[at] == keys, at, -1) if len(sorted_keys) else np.full(len(keys), -1)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        place = self.table.find(keys)
        out = np.zeros(len(keys))
        seen = place >= 0
        out[seen] = self.top[place[seen]]
        left = np.flatnonzero(~seen)
        longer = np.full(len(left), -1)  # the context escaped from, of the order above
        for k in range(self.order, -1, -1):
            if not len(left):
                return out
            key = keys[left]
            context = self._place(self.contexts[k], (key >> np.uint64(8)) & _MASK[k])
            known = context >= 0
            c = np.maximum(context, 0)
            excluded, fewer = np.zeros(len(left)), np.zeros(len(left))
            if k < self.order:
                escaped = longer >= 0
                excluded[escaped] = self.excluded[k + 1][longer[escaped]]
                fewer[escaped] = self.symbols[k + 1][longer[escaped]]
            new = self.symbols[k][c] - fewer if len(self.symbols[k]) else np.zeros(len(left))
            whole = self.total[k][c] - excluded if len(self.total[k]) else np.zeros(len(left))
            entry = self._place(self.entries[k], key & _MASK[k + 1])
            coded = known & (entry >= 0)
            out[left[coded]] += np.log10((self.n[k][entry[coded]] - 0.5) / whole[coded])
            escape = known & ~coded & (new > 0)  # without a new symbol an escape is certain
            out[left[escape]] += np.log10(0.5 * new[escape] / whole[escape])
            left, longer = left[~coded], context[~coded]
        if len(left):
            out[left] -= np.log10(max(1.0, 256 - (self.symbols[0][0] if len(self.symbols[0]) else 0)))
        return out


def _shard_of(key, shards: int):
    """The shard of a gram: by the two bytes before its last."""
    return F.pmod(F.xxhash64(F.shiftright(key, 8).bitwiseAND(0xFFFF)), F.lit(shards))


def train(docs: DataFrame, order: int = ORDER, shard: int = SHARD) -> dict:
    """Counts of the words and grams of (text) rows: tables in the shared folder, and totals."""
    counts = materialize(_counts(docs, order), "counts")
    n_docs = docs.count()
    words = counts.filter(F.col("kind") == 0).select(F.col("key").alias("word"), "n")
    trie = counts.filter(F.col("kind") == 1).select("key", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return {
        "words": words, "trie": trie, "order": order, "shards": max(1, -(-trie.count() // shard)), "n_docs": n_docs,
        "tokens": tokens + n_docs, "distinct": distinct + (n_docs > 0),
    }


def _arrays(rows: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select(key, "n").toArrow().sort_by(key)
    return found.column(key).to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64)


def _head(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, ``most`` at the very most, by steps of an eighth of an octave of their counts."""
    step = F.floor(F.log2(F.col("n")) * 8)
    steps = sorted(((r["step"], r["n"]) for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in steps:  # at most 512 steps
        total += n
        if total > most:
            break
        least = at
    return _arrays(words.filter(step >= least), "word") if least is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scores(docs: DataFrame, model: dict, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score (words one by one) and score (this model)."""
    spark = docs.sparkSession
    words, known = _head(model["words"], head)
    pairs = model["trie"].groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n"))
    pair_keys, pair_n = _arrays(pairs, "key")
    order, shards = model["order"], model["shards"]
    rest = np.log10(model["tokens"] + 0.5 * (model["distinct"] + 1))
    end = np.log10(model["n_docs"] + 0.5)
    gains = np.log10(known + 0.5)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    # which two bytes before the coded one belong to which shard; what no shard has seen, the first one codes
    owner = np.zeros(1 << 16, np.int32)
    for r in model["trie"].select(context.alias("context"), _shard_of(F.col("key"), shards).alias("shard")).distinct().collect() if shards > 1 else ():
        owner[r["context"]] = r["shard"]

    def scored(number: int) -> DataFrame:
        """The part of the score that the shard codes; with the first shard, also the words."""
        keys, n = _arrays(model["trie"].filter(_shard_of(F.col("key"), shards) == number), "key")
        trie, name = spark.sparkContext.broadcast((words, gains, keys, n, pair_keys, pair_n)), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, gains, keys, n, pair_keys, pair_n = trie.value
            tree = _CACHE.get(name)
            if tree is None:
                _CACHE.clear()
                tree = _CACHE[name] = Trie(keys.view(np.uint64), n, pair_keys.view(np.uint64), pair_n, order)
            for batch in batches:
                for part in W.slices(batch, "text"):
                    stream, at, hashes, first = streams(part.column("text"))
                    gram = grams(stream, at, order)
                    if shards == 1:
                        bits = tree.log10(gram)
                    else:
                        own = owner[((gram >> np.uint64(8)) & _MASK[2]).astype(np.int64)] == number
                        bits = np.zeros(len(gram))
                        bits[own] = tree.log10(gram[own])
                    score = np.add.reduceat(bits, at[:-1])
                    if number:
                        yield _records([part.column("row"), score], ["row", "score"])
                        continue
                    yield _words(part, score, hashes.view(np.int64), first, words, gains, end)

        columns = "row long, score double" if number else _WORDS
        return docs.mapInArrow(run, columns)

    first = materialize(scored(0), "scores")
    rare = first.select("row", F.posexplode("rare").alias("at", "word"), "rare_n").select("row", "word", F.get("rare_n", F.col("at")).alias("times"))
    counts = model["words"].select("word", "n")
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known")
    )
    out = first.join(found, "row", "left")
    for number in range(1, shards):
        part = materialize(scored(number), "scores").select("row", F.col("score").alias(f"score_{number}"))
        out = out.join(part, "row")
    score = F.col("score")
    for number in range(1, shards):
        score = score + F.col(f"score_{number}")
    n_tokens = F.col("n_words") + 1
    return out.select(
        "doc_id", n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(model["n_docs"] > 0))).alias("n_known"),
        F.lit(int(model["tokens"])).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("more", F.lit(0.0)) - n_tokens * F.lit(float(rest))).alias("base_score"), score.alias("score"),
    )


_WORDS = "row long, doc_id long, score double, n_words long, known long, gain double, rare array<long>, rare_n array<long>"


def _records(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _words(part: pa.RecordBatch, score: np.ndarray, hashes: np.ndarray, first: np.ndarray, words: np.ndarray, gains: np.ndarray, end: float) -> pa.RecordBatch:
    """Rows of ``_WORDS``: sums over frequent words, and the others with how often they occur."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    word, text = hashes[order], owner[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(word)))
    word, text = word[at], text[at]
    place = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
    frequent = words[place] == word if len(words) else np.zeros(len(word), bool)
    gain = np.bincount(text[frequent], gains[place[frequent]] * times[frequent], n) + end
    known = np.bincount(text[frequent], times[frequent], n).astype(np.int64)
    rare = ~frequent
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=n))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (word[rare], times[rare])]
    return _records([part.column("row"), part.column("doc_id"), score, np.diff(first).astype(np.int64), known, gain, *lists], [c.split()[0] for c in _WORDS.split(", ")])
