"""Toxicity by a convolutional classifier of words, trained in NumPy.

A word's vector is the sum of hashed embeddings of the word and of its first four and six bytes, so rare
inflections share what their stem has taught. Filters over one, two and three words are max-pooled over the whole
text and feed one logistic unit. Training takes every labelled row, whole texts; a quarter of either label is kept back to
calibrate a threshold for each language, from all the rows kept back; the
language is predicted from the text (see ``langid``), never read. Scores are shifted so that each language's threshold is 0.5.

The rows taught are dealt by a hash of their id into shards of about ``SHARD_ROWS``, one task each. Every round each shard goes on
from the common net for ``EPOCHS`` epochs, and the changes are averaged: those of an embedding over the shards that met it,
all others over all shards. The language machines are trained on the same shards and averaged by rows.

Null and empty texts have a score too. Without labels of both kinds every score is the share of positive labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import langid
from granary.llm import words as W
from granary.operators.scan import rank_within, running
from granary.session import discard, materialize

SLOTS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
PREFIXES = (4, 6)
SHARD_ROWS, SHARD_WORDS = 4096, 4_000_000
ROUNDS, EPOCHS = 2, 3
CHUNK = 4096
BLOCK = 2304
MOST_BROADCAST, MOST_BITS = 1_000_000, 1 << 29
PAD = max(WIDTHS) - 1
_PLACES = [(w, k) for w in WIDTHS for k in range(w)]

#: Bytes of words: letters and digits of ASCII and everything beyond it.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Folded bytes, begin and end of each word, and the number of words before each text (one more: all words)."""
    data, at = W.raw(column)
    data = _LOWER[data]
    if len(data):
        # capitals of the Latin-1 letters, two bytes each in UTF-8
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[upper] += 32
    text = np.where(_WORD[data], data, np.uint8(32))
    return text, *W.words(text, at)


def slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding slots (word, prefixes) of all words, ``PAD`` rows of slot 0 after each text, and where texts begin."""
    text, begin, end, first = _words(column)
    hashes = W.prefix_hashes(text, begin, end, (None, *PREFIXES))
    found = ((hashes >> np.arange(17, 18 + len(PREFIXES), dtype=np.uint64)) % np.uint64(SLOTS - 1) + np.uint64(1)).astype(np.uint16)
    n = len(column)
    out = np.zeros((len(begin) + PAD * n, found.shape[1]), np.uint16)
    owner = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(begin)) + PAD * owner] = found
    return out, first + PAD * np.arange(n + 1)


@dataclass
class ConvNet:
    """Embeddings, filters (for each place of each width a matrix), biases, and the logistic unit."""

    embed: np.ndarray
    filters: np.ndarray  # (places, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray  # (widths * FILTERS)
    level: np.ndarray  # (1)

    @classmethod
    def fresh(cls, seed: int) -> ConvNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.1, (SLOTS, DIM)).astype(np.float32)
        embed[0] = 0
        filters = rng.normal(0, 0.3, (len(_PLACES), DIM, FILTERS)).astype(np.float32)
        size = len(WIDTHS) * FILTERS
        return cls(embed, filters, np.zeros(size, np.float32), rng.normal(0, 0.3, size).astype(np.float32), np.zeros(1, np.float32))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed.take(ids[:, 0], axis=0)
        for k in range(1, ids.shape[1]):
            x += self.embed.take(ids[:, k], axis=0)
        return x

    def maps(self, x: np.ndarray) -> np.ndarray:
        """Responses of all filters at each place; beyond the end there is padding."""
        n = len(x)
        filters = self.filters.transpose(1, 0, 2).reshape(DIM, -1)
        maps = np.empty((n, len(WIDTHS), FILTERS), np.float32)
        cuts = [*range(0, max(1, n - BLOCK + 1), BLOCK), n]  # what a step makes stays in the processor's cache
        for begin, end in zip(cuts, cuts[1:]):
            parts = (x[begin:end] @ filters).reshape(-1, len(_PLACES), FILTERS)
            at = 0
            for w, width in enumerate(WIDTHS):
                maps[begin:end, w] = parts[:, at]
                for k in range(1, width):
                    skip = max(0, k - begin)  # before the first place
                    maps[begin + skip - k : end - k, w] += parts[skip:, at + k]
                at += width
        return maps.reshape(n, -1)

    def logits(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """begin: one more than texts; the padding of a text may pool too, as an empty place."""
        pooled = np.maximum.reduceat(self.maps(self.vectors(ids)), begin[:-1], axis=0) if len(begin) > 1 else np.zeros((0, len(self.bias)), np.float32)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.level[0]


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.state, self.step = rate, {}, 0

    def apply(self, name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m[rows] = own_m = (0.9 * m[rows] + 0.1 * grad).astype(m.dtype, copy=False)
        v[rows] = own_v = (0.99 * v[rows] + 0.01 * grad**2).astype(v.dtype, copy=False)
        fix = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        value[rows] -= fix * own_m / (np.sqrt(own_v) + 1e-8)


def _gradients(net: ConvNet, ids: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: _Adam) -> None:
    x = net.vectors(ids)
    maps = net.maps(x)
    n, size = len(y), maps.shape[1]
    top = np.maximum.reduceat(maps, begin[:-1], axis=0)
    where = np.empty((n, size), np.int64)
    for d in range(n):
        where[d] = begin[d] + np.argmax(maps[begin[d] : begin[d + 1]], axis=0)
    hidden = np.maximum(top + net.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.level[0], -30, 30)))
    d_logit = ((p - y) * weight / weight.sum()).astype(np.float32)
    d_hidden = np.outer(d_logit, net.out) * (hidden > 0)
    adam.step += 1
    d_filters = np.zeros_like(net.filters)
    rows, values = [], []
    padded = np.vstack([x, np.zeros((PAD, DIM), np.float32)])
    ids = np.vstack([ids, np.zeros((PAD, ids.shape[1]), ids.dtype)])
    for place, (width, k) in enumerate(_PLACES):
        own = slice((width - 1) * FILTERS, width * FILTERS)
        at = where[:, own] + k
        d = d_hidden[:, own]
        d_filters[place] = np.einsum("df,dfe->ef", d, padded[at])
        rows.append(ids[at].reshape(-1, ids.shape[1]))
        values.append((d[:, :, None] * net.filters[place].T[None]).reshape(-1, DIM))
    rows, values = np.concatenate(rows), np.concatenate(values)
    flat = rows.T.ravel()
    used, inverse = np.unique(flat, return_inverse=True)
    d_embed = np.zeros((len(used), DIM), np.float32)
    cells = inverse.reshape(-1, 1) * DIM + np.arange(DIM)  # single cells are added up much faster than rows
    np.add.at(d_embed.reshape(-1), cells.ravel(), np.tile(values.ravel(), rows.shape[1]))
    d_embed[used == 0] = 0
    adam.apply("filters", net.filters, d_filters)
    adam.apply("bias", net.bias, d_hidden.sum(axis=0))
    adam.apply("out", net.out, hidden.T @ d_logit)
    adam.apply("level", net.level, d_logit.sum(keepdims=True))
    adam.apply("embed", net.embed, d_embed, used)


def _batches(order: np.ndarray, texts: list[np.ndarray], most: int, words: int = 30_000) -> Iterator[np.ndarray]:
    """Runs of ``most`` texts, or of fewer when they are long, so that a step's memory is bounded."""
    begin = size = 0
    for k, i in enumerate(order):
        if k > begin and (k - begin == most or size + len(texts[i]) > words):
            yield order[begin:k]
            begin, size = k, 0
        size += len(texts[i])
    yield order[begin:]


def train(
    texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 7, net: ConvNet | None = None, first: int = 0, last: int | None = None
) -> ConvNet:
    """A net from texts (slots with padding, one array each) and their labels, both kinds weighing the same.

    ``net``: where to go on from, in epoch ``first`` of ``last``.
    """
    net = ConvNet.fresh(seed) if net is None else deepcopy(net)
    adam, rng = _Adam(0.01), np.random.default_rng([seed, first])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    for epoch in range(first, first + epochs):
        adam.rate = 0.01 * (1 - epoch / (last or epochs))
        order = rng.permutation(len(y))
        for rows in _batches(order, texts, batch):
            begin = np.cumsum([0, *[len(texts[i]) for i in rows]])
            _gradients(net, np.concatenate([texts[i] for i in rows]), begin, y[rows], weight[rows], adam)
    return net


_DENSE = ("filters", "bias", "out", "level")
_SUMS = pa.schema([("shard", pa.int32()), ("key", pa.string()), ("total", pa.binary()), ("weight", pa.binary())])


def _changes(before: ConvNet, after: ConvNet) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(key, change, weight) of the embeddings in chunks and of all else; only rows with a weight are in the change."""
    moved = after.embed - before.embed
    met = moved.any(axis=1)
    for k in range(0, SLOTS, CHUNK):
        own = met[k : k + CHUNK]
        if own.any():
            yield f"embed\t{k}", moved[k : k + CHUNK][own], own.astype(np.float64)
    yield "net", np.concatenate([(getattr(after, n) - getattr(before, n)).ravel() for n in _DENSE])[None], np.ones(1)


def _changed(net: ConvNet, means: dict[str, np.ndarray]) -> ConvNet:
    net, at = deepcopy(net), 0
    for k in range(0, SLOTS, CHUNK):
        if f"embed\t{k}" in means:
            net.embed[k : k + CHUNK] += means[f"embed\t{k}"].astype(np.float32)
    for n in _DENSE:
        value = getattr(net, n)
        value += means["net"][0, at : at + value.size].reshape(value.shape).astype(np.float32)
        at += value.size
    return net


def _round(taught: DataFrame, shards: int, net: ConvNet, r: int) -> dict[str, np.ndarray]:
    """Weighted means, over the shards, of what a round changes; in the first one of the language machines too.

    Texts are dealt out, and slots made where they are learned; changes travel in the 32 bits in which they are computed.
    """

    def learn(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda x: (x[0], x[1].tobytes()))
        y = np.array([x[2] for x in rows], np.float32)
        after = train([x[1] for x in rows], y, EPOCHS, net=net, first=r * EPOCHS, last=ROUNDS * EPOCHS)
        found = [*_changes(net, after)]
        if r == 0:
            known = [x[3:] for x in rows if x[3] is not None]
            if known:
                features = langid.features(pa.array([t for _, t in known], pa.string()))
                machines = langid.train(features, [lang for lang, _ in known]).machines
                found += [(f"lang\t{a}\t{b}", (w * float(len(known)))[None], np.full(1, float(len(known)))) for (a, b), w in machines.items()]
        for key, total, weight in found:
            row = [shard, key, total.astype(np.float32).tobytes(), weight.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SUMS, strict=True)], schema=_SUMS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for part in langid.blocks(batch):
                own, begin = slots(part.column("text"))
                words = [own[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
                shard_ids, ids, *columns = (part.column(n).to_pylist() for n in ("shard", "doc_id", "toxic", *(("lang", "text") if r == 0 else ())))
                for shard, *row in zip(shard_ids, ids, words, *columns, strict=True):
                    if rows and shard != current:
                        yield from learn(current, rows)
                        rows = []
                    current = shard
                    rows.append(tuple(row))
        if rows:
            yield from learn(current, rows)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for key, change, weight in zip(*(batch.column(n) for n in ("key", "total", "weight")), strict=True):
                key, weight = key.as_py(), np.frombuffer(weight.as_buffer(), np.float64)
                change = np.frombuffer(change.as_buffer(), np.float32).reshape(np.count_nonzero(weight), -1)
                if key not in sums:
                    sums[key] = np.zeros((len(weight), change.shape[1])), np.zeros(len(weight))
                sums[key][0][weight > 0] += change
                sums[key][1][:] += weight
        for key, (total, weight) in sums.items():
            row = [0, key, total.tobytes(), weight.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SUMS, strict=True)], schema=_SUMS)

    schema = "shard int, key string, total binary, weight binary"
    columns = ["shard", "doc_id", "toxic", "text", *(("lang",) if r == 0 else ())]
    dealt = taught.select(*columns).repartition(shards, "shard").sortWithinPartitions("shard")
    parts = min(shards, SLOTS // CHUNK)
    sums = dealt.mapInArrow(run, schema).repartition(parts, "key").sortWithinPartitions("key", "shard").mapInArrow(add, schema)
    out = {}
    for row in sums.collect():  # as much as one net and its language machines
        total, weight = (np.frombuffer(row[n], np.float64) for n in ("total", "weight"))
        out[row["key"]] = total.reshape(len(weight), -1) / np.maximum(weight, 1)[:, None]
    return out


def _languages(means: dict[str, np.ndarray], langs: list[str]) -> langid.LanguageModel:
    """The mean machines; a pair that no shard has together gets one that tells nothing."""
    empty = langid.train(np.zeros((len(langs), langid.BUCKETS), np.float32), langs) if langs else langid.LanguageModel({}, {})
    machines = {(a, b): means[f"lang\t{a}\t{b}"][0].astype(np.float32) if f"lang\t{a}\t{b}" in means else np.zeros_like(w) for (a, b), w in empty.machines.items()}
    return langid.LanguageModel(empty.families, machines)


def thresholds(scored: DataFrame) -> dict[str, float]:
    """For all rows of (lang, logit, toxic) as ``""``, and for each language with ten of either label: the cut with the best F
    score at beta 0.5, in the middle between the scores around it.

    Precision counts more than recall, so a model that tells little apart leaves most texts alone.
    """
    each = scored.select(F.explode(F.array(F.lit(""), F.col("lang"))).alias("lang"), (-F.col("logit")).alias("at"), (F.col("toxic") > 0).cast("long").alias("hit"))
    cells = materialize(each.groupBy("lang", "at").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")), "toxic-scores")
    totals = cells.groupBy("lang").agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n"))
    enough = (F.col("all_hits") >= 10) & (F.col("all_n") - F.col("all_hits") >= 10) | ((F.col("lang") == "") & (F.col("all_hits") > 0))
    upto = running(cells, ["lang"], ["at"], {"hits_upto": ("sum", F.col("hits")), "n_upto": ("sum", F.col("n"))})
    score = F.lit(1.25) * F.col("hits_upto") / (F.col("n_upto") + F.lit(0.25) * F.col("all_hits"))
    best = upto.join(totals.where(enough), "lang").groupBy("lang").agg(F.max_by("at", F.struct(score, -F.col("at"))).alias("best"))
    beyond = cells.join(best, "lang").groupBy("lang", "best").agg(F.min(F.when(F.col("at") > F.col("best"), F.col("at"))).alias("next"))
    found = {r["lang"]: -(r["best"] + (r["best"] + 1 if r["next"] is None else r["next"])) / 2 for r in beyond.collect()}
    discard(cells)
    return {"": 0.0, **found}


@dataclass
class ToxicityModel:
    net: ConvNet | None
    languages: langid.LanguageModel | None
    cuts: dict[str, float]
    base: float

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(column), self.base)
        logit = self.net.logits(*slots(column))
        langs, _ = self.languages.predict(langid.features(column))
        cut = np.array([self.cuts.get(lang, self.cuts[""]) for lang in langs])
        return 1 / (1 + np.exp(-np.clip(logit - cut, -30, 30)))


def _likely(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` whose id is one of the ``n`` in ``ids``, and a few others (one in 16 at most, up to ``MOST_BITS`` / 16 ids).

    Ids set bits of a map by their hash; its blocks of 4096 bits are broadcast, 2 to 4 bytes an id.
    """
    bits = min(MOST_BITS, 1 << max(12, (16 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("doc_id").cast("long")), F.lit(bits))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    words = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("set"))
    blocks = words.groupBy(F.shiftright("word", 6).alias("_block_")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).alias("at"), "set"))).alias("_set_"))
    met = docs.join(F.broadcast(blocks), F.shiftright(place, 12) == F.col("_block_"))
    return met.where(F.getbit(F.element_at("_set_", word % 64), bit) == 1).select(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from all rows of ``labels`` (doc_id, toxic) that have a text in ``docs``."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = labels.withColumns({"kind": F.col("toxic") > 0, "draw": F.xxhash64(F.lit("toxic"), F.col("doc_id"))})
    ids = materialize(ids, "toxic-ids")
    held = rank_within(ids, ["kind"], ["draw", "doc_id"], "at").select("doc_id", "toxic", (F.col("at") % 4 == 1).alias("held"))
    # ids by broadcast up to a counted number, beyond it a map of their hashes, so that only about the labelled texts are dealt out for the join
    n, texts = ids.count(), docs.select("doc_id", "text", "lang")
    chosen = texts.join(F.broadcast(held), "doc_id") if n <= MOST_BROADCAST else _likely(texts, ids, n).join(held, "doc_id")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in langid.blocks(batch):
                *_, first = _words(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first) + PAD, pa.int64())], [*part.schema.names, "n_slots"])

    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "held", "lang", "text")
    rows = materialize(chosen.mapInArrow(counted, "doc_id long, toxic int, held boolean, lang string, text string, n_slots long"), "toxic-rows", compression="zstd")
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("toxic").alias("low"), F.max("toxic").alias("high"), F.avg("toxic").alias("mean"), F.sum("n_slots").alias("n_slots")
    ).first()
    discard(ids)
    if size["n"] < 8 or size["low"] == size["high"]:
        discard(rows)
        return ToxicityModel(None, None, {}, float(size["mean"] or 0.0))
    langs = sorted(r["lang"] for r in rows.select("lang").where("lang IS NOT NULL AND NOT held").distinct().collect())
    shards = max(-(-size["n"] // SHARD_ROWS), -(-size["n_slots"] // SHARD_WORDS))
    taught = rows.where("NOT held").withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id")), F.lit(shards)).cast("int"))
    net, languages = ConvNet.fresh(7), None
    for r in range(ROUNDS):
        means = _round(taught, shards, net, r)
        languages = languages or _languages(means, langs)
        net = _changed(net, means)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in langid.blocks(batch):
                logit = net.logits(*slots(part.column("text")))
                found, _ = languages.predict(langid.features(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(logit.astype(np.float64)), part.column("toxic")], ["lang", "logit", "toxic"])

    cuts = thresholds(rows.where("held").select("text", "toxic").mapInArrow(scored, "lang string, logit double, toxic int"))
    discard(rows)
    return ToxicityModel(net, languages, cuts, float(size["mean"]))


def with_scores(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """All rows and columns, with the score of each whole text in column ``name``; a name in use gets underscores in front."""
    while name in docs.columns:
        name = f"_{name}"
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in langid.blocks(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(part.column("text")))], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)
