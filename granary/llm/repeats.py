"""Windows of words or bytes that occur at several places of a corpus: the frame of both substring operators.

1. Every window names its anchor, the gram with the smallest hash in it. Equal windows have equal anchors at the
   same place, so only anchors that occur twice or more matter, and windows of different anchors never
   need to meet. Anchors are far fewer than windows.
2. Of the texts with such anchors, the pieces around them (the windows of one anchor, with all that these cover) are
   cut out and sent to one task per anchor, where a solver compares them.
3. Anchors with ``hot`` different pieces or more (some megabytes) would make one task large. Their windows are sent one by one under a 128-bit
   digest instead and aggregated before the shuffle, so no task ever holds more than ``hot`` pieces of an anchor.
   What a text repeats itself is one row with all its places, at every step.
4. The repeated windows of each text are united and taken out of the text.

Intermediate tables are written to the shared folder. Texts are told apart by doc_id and, where ids are null or
repeated, by a digest of the text: rows that share both count as the same place. Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import words as W
from granary.llm.exact import join_counted
from granary.llm.store import narrow
from granary.session import scratch_path

NO_ID = -(2**63)


@dataclass(frozen=True)
class Piece:
    """The windows of one anchor at one place: the first unit, the number of windows, the units that they cover.

    ``again``: first units (32 bits each) of further places in the same text with this content.
    """

    doc_id: int
    begin: int
    count: int
    content: bytes
    again: bytes | None = None
    text_key: int = 0


#: Gets the pieces of some anchors as (anchor, piece), sorted by anchor and place; returns (piece, repeated windows).
Solver = Callable[[list[tuple[int, Piece]]], Iterator[tuple[Piece, np.ndarray]]]


@dataclass(frozen=True)
class Kind:
    """Units are words or bytes; ``keep_first`` leaves the first place of each window."""

    by_words: bool
    window: int
    gram: int
    keep_first: bool
    solver: Solver
    hot: int = 8192
    shard: int = 1 << 20  # bytes of pieces that a solver gets at a time


#: What tells texts apart.
TEXT = ["doc_id", "text_key"]


def _documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text_key, text), and whether ids are null or repeated; where they aren't, ``text_key`` is 0 and takes no room."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    shared = docs.select(ids).groupBy("doc_id").count().filter((F.col("count") > 1) | (F.col("doc_id") == NO_ID)).limit(1).count() > 0
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if shared else F.lit(0).cast("long")
    return docs.select(ids, text_key.alias("text_key"), "text"), shared


def _write(df: DataFrame, label: str) -> DataFrame:
    """Like ``materialize``, packed tighter."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """(key, doc_id, text_key, places, pieces, begin, count, more): each anchor of each text once.

    ``pieces``: different pieces around its places; ``more``: places after the first (begin and count of 32 bits).
    """
    schema = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("places", pa.int32()), ("pieces", pa.int32()), ("begin", pa.int32()), ("count", pa.int32()), ("more", pa.binary())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, at = W.raw(part.column("text"))
                if kind.by_words:
                    begin, end, at = W.words(data, at)
                    units = W.word_hashes(data, begin, end)
                else:
                    units = W.byte_values(data)
                text, begin, count, key = W.anchors(units, at, kind.gram, kind.window)
                order = np.lexsort((begin, key, text))
                text, key = text[order], key[order]
                places = np.stack([begin[order], count[order]], axis=1).astype(np.int32)
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(key)))
                more, pieces = np.full(len(first), None, object), np.ones(len(first), np.int32)
                for k in np.flatnonzero(n > 1):
                    own = places[first[k] : first[k] + n[k]]
                    more[k] = own[1:].tobytes()
                    at_unit = at[text[first[k]]] + own[:, 0].astype(np.int64)
                    pieces[k] = len(np.unique(W.range_hashes_at(units, at_unit, own[:, 1] + kind.window - 1)))
                own_text = [part.column(c).to_numpy()[text[first]] for c in TEXT]
                columns = [key[first], *own_text, n, pieces, places[first, 0], places[first, 1], more]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "key long, doc_id long, text_key long, places int, pieces int, begin int, count int, more binary")


def _units(text: str | None, kind: Kind):
    data = (text or "").encode()
    return data.split() if kind.by_words else data  # bytes.split() takes the same six signs for white space


def _content(units, begin: int, end: int) -> bytes:
    part = units[begin:end]
    return b" ".join(part) if isinstance(part, list) else part


_PIECE = "key long, doc_id long, text_key long, begin int, count int, hot boolean, content binary, again binary"
_PIECE_ARROW = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int32()), ("count", pa.int32()), ("hot", pa.bool_()), ("content", pa.binary()), ("again", pa.binary())]
)


def _pieces_of(units, doc_id: int, text_key: int, marks: Iterable[tuple], kind: Kind) -> Iterator[tuple]:
    """Rows of ``_PIECE`` of one text; each content once."""
    for key, hot, begin, count, more in marks:
        places = [(begin, count)]
        if more:
            places += np.frombuffer(more, np.int32).reshape(-1, 2).tolist()
        found: dict[bytes, list[int]] = {}
        if hot:
            for begin, count in places:
                for k in range(begin, begin + count):
                    digest = hashlib.blake2b(_content(units, k, k + kind.window), digest_size=16).digest()
                    found.setdefault(digest, []).append(k)
        elif more is None:
            yield key, doc_id, text_key, begin, count, False, _content(units, begin, begin + count + kind.window - 1), None
            continue
        else:
            sizes = {}
            for begin, count in places:
                content = _content(units, begin, begin + count + kind.window - 1)
                found.setdefault(content, []).append(begin)
                sizes[content] = count
        for content, begins in found.items():
            again = np.array(begins[1:], np.int32).tobytes() if len(begins) > 1 else None
            if hot:
                yield int.from_bytes(content[:8], "little", signed=True), doc_id, text_key, begins[0], 1, True, content, again
            else:
                yield key, doc_id, text_key, begins[0], sizes[content], False, content, again


def _cut(marked: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            texts, marks = batch.column("text"), batch.column("marks")
            ids = zip(*(batch.column(c).to_pylist() for c in TEXT), strict=True)
            fields = marks.flatten()
            fields = [fields.field(n).to_pylist() for n in ("key", "hot", "begin", "count", "more")]
            ends = np.cumsum(marks.value_lengths().to_numpy()).tolist()
            done = 0
            for i, own_text in enumerate(ids):
                units = _units(texts[i].as_py(), kind)
                own = zip(*(f[done : ends[i]] for f in fields), strict=True)
                done = ends[i]
                for row in _pieces_of(units, *own_text, own, kind):
                    rows.append(row)
                    size += 32 + len(row[6])
                    if size > 4_000_000:
                        yield _rows(rows, _PIECE_ARROW)
                        rows, size = [], 0
        if rows:
            yield _rows(rows, _PIECE_ARROW)

    return marked.mapInArrow(run, _PIECE)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _solve(pieces: DataFrame, kind: Kind) -> DataFrame:
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def solved(shard: list[tuple[int, Piece]]) -> pa.RecordBatch:
        ids, keys, begins, ends = [], [], [], []
        for _, piece in shard:
            if piece.again:  # what a text repeats itself is repeated whatever else there is
                again = np.frombuffer(piece.again, np.int32)
                again = again if kind.keep_first else np.append(again, piece.begin)
                ids.append(np.full(len(again), piece.doc_id, np.int64))
                keys.append(np.full(len(again), piece.text_key, np.int64))
                begins.append(again)
                ends.append(again + piece.count + kind.window - 1)
        for piece, flags in kind.solver(shard):
            first, last = _runs(flags)
            ids.append(np.full(len(first), piece.doc_id, np.int64))
            keys.append(np.full(len(first), piece.text_key, np.int64))
            begins.append(piece.begin + first)
            ends.append(piece.begin + last + kind.window - 1)
        columns = [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in ((ids, np.int64), (keys, np.int64), (begins, np.int32), (ends, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, Piece]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "doc_id", "begin", "count", "content", "again", "text_key")]
            for key, *place in zip(*columns, strict=True):
                if size > kind.shard and shard[-1][0] != key:
                    yield solved(shard)
                    shard, size = [], 0
                shard.append((key, Piece(*place)))
                size += len(place[3])
        if shard:
            yield solved(shard)

    dealt = pieces.repartition(parts, "key").sortWithinPartitions("key", *TEXT, "begin")
    return dealt.mapInArrow(run, "doc_id long, text_key long, begin int, end int")


def _hot_windows(pieces: DataFrame, kind: Kind) -> DataFrame:
    """Repeated windows among those that were sent by digest."""
    window = ["key", "content"]
    place = F.struct(*TEXT, "begin")
    groups = pieces.groupBy(*window).agg(
        F.min(place).alias("low"), F.max(place).alias("high"), F.max(F.col("again").isNotNull()).alias("within"), F.count(F.lit(1)).alias("n")
    )
    repeated = (F.col("low") != F.col("high")) | F.col("within")
    groups = narrow(groups.filter(repeated), "digests")
    found = join_counted(pieces, groups, window, "n", "inner")
    if kind.keep_first:
        begins = F.when(place == F.col("low"), F.array().cast("array<int>")).otherwise(F.array("begin"))
    else:
        begins = F.array("begin")
    return found.select(*TEXT, begins.alias("begins"), "again")


def _spread(found: DataFrame, kind: Kind) -> DataFrame:
    """Spans of windows that were found by digest, neighbours in a batch united."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at = [], [], []
            for doc_id, text_key, begins, again in zip(*(batch.column(n).to_pylist() for n in (*TEXT, "begins", "again")), strict=True):
                own = np.array(begins, np.int64)
                if again:
                    own = np.append(own, np.frombuffer(again, np.int32))
                ids.append(np.full(len(own), doc_id, np.int64))
                keys.append(np.full(len(own), text_key, np.int64))
                at.append(own)
            if not ids:
                continue
            ids, keys, at = np.concatenate(ids), np.concatenate(keys), np.concatenate(at)
            order = np.lexsort((at, keys, ids))
            ids, keys, at = ids[order], keys[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] > at[:-1] + kind.window)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1 if len(at) else first
            columns = [ids[first], keys[first], at[first].astype(np.int32), (at[last] + kind.window).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return found.mapInArrow(run, "doc_id long, text_key long, begin int, end int")


def repeated_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, text_key, begin, end) of units covered by repeated windows of ``_documents``, each once; spans of a text may overlap."""
    found = _write(_anchors(docs, kind), "anchors")
    counts = found.groupBy("key").agg(F.sum("places").alias("total"), (F.sum("pieces") >= kind.hot).alias("hot"), F.count(F.lit(1)).alias("rows"))
    counts = narrow(counts.filter(F.col("total") >= 2).drop("total"), "anchor-counts")
    marks = join_counted(found, counts, "key", "rows", "inner").groupBy(*TEXT).agg(
        F.collect_list(F.struct("key", "hot", "begin", "count", "more")).alias("marks")
    )  # one text's own anchors, so no more than the text is long
    pieces = _write(_cut(docs.join(marks, TEXT), kind), "pieces")
    usual = _solve(pieces.filter(~F.col("hot")).drop("hot"), kind)
    hot = _spread(_hot_windows(pieces.filter("hot").drop("hot"), kind), kind)
    return narrow(usual.unionByName(hot), "spans")


KEPT = "doc_id long, n_units long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"


def without_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """One row per document: its units, those removed, the removed spans (maximal), and what is left."""
    docs, shared = _documents(docs)
    spans = repeated_spans(docs.dropDuplicates(TEXT) if shared else docs, kind)
    spans = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    joined = docs.join(spans, TEXT, "left")
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pair)), ("kept", pa.binary())])

    def one(doc_id: int, text: str | None, found: list[dict] | None) -> tuple:
        units = _units(text, kind)
        edge = np.zeros(len(units) + 1, np.int32)
        if found:
            np.add.at(edge, [x["begin"] for x in found], 1)
            np.add.at(edge, [x["end"] for x in found], -1)
        begin, end = _runs(np.cumsum(edge[:-1]) > 0)
        parts, at = [], 0
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            parts.append(_content(units, at, a))
            at = b
        parts.append(_content(units, at, len(units)))
        kept = (b" " if kind.by_words else b"").join(p for p in parts if p)
        return (None if doc_id == NO_ID else doc_id, len(units), int((end - begin).sum()), [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)], kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            ids, texts, found = (batch.column(n) for n in ("doc_id", "text", "found"))
            for i in range(batch.num_rows):
                rows.append(one(ids[i].as_py(), texts[i].as_py(), found[i].as_py()))
                size += len(rows[-1][4])
                if size > 4_000_000:
                    yield _rows(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _rows(rows, schema)

    return joined.mapInArrow(run, KEPT)
