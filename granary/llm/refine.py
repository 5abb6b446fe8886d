"""Suffix-array deduplication of bytes by bucket-pointer refinement.

The windows that may be repeated are found by their anchors (see ``repeats``). The suffixes of the pieces around
these are put into buckets by their first ``Q`` bytes; a bucket is named by the place of its first member in the
sorted order. Buckets are then refined: their members are sorted by the bucket of the suffix some bytes later, which
doubles the compared length, and the new names are used by all later rounds. Buckets of one
suffix are left alone, and the last round compares exactly ``WINDOW`` bytes: members of a common bucket are repeats.

Every place of a repeated string is removed. Texts are UTF-8 bytes, null is empty; rows that share doc_id and text
(null ids too) are the same place, so copies of a row repeat nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from granary.llm.repeats import Kind, Piece, without_repeats

WINDOW, GRAM, Q = 400, 32, 8


def _names(keys: np.ndarray, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the keys; the bucket of each in that order; whether it shares it. base: the buckets so far, in the given order."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    places = np.arange(len(keys))
    begin = np.maximum.accumulate(np.where(new, places, 0))
    if base is None:
        names = begin
    else:
        old = base[order]
        changed = np.ones(len(keys), bool)
        changed[1:] = old[1:] != old[:-1]
        names = old + begin - np.maximum.accumulate(np.where(changed, places, 0))
    alone = new.copy()
    alone[:-1] &= new[1:]
    return order, names, ~alone


def repeated(contents: list[bytes], window: int, q: int = Q) -> list[np.ndarray]:
    """For each text, whether the ``window`` bytes at each place occur anywhere else in the texts."""
    q = min(q, window)
    data = np.frombuffer(b"".join(contents) + bytes(q), np.uint8)
    sizes = np.array([len(c) for c in contents])
    n = int(sizes.sum())
    end = np.repeat(np.cumsum(sizes), sizes).astype(np.int32)
    grams = np.zeros(n, np.uint64)
    for j in range(q):
        grams = (grams << np.uint64(8)) | data[j : j + n]
    active = np.flatnonzero(np.arange(n) + q <= end)
    bucket = np.zeros(n, np.int32)  # a shard is far below 2**31 bytes
    order, names, shared = _names(grams[active], None)
    active = active[order]
    bucket[active] = names
    active = active[shared]
    del grams, order, names
    length = q
    while length < window and len(active):
        step = min(length, window - length)
        active = active[active + length + step <= end[active]]
        base = bucket[active].astype(np.int64)
        order, names, shared = _names(base * (n + 1) + bucket[active + step], base)
        active = active[order]
        bucket[active] = names
        active = active[shared]
        length += step
    flags = np.zeros(n, bool)
    flags[active] = True
    begin = np.cumsum(sizes) - sizes
    return [flags[a : a + max(0, s - window + 1)] for a, s in zip(begin, sizes, strict=True)]


def solve(shard: list[tuple[int, Piece]], window: int = WINDOW) -> Iterator[tuple[Piece, np.ndarray]]:
    """Windows of the shard that occur twice or more in it; pieces come sorted by anchor and place."""
    unlike: list[Piece] = []
    for _, group in groupby(shard, key=lambda x: x[0]):
        places: dict[bytes, list[Piece]] = {}
        for _, piece in group:
            places.setdefault(piece.content, []).append(piece)
        for same in places.values():
            if len({(p.doc_id, p.text_key, p.begin) for p in same}) > 1:
                for piece in same:
                    yield piece, np.ones(piece.count, bool)
        if len(places) > 1:  # else: the windows of one piece hold their anchor at different places and so differ
            unlike += [same[0] for same in places.values()]
    if unlike:
        for piece, flags in zip(unlike, repeated([p.content for p in unlike], window), strict=True):
            if flags.any():
                yield piece, flags


KIND = Kind(by_words=False, window=WINDOW, gram=GRAM, keep_first=False, solver=solve)


def dedup_bytes(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    """One row per document: doc_id, n_units (bytes), n_removed, spans (maximal removed runs), kept (bytes)."""
    return without_repeats(docs, kind)
