"""Texts of an Arrow column as NumPy arrays: bytes, words, hashes of words, and selected grams.

Hashes are polynomials modulo 2**64 over a random value per byte, mixed at the end. All work is on whole
slices of a batch, never on single words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=U)
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of the polynomial's base and of its inverse, as many as were ever asked for."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                values = np.full(size, base, U)
                values[0] = 1
                setattr(cls, name, np.cumprod(values))
        return cls.up, cls.down


def range_hashes(units: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of units[begin:end] for each pair."""
    up, down = _Powers.to(len(units) + 1)
    sums = np.zeros(len(units) + 1, U)
    np.cumsum(units * up[: len(units)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin])


def range_hashes_at(units: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` units from each ``begin``, over the part of the units that these span."""
    low = int(begin.min())
    return range_hashes(units[low : int((begin + size).max())], begin - low, begin - low + size)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and where each text begins (one more: the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, pa.scalar("", column.type))
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each text (one more: all words)."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = at[1:] > at[:-1]
    i, j = at[:-1][full], at[1:][full] - 1
    first[i], last[j] = solid[i], solid[j]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, computed a slice at a time."""
    return prefix_hashes(data, begin, end, (None,))[:, 0]


def prefix_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: tuple[int | None, ...]) -> np.ndarray:
    """Hashes of the first so many bytes of each word (None: of all), a column each; the running sums are made once."""
    out = np.empty((len(begin), len(sizes)), U)
    k = 0
    while k < len(begin):
        low = begin[k]
        stop = max(k + 1, int(np.searchsorted(end, low + SLICE_BYTES, "right")))
        units = _BYTE[data[low : end[stop - 1]]]
        up, down = _Powers.to(len(units) + 1)
        sums = np.zeros(len(units) + 1, U)
        np.cumsum(units * up[: len(units)], out=sums[1:])
        first, last = begin[k:stop] - low, end[k:stop] - low
        before, back = sums[first], down[first]
        for i, most in enumerate(sizes):
            out[k:stop, i] = mix((sums[last if most is None else np.minimum(last, first + most)] - before) * back)
        k = stop
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i: minima of blocks from the left and from the right."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(units: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """The gram with the smallest hash of each window of ``window`` units, the first of equal ones.

    Equal windows have equal grams at the same place, so windows can be sorted out by gram. Windows don't
    cross texts. Consecutive windows with the same gram are one row of the result: number of the text, first
    unit of the first window counted in that text, number of windows, hash of the gram.
    """
    low_bits, chunk = U((1 << 22) - 1), 1 << 18
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found: list[tuple[np.ndarray, ...]] = []
    for c in range(0, len(units) - window + 1, chunk):
        part = units[c : c + chunk + window - 1]
        places = np.arange(len(part) - gram + 1)
        grams = range_hashes(part, places, places + gram)
        chosen = _sliding_min((grams & ~low_bits) | places.astype(U), window - gram + 1) & low_bits
        n = len(chosen)
        owner = text[c : c + n]
        inside = np.arange(c, c + n) + window <= at[owner + 1]
        new = np.ones(n, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, n))
        kept = inside[begin]
        begin, count = begin[kept], count[kept]
        found.append((owner[begin], c + begin - at[owner[begin]], count, grams[chosen[begin].astype(np.int64)].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
