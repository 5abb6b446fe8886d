"""Substring deduplication by suffix automata: of each passage of words, the first place stays.

Reference shards are the pieces of text that share an anchor with another place (see ``repeats``). Each shard
becomes one suffix automaton over words, whose states know where their strings end first. The pieces of the documents
are streamed through it for matching statistics: where the match is ``WINDOW`` words long or more and
ends elsewhere first, the window is a repeat, and all words of such windows are removed.

A broadcast of every shard to all documents would cost documents times shards. Since equal windows share their
anchor, a document's pieces can match in one shard only, so each automaton is built where its
documents are sent, and is never larger than a shard.

Words are runs of other signs than white space and are left unchanged; null texts have none. Rows that share doc_id and text
(null ids too) are the same place, so copies of a row repeat nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.repeats import Kind, Piece, without_repeats

WINDOW, GRAM = 20, 6


class SuffixAutomaton:
    """All substrings of the sequences added so far; ``first`` is the ordinal of the unit at which a state's strings end first."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, nxt: dict, link: int, length: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def add(self, units, ordinal: int) -> None:
        """Add a sequence whose first unit has the given ordinal; ordinals must rise."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for at, c in enumerate(units, ordinal):
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state({}, 0, length[last] + 1, at)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def earliest(self, units, window: int) -> Iterator[int]:
        """For each unit, the ordinal at which the ``window`` units that end here end first; -1 without such a match."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        for c in units:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            while v and length[link[v]] >= window:
                v = link[v]
                n = min(n, length[v])
            yield first[v] if n >= window else -1


def solve(shard: list[tuple[int, Piece]], window: int = WINDOW) -> Iterator[tuple[Piece, np.ndarray]]:
    """Windows of the shard that begin earlier in it; pieces come sorted by anchor and place."""
    for _, group in groupby(shard, key=lambda x: x[0]):
        firsts: dict[bytes, Piece] = {}
        for _, piece in group:
            seen = firsts.setdefault(piece.content, piece)
            if (seen.doc_id, seen.text_key, seen.begin) != (piece.doc_id, piece.text_key, piece.begin):
                yield piece, np.ones(piece.count, bool)
        if len(firsts) < 2:
            continue  # the windows of one piece hold their anchor at different places and so differ
        automaton, ordinal, told = SuffixAutomaton(), 0, []
        for content, piece in firsts.items():
            units = content.split()
            automaton.add(units, ordinal)
            told.append((piece, units, ordinal))
            ordinal += len(units)
        for piece, units, begin in told:
            found = np.fromiter(automaton.earliest(units, window), np.int64, len(units))[window - 1 :]
            flags = (found >= 0) & (found < np.arange(begin + window - 1, begin + len(units)))
            if flags.any():
                yield piece, flags


KIND = Kind(by_words=True, window=WINDOW, gram=GRAM, keep_first=True, solver=solve)


def dedup_passages(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed spans (in words), and the text that is left."""
    found = without_repeats(docs, kind)
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "spans", F.col("kept").cast("string").alias("text"))
