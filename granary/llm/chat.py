"""Chat formatting through a template that is only called, never looked into.

The template turns a list of (role, text) into one string. ``prefix_spans`` renders the conversation turn by turn
and compares consecutive outputs: what a turn adds at the end is its span; an output that doesn't
begin with the one before it shows a template that rewrites its history, and the conversation is marked
``rewritten`` with the first turn at which that happened.

Every prefix of every conversation is rendered, however long it is: a rewrite that later turns undo can't be seen
otherwise. That costs the square of a conversation's length in characters, of which two renderings are held at a time;
the template keeps its turns in a bounded cache, so that a prefix is little more than a concatenation. ``spans`` is an
estimate at linear cost for other uses, from renderings of the last ``CONTEXT`` turns; no query takes it.

Nulls in text or role count as empty; rows are ordered by turn, then role, then text, with null turns first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Control strings of the template, and the sign that is put before them inside texts. Fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
ESCAPE = "\\"
CONTEXT = 3

_HIDE = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROL)))
_SHOW = re.compile(re.escape(ESCAPE) + "(" + "|".join(re.escape(c) for c in (ESCAPE, *CONTROL)) + ")")


def escape(text: str) -> str:
    """The text with the sign before each control string and each sign."""
    return _HIDE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _SHOW.sub(lambda m: m[1], text)


@lru_cache(maxsize=1 << 14)
def _instructed(turn: Turn) -> str:
    role, text = turn
    body = escape(text) if role == "assistant" else f"[INST]{escape(text)}[/INST]"
    return f"<s>[ROLE]{escape(role)}[/ROLE]{body}</s>"


def instruct_template(turns: list[Turn]) -> str:
    """``<s>[ROLE]role[/ROLE][INST]text[/INST]</s>`` for each turn; the assistant's text stands outside the brackets."""
    return "".join(map(_instructed, turns))


def prefix_spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[list[tuple[int, int]], str, int | None]:
    """(begin, end) of each turn in the whole output, that output, and the first turn that rewrote history, or None."""
    before, found, rewrite = render([]), [], None
    for k in range(1, len(turns) + 1):
        after = render(turns[:k])
        if not after.startswith(before) and rewrite is None:
            rewrite = k - 1
        same = len(before) if after.startswith(before) else _shared(before, after)
        found.append((same, len(after)))
        before = after
    return found, before, rewrite


def _shared(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[list[tuple[int, int]], str, int | None]:
    """Like ``prefix_spans``, from what each turn adds to the ``CONTEXT`` turns before it.

    The parts must add up to one rendering of the whole; if they don't, every prefix is rendered after all. Rewrites that
    neither those windows nor the whole show are not seen.
    """
    head, before, rewrite = prefix_spans(turns[:CONTEXT], render)
    if rewrite is None:
        parts, at = [], len(before)
        for k in range(CONTEXT, len(turns)):
            old, new = render(turns[k - CONTEXT : k]), render(turns[k - CONTEXT : k + 1])
            if not new.startswith(old):
                break
            parts.append(new[len(old) :])
            head.append((at, at + len(parts[-1])))
            at += len(parts[-1])
        else:
            whole = render(turns)
            if whole == before + "".join(parts):
                return head, whole, None
    return prefix_spans(turns, render)


def read_turn(part: str) -> tuple[str, str, int, int]:
    """(role, text, begin, end of the escaped text inside the part), read from a turn's output alone."""
    cut = _control_at(part, "[/ROLE]", len("<s>[ROLE]"))
    role = unescape(part[len("<s>[ROLE]") : cut])
    begin, end = cut + len("[/ROLE]"), len(part) - len("</s>")
    if role != "assistant":
        begin, end = begin + len("[INST]"), end - len("[/INST]")
    return role, unescape(part[begin:end]), begin, end


def _control_at(part: str, sign: str, at: int) -> int:
    """Where ``sign`` stands unescaped."""
    while True:
        for m in _HIDE.finditer(part, at):
            if m[0] == ESCAPE:
                at = m.end() + next(len(c) for c in (*CONTROL, ESCAPE) if part.startswith(c, m.end()))
                break
            if m[0] == sign:
                return m.start()
        else:
            raise ValueError("no end of the role")


FORMATTED = (
    "conv_id long, n_turns long, formatted string, turn_begin array<long>, turn_end array<long>, "
    "loss_begin array<long>, loss_end array<long>, rewritten_at long"
)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[Turn]]]:
    """Runs of equal conv_id of sorted rows; one conversation is held at a time."""
    current, turns, begun = None, [], False
    for batch in batches:
        ids, roles, texts = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
        for i, role, text in zip(ids, roles, texts, strict=True):
            if begun and i != current:
                yield current, turns
                turns = []
            current, begun = i, True
            turns.append((role, text))
    if begun:
        yield current, turns


def formatted(conversations: DataFrame, render: Callable[[list[Turn]], str] = instruct_template) -> DataFrame:
    """One row per conversation: the output, the span of each turn, and the loss mask (spans of assistant texts)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for conv, turns in _conversations(batches):
            found, whole, rewrite = prefix_spans(turns, render)
            loss = []
            for begin, end in found if rewrite is None else []:
                role, _, a, b = read_turn(whole[begin:end])
                if role == "assistant":
                    loss.append((begin + a, begin + b))
            out.append(
                {
                    "conv_id": conv, "n_turns": len(turns), "formatted": whole,
                    "turn_begin": [x for x, _ in found], "turn_end": [x for _, x in found],
                    "loss_begin": [x for x, _ in loss], "loss_end": [x for _, x in loss], "rewritten_at": rewrite,
                }
            )
            size += len(whole)
            if size > 4_000_000:
                yield _arrow(out)
                out, size = [], 0
        if out:
            yield _arrow(out)

    return rows.mapInArrow(run, FORMATTED)


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string())]
    + [(n, pa.list_(pa.int64())) for n in ("turn_begin", "turn_end", "loss_begin", "loss_end")]
    + [("rewritten_at", pa.int64())]
)


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_back(found: DataFrame) -> DataFrame:
    """What the formatted strings say: digests of the turns and of the text under the loss mask, unescaped."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                whole, turns, loss, chars = row["formatted"], hashlib.sha256(), hashlib.sha256(), 0
                n = 0
                for begin, end in zip(row["turn_begin"], row["turn_end"], strict=True):
                    role, text, _, _ = read_turn(whole[begin:end])
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for begin, end in zip(row["loss_begin"], row["loss_end"], strict=True):
                    text = unescape(whole[begin:end])
                    loss.update(text.encode())
                    chars += len(text)
                rows.append((row["conv_id"], n, turns.hexdigest(), chars, loss.hexdigest(), len(whole), row["rewritten_at"]))
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return found.mapInArrow(run, schema)


__all__ = ["escape", "formatted", "instruct_template", "prefix_spans", "read_back", "spans", "unescape"]
