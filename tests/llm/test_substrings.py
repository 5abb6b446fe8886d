"""Both substring operators and their solvers against brute force."""

import dataclasses
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import automaton, refine
from granary.llm.repeats import Piece


def removed(units_of, window, keep_first):
    """Flags of the units that go, by listing every window."""
    places = defaultdict(list)
    for d, units in units_of.items():
        for i in range(len(units) - window + 1):
            places[tuple(units[i : i + window])].append((d, i))
    out = {d: [False] * len(u) for d, u in units_of.items()}
    for found in places.values():
        for d, i in (sorted(found)[1:] if keep_first else found) if len(found) > 1 else ():
            out[d][i : i + window] = [True] * window
    return out


def corpus(unit, n=60, seed=3):
    """Texts that share passages, repeat themselves, and copy each other."""
    rng = random.Random(seed)
    word = lambda: unit(rng.randrange(40))
    common = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    docs = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice(common) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
        docs[i] = parts
    docs[n] = docs[n - 1]
    docs[n + 1] = common[0] * 7
    docs[n + 2] = []
    return docs


@pytest.mark.parametrize("hot", [2, 5, 4096])
def test_words(spark, hot):
    docs = corpus(lambda k: f"w{k}")
    kind = dataclasses.replace(automaton.KIND, window=8, gram=3, hot=hot, solver=lambda s: automaton.solve(s, 8))
    df = spark.createDataFrame([(i, " \n".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in automaton.dedup_passages(df, kind).collect()}
    want = removed(docs, 8, True)
    for i, words in docs.items():
        assert found[i].n_words == len(words) and found[i].n_removed == sum(want[i])
        assert found[i].text == " ".join(w for w, gone in zip(words, want[i], strict=True) if not gone)


@pytest.mark.parametrize("hot", [2, 5, 4096])
def test_bytes(spark, hot):
    docs = {i: "".join(t) for i, t in corpus(lambda k: "abcdeé"[k % 6]).items()}
    kind = dataclasses.replace(refine.KIND, window=12, gram=4, hot=hot, solver=lambda s: refine.solve(s, 12))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in refine.dedup_bytes(df, kind).collect()}
    raw = {i: t.encode() for i, t in docs.items()}
    want = removed(raw, 12, False)
    for i, data in raw.items():
        assert found[i].n_removed == sum(want[i])
        assert bytes(found[i].kept) == bytes(b for b, gone in zip(data, want[i], strict=True) if not gone)
        assert sum(s.end - s.begin for s in found[i].spans) == sum(want[i])
        assert all(a.end < b.begin for a, b in zip(found[i].spans, found[i].spans[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=6))
def test_automaton_finds_first_ends(texts):
    window, machine, at, told = 4, automaton.SuffixAutomaton(), 0, []
    for t in texts:
        machine.add(t, at)
        told.append((t, at))
        at += len(t)
    first = {}
    for t, begin in told:
        for i in range(len(t) - window + 1):
            first.setdefault(tuple(t[i : i + window]), begin + i + window - 1)
    for t, _ in told:
        ends = list(machine.earliest(t, window))
        assert ends[window - 1 :] == [first[tuple(t[i : i + window])] for i in range(len(t) - window + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 17))
def test_buckets_find_repeats(texts, window):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] += 1
    for t, flags in zip(texts, refine.repeated(texts, window), strict=True):
        assert flags.tolist() == [seen[t[i : i + window]] > 1 for i in range(len(t) - window + 1)]


def test_same_place_is_no_repeat():
    piece = Piece(1, 0, 1, b"a b c d")
    assert list(automaton.solve([(5, piece), (5, piece)], 4)) == []
    assert list(refine.solve([(5, piece), (5, piece)], 4)) == []


@pytest.mark.parametrize("hot", [2, 4096])
@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_without_ids_of_their_own(spark, doc_id, hot):
    """Texts of unlike length that share a passage and a null or repeated id."""
    passage = " ".join(f"p{k}q" for k in range(12))
    long = passage + " " + " ".join(f"long{k}" for k in range(60))
    short = "begins otherwise with more words than none " + passage
    texts = [long, short, short, "clean " * 3 + " ".join(f"c{k}" for k in range(50)), None]
    df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string").repartition(3)
    kind = dataclasses.replace(automaton.KIND, window=8, gram=3, hot=hot, solver=lambda s: automaton.solve(s, 8))
    found = automaton.dedup_passages(df, kind).collect()
    assert len(found) == 5 and all(r.doc_id == doc_id for r in found)
    kept = sorted(r.text for r in found)
    whole = [" ".join((t or "").split()) for t in texts]
    # the passage goes from one of the two texts; the copied row is one place
    assert kept in (sorted([whole[0].replace(passage, "").strip(), *whole[1:]]), sorted([t if t != short else t.replace(passage, "").strip() for t in whole]))
    kind = dataclasses.replace(refine.KIND, window=len(passage) - 5, gram=4, hot=hot, solver=lambda s: refine.solve(s, len(passage) - 5))
    found = refine.dedup_bytes(df, kind).collect()
    cut = [(t or "").replace(passage, "") for t in texts]
    assert [len(t) for t in sorted(bytes(r.kept).decode().strip() for r in found)] == [len(t.strip()) for t in sorted(x.strip() for x in cut)]
    assert len(found) == 5 and sum(r.n_removed for r in found) == 3 * len(passage)
