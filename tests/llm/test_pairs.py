"""Near-duplicate join, exact dedup and decontamination."""

import itertools
import math
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from granary.llm import decontam, exact, graph, jaccard

DOC = "doc_id long, text string"


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    classes = {}
    for i in sets:
        seen, queue = {i}, [i]
        while queue:
            new = [j for j in links[queue.pop()] if j not in seen]
            seen.update(new)
            queue += new
        classes[i] = min(seen)
    return {i: (classes[i], len(links[i]), len({frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])})) for i in sets}


@pytest.mark.parametrize("block", [2, 4096])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", block)
    rng = random.Random(block)
    texts, i = {}, 0
    for _ in range(14):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts[i] = " ".join(copy)
            i += 1
    texts |= {i: None, i + 1: "", i + 2: "one two", i + 3: "one  two"}
    found = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), DOC).repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in found} == brute_classes(texts)


def test_posterior_bounds():
    least = jaccard.least_matches()
    assert len(least) == jaccard.VALUES // jaccard.STEP and list(least) == sorted(least)
    # at the threshold itself a pair is all but never dropped
    rng = np.random.default_rng(0)
    matches = np.cumsum(rng.random((200_000, jaccard.VALUES)) < 0.8, axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (matches < np.array(least)).any(axis=1).mean() < 1e-4
    assert least[-1] > 0.5 * jaccard.VALUES


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.node: r.low for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_grows_by_batches(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    frame = lambda rows: spark.createDataFrame(rows, DOC)
    first = {r.doc_id: r for r in exact.dedup(frame([(1, "a  b"), (2, "a\tb"), (3, None)]), index).collect()}
    assert [(first[i].keep_id, first[i].kept, first[i].group_size) for i in (1, 2, 3)] == [(1, True, 2), (1, False, 2), (3, True, 1)]
    again = {r.doc_id: r for r in exact.dedup(frame([(4, "a b"), (5, ""), (6, "new"), (7, "new")]), index).collect()}
    assert [(again[i].keep_id, again[i].kept, again[i].group_size) for i in (4, 5, 6, 7)] == [(1, False, 3), (3, False, 2), (6, True, 2), (6, False, 2)]
    rerun = exact.dedup(frame([(4, "a b"), (5, ""), (6, "new"), (7, "new")]), index).collect()
    assert {r.doc_id: r.group_size for r in rerun} == {4: 3, 5: 2, 6: 2, 7: 2}
    reopened = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert reopened.known().count() == 3


def test_index_join_has_no_exchange_of_the_index(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    exact.dedup(spark.createDataFrame([(1, "a"), (2, "b")], DOC), index)
    plan = index.known()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def changed(words, *places):
    words = words.split()
    for p in places:
        words[p] = "changed"
    return " ".join(words)


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_passages_with_substitutions(spark, seeds):
    texts = {
        1: f"before it {ITEM} after it",
        2: f"before {changed(ITEM, 3, 9)} after",
        3: ITEM.upper().replace(" ", ", "),
        4: changed(ITEM, *range(0, 20, 2)),
        5: " ".join(ITEM.split()[:6]) + " something else entirely and nothing more of that text at all here",
        6: None,
        7: "",
        8: f"{changed(ITEM, 1, 7, 13)} {ITEM}",
    }
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "short one")], "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame(list(texts.items()), DOC), bench, seeds).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 8}
    best = {r.doc_id: r for r in found}
    assert best[1].doc_begin == 2 and best[1].n_matched == 20 and best[2].n_matched == 18 and best[8].doc_begin == 20


def test_masks_meet_every_overlap():
    for n in range(1, decontam.WINDOW + 1):
        masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontam.masks_for(n)]
        seeds = [{at + i for i in kept} for kept in masks for at in range(n - kept[-1])]
        for gone in itertools.combinations(range(n), n - math.ceil(n * decontam.AGREE)):
            assert any(seed.isdisjoint(gone) for seed in seeds), (n, gone)
    assert decontam.masks_for(500) == decontam.masks_for(decontam.WINDOW)


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_overlaps_that_fixed_masks_missed(spark, seeds):
    """Items of every length, with all differences that count and with one more."""
    rng = random.Random(1)
    items, docs, want = [], [], set()
    for n in range(1, 25):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        window = min(n, decontam.WINDOW)
        most = window - math.ceil(window * decontam.AGREE)
        for k in range(12):
            begin = rng.randrange(n - window + 1)
            gone = rng.sample(range(begin, begin + window), most + k % 2)
            part = ["x" if p in gone else words[p] for p in range(begin, begin + window)]
            docs.append((len(docs), " ".join(["before", *part, "after"])))
            if k % 2 == 0:
                want.add((len(docs) - 1, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame(docs, DOC), bench, seeds).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want


PERIODIC = """
from granary.session import local_session
from granary.llm import decontam
spark = local_session(cores=1, shuffle_partitions=2)
item = [f"w{k}" for k in range(40)]
docs = spark.createDataFrame([(1, " ".join(["before", *item * 400])), (2, "nothing of it")], "doc_id long, text string")
bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")
found = decontam.contaminated(docs, bench, SEEDS).orderBy("item_id").collect()
print("FOUND", [(r.doc_id, r.item_id, r.n_item, r.n_aligned, r.n_matched, r.best, r.doc_begin % 40) for r in found])
"""


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_many_hits_in_a_long_document_need_little_memory(seeds):
    """16,001 tokens and some 96,000 seed hits: with the tokens of the whole document in the row of each hit these are 12 GB."""
    env = os.environ | {"GRANARY_DRIVER_MEMORY": "700m", "PYTHONPATH": str(Path(__file__).parents[2])}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", PERIODIC.replace("SEEDS", str(seeds))], env=env, capture_output=True, text=True, timeout=240)
    assert "FOUND [(1, 1, 40, 40, 40, 16, 1), (1, 2, 40, 40, 40, 16, 1)]" in run.stdout, run.stderr[-2000:]


def test_equal_items_and_one_id_for_two_texts(spark):
    """Items of equal tokens are all named; of two texts under one id the better one counts."""
    other = " ".join(f"o{k}" for k in range(20))
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM.upper()), (3, other), (3, ITEM), (None, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {changed(ITEM, 2)}"), (1, f"x {changed(ITEM, 2)}"), (None, ITEM), (2, f"y y {other} {changed(ITEM, 1, 5)}")], DOC)
    found = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.doc_begin, r.n_matched) for r in found) == [
        (0, 1, 0, 20), (0, 2, 0, 20), (0, 3, 0, 20), (1, 1, 1, 19), (1, 2, 1, 19), (1, 3, 1, 19), (2, 1, 22, 18), (2, 2, 22, 18), (2, 3, 2, 20),
    ]


def test_native_plan(spark, sf_dir):
    from granary import llm

    queries, _ = llm.load()
    for name in ("op6_decontaminate", "op9_exact_dedup"):
        plan = queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop")), name


def test_index_takes_another_table_with_the_same_id_range(spark, tmp_path):
    """A second table whose ids span the same range is a new batch: its new texts are added, none is lost."""
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    frame = lambda rows: spark.createDataFrame(rows, DOC)
    exact.dedup(frame([(1, "a"), (3, "b")]), index).collect()
    second = {r.doc_id: r for r in exact.dedup(frame([(1, "a"), (2, "new"), (3, "b")]), index).collect()}
    assert [(second[i].keep_id, second[i].kept) for i in (1, 2, 3)] == [(1, True), (2, True), (3, True)]
    # a rerun of the same table is recognised and adds nothing
    again = {r.doc_id: r for r in exact.dedup(frame([(1, "a"), (2, "new"), (3, "b")]), index).collect()}
    assert {i: again[i].group_size for i in (1, 2, 3)} == {i: second[i].group_size for i in (1, 2, 3)}
    # a table without ids is a batch of its own as well
    lone = exact.dedup(frame([(None, "only here")]), index).collect()
    assert [(r.keep_id, r.kept, r.group_size) for r in lone] == [(None, True, 1)]
