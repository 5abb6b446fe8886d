"""Packing, and chat formatting."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import chat, pack

ENCODER = pack.public_encoder()
TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE]", "\\"]), st.text(alphabet="ab\\<>/s[]INSTROLE \n", max_size=40))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    encode = pack.Encoder.of(*ENCODER)
    assert encode(text) == encode.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "\u2028x\u00a0 y", "don't  \n\n stop", "x" * 500, "\x1c \x85a", "ÀÉ ñ ß"])
def test_ids_of_odd_texts(text):
    test_ids_are_those_of_the_tokenizer.hypothesis.inner_test(text)


def test_packing_places_every_piece(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", *(" ".join(["word"] * int(n)) for n in rng.integers(1, 900, 120)), "tok " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    packing = pack.pack(docs)
    found = packing.pieces.join(packing.plan, "piece_key").toPandas().sort_values(["sequence_id", "offset"])
    encode = pack.Encoder.of(*ENCODER)
    for i, t in enumerate(texts):
        own = found[found.doc_id == i].sort_values("piece")
        ids = np.array([*encode.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(map(bytes, own.ids)) == ids.tobytes() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert (own.length.iloc[1:] == 2048).all() and (len(own) == 1) == (len(ids) <= 2048)
        assert [zlib.crc32(bytes(x)) for x in own.ids] == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    by = found.groupby("sequence_id")
    assert (found.offset == by.length.cumsum() - found.length).all() and by.length.sum().max() <= 2048
    assert found.sequence_id.nunique() <= -(-int(found.length.sum()) // 2048) + 2
    sequences = packing.sequences().toPandas().set_index("sequence_id")
    for sequence, rows in by:
        assert bytes(sequences.ids[sequence]) == b"".join(map(bytes, rows.ids))


def test_crossover_keeps_the_pieces():
    rng = np.random.default_rng(2)
    island = pack.Island(rng.integers(1, 100, 300), 5, 100)
    island.settle(4)
    child = island.child(island.people[2], island.people[0])
    assert np.bincount(child, island.length).max() <= 100 and len(child) == 300
    assert set(child.tolist()) == set(range(int(child.max()) + 1))
    before = max(map(island.fitness, island.people))
    island.evolve(30)
    assert max(map(island.fitness, island.people)) >= before


def test_hard_instance_improves():
    """Triples that fill bins exactly, which best-fit alone doesn't find."""
    rng = np.random.default_rng(6)
    sizes = []
    for _ in range(40):
        a, b = sorted(rng.integers(20, 45, 2))
        sizes += [a, b, 100 - a - b]
    island = pack.Island(np.array(sizes), 1, 100)
    island.settle(6)
    start = -max(map(island.fitness, island.people))[0]
    island.evolve(60)
    assert -max(map(island.fitness, island.people))[0] <= start


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<>/s[]INSTROLE ab", max_size=60))
def test_escape_round_trip(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(TURN, max_size=8))
def test_turns_are_read_back(turns):
    found, whole, rewrite = chat.spans(turns, chat.instruct_template)
    assert rewrite is None and [chat.read_turn(whole[a:b])[:2] for a, b in found] == turns
    assert whole == "".join(whole[a:b] for a, b in found)


def test_long_conversation_takes_windows():
    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(200)]
    calls = []

    def counting(part):
        calls.append(len(part))
        return chat.instruct_template(part)

    found, whole, rewrite = chat.spans(turns, counting)
    assert rewrite is None and [chat.read_turn(whole[a:b])[:2] for a, b in found] == turns and sum(calls) < 2500


def test_rewriting_templates_are_seen():
    last_only = lambda turns: "".join(f"<{r}>" + (t if i == len(turns) - 1 else "") for i, (r, t) in enumerate(turns))
    assert chat.spans([("u", "a"), ("v", "b")], last_only)[2] == 1
    numbered = lambda turns: f"{len(turns)} turns:" + "".join(t for _, t in turns)
    assert chat.spans([("u", "a")] * 100, numbered)[2] is not None


def test_rewrites_are_found_at_any_length(spark):
    # the seventh prefix begins otherwise, all others are alike
    odd = lambda turns: ("*" if len(turns) == 7 else "") + chat.instruct_template(turns)
    lengths = {1: 8, 2: 20, 3: 64, 4: 65, 5: 80, 6: 6}
    rows = [(c, k, "user", f"text {k}") for c, n in lengths.items() for k in range(n)]
    found = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), odd).collect()
    assert {r.conv_id: r.rewritten_at for r in found} == {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: None}


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (2, None, "assistant", ""), (None, 0, "user", "x"), (3, 0, "assistant", "</s>"), (3, 1, "assistant", "c")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.formatted(talks)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in found.items()} == {1: (2, 1), 2: (1, 0), None: (1, 0), 3: (2, 5)}
    assert chat.read_back(chat.formatted(talks.limit(0))).count() == 0
