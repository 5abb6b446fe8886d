"""Language identification, toxicity and language-model scores."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary import llm
from granary.llm import langid, ppm, toxic

QUERIES, _ = llm.load()
LARGER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = QUERIES["op3_language_id"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_unknown_and_single(spark):
    docs = spark.createDataFrame([(1, "hello there", "en"), (2, None, "en"), (3, "12 34", "en"), (4, "ok", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "und", "und", "en"] and rows[2].score == 0
    none = langid.identify(docs, langid.fit(docs.filter("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_families_first():
    rng = np.random.default_rng(1)
    langs = ["en", "de", "fr", "es", "xx"] * 30
    x = np.zeros((150, langid.BUCKETS), np.float32)
    for i, lang in enumerate(langs):
        x[i, 10 * sorted(set(langs)).index(lang)] = 1
        x[i, rng.integers(100, 200)] = 0.2
    model = langid.train(x, langs)
    assert set(model.families) == {"germanic", "romance", "~xx"} and ("de", "en") in model.machines and ("de", "fr") not in model.machines
    assert model.predict(x)[0] == langs


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    texts = pa.array(["some words here now", "other words too", "and more words", "four of them here"])
    ids, begin = toxic.slots(texts)
    y, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4)
    net = toxic.ConvNet.fresh(1)
    net.out[:] = rng.normal(0, 1, len(net.out))
    net.bias[:] = 0.5  # away from the kink of the units

    class Seen(toxic._Adam):
        def apply(self, name, value, grad, rows=slice(None)):
            self.state[name] = (rows, grad.copy())

    seen = Seen(0.01)
    toxic._gradients(net, ids, begin, y, weight, seen)

    def loss():
        z = net.logits(ids, begin)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name, value in (("filters", net.filters), ("out", net.out), ("bias", net.bias), ("level", net.level)):
        _, grad = seen.state[name]
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        before = value[at]
        value[at] = before + 1e-2
        up = loss()
        value[at] = before - 1e-2
        slope = (up - loss()) / 2e-2
        value[at] = before
        assert slope == pytest.approx(grad[at], rel=0.1, abs=1e-3), name


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lo", "ma", "ti", "ser") for b in ("na", "po", "ki", "dun", "ga")]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = "vile" + rng.choice(("", "ness", "ly", "r"))
        rows.append((i, " ".join(text), "en", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxic.fit(docs.filter("doc_id < 700"), docs.filter("doc_id < 700").select("doc_id", "toxic"))
    found = toxic.with_scores(docs.filter("doc_id >= 700"), model, "score").toPandas()
    assert ((found.score >= 0.5) == (found.toxic == 1)).mean() > 0.95
    assert list(found.columns) == ["doc_id", "text", "lang", "toxic", "score"]


def test_thresholds_come_from_every_row(spark):
    rng = random.Random(8)
    rows = [(lang, round(rng.gauss(1.0 if toxic else -1.0, 1.0), 1), toxic) for lang in ("en", "de") for toxic in (0, 0, 0, 1) for _ in range(700)]
    rows += [("fr", float(k), k % 2) for k in range(9)]
    found = toxic.thresholds(spark.createDataFrame(rows, "lang string, logit double, toxic int").repartition(5))

    def brute(own):
        at = sorted({x for _, x, _ in own}, reverse=True)
        share = [1.25 * sum(t for _, x, t in own if x >= a) / (sum(x >= a for _, x, _ in own) + 0.25 * sum(t for *_, t in own)) for a in at]
        k = share.index(max(share))
        return (at[k] + (at[k + 1] if k + 1 < len(at) else at[k] - 1)) / 2

    assert found == pytest.approx({"": brute(rows), **{lang: brute([r for r in rows if r[0] == lang]) for lang in ("en", "de")}})


def test_every_labelled_text_is_learned(spark, monkeypatch):
    """Shards far smaller than the table: each word of any labelled text that is taught moves its embedding or its shard's net."""
    monkeypatch.setattr(toxic, "SHARD_ROWS", 64)
    rows = [(i, f"own{i} " + ("vile" if i % 3 == 0 else "fair") + " words", "en" if i % 2 else "de", int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    kept = toxic._round
    monkeypatch.setattr(toxic, "_round", lambda taught, shards, net, r: seen.append((shards, taught.count())) or kept(taught, shards, net, r))
    model = toxic.fit(docs, docs.select("doc_id", "toxic"))
    n = [sum(i % 3 == 0 for i in range(400)), sum(i % 3 != 0 for i in range(400))]
    assert seen == [(7, 400 - sum(-(-k // 4) for k in n))] * toxic.ROUNDS
    found = toxic.with_scores(docs, model, "score").toPandas()
    assert ((found.score >= 0.5) == (found.toxic == 1)).mean() > 0.95


def test_little_is_written_for_learning(spark, monkeypatch):
    """What is written and dealt out is the texts, not their slots, and of a shard's change the embeddings that it met."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=400)) + (" vile" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    written, kept = {}, toxic.materialize

    def noted(df, label, **options):
        out = kept(df, label, **options)
        written[label] = out.select(*[F.sum(F.length(F.col(c).cast("binary")) if kind in ("string", "binary") else F.lit(8)).alias(c) for c, kind in out.dtypes]).first()
        return out

    monkeypatch.setattr(toxic, "materialize", noted)
    toxic.fit(docs, docs.select("doc_id", "toxic"))
    text = sum(len(r[1]) for r in rows)
    assert sum(written["toxic-rows"]) < 1.1 * text
    before = toxic.ConvNet.fresh(1)
    after = toxic.ConvNet.fresh(1)
    after.embed[[5, 9, 60_000]] += 1
    changes = {key: (total, weight) for key, total, weight in toxic._changes(before, after)}
    assert sum(total.nbytes for total, _ in changes.values()) < 8 * (after.filters.size + 1000)
    assert {key: int(weight.sum()) for key, (_, weight) in changes.items()} == {"embed\t0": 2, "embed\t57344": 1, "net": 1}


def test_more_ids_than_are_broadcast(spark, monkeypatch):
    """Beyond the number of ids that are broadcast the scores are the same, and few texts without a label are dealt out for the join."""
    rows = [(7 * i, ("vile " if i % 4 == 0 else "fair ") + f"words of {i}", "en", int(i % 4 == 0)) for i in range(4000)]
    rows += [(None, "vile words", "en", 1), (7, "fair copy of an id", None, 0), (14, None, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.where("doc_id % 3 = 0").select("doc_id", "toxic")
    ids = labels.distinct()
    met = toxic._likely(docs.select("doc_id", "text"), ids, ids.count())
    assert met.join(ids, "doc_id").count() == docs.join(ids, "doc_id").count()
    assert met.columns == ["doc_id", "text"] and met.join(ids, "doc_id", "left_anti").count() < 0.08 * len(rows)
    scores = []
    for most in (1_000_000, 10):
        monkeypatch.setattr(toxic, "MOST_BROADCAST", most)
        found = toxic.with_scores(docs, toxic.fit(docs, labels), "score")
        scores.append(sorted(found.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")), "score").collect()))
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    model = toxic.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.toxicity for r in toxic.with_scores(docs, model).collect()] == [0.0, 0.0]


def brute_scores(train, texts, order):
    """Word and byte models by dictionaries."""
    split = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
    stream = lambda w: b"\n" * order + b" ".join(w) + b"\n"
    words, after = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        w = split(t)
        words.update([*w, None])
        s = stream(w)
        for j in range(order, len(s)):
            for k in range(order + 1):
                after[k][s[j - k : j]][s[j]] += 1

    def byte(s, j):
        total, gone = 0.0, set()
        for k in range(order, -1, -1):
            seen = {b: n for b, n in after[k].get(s[j - k : j], {}).items() if b not in gone}
            if not seen:
                continue
            if s[j] in seen:
                return total + math.log10((seen[s[j]] - 0.5) / sum(seen.values()))
            total += math.log10(0.5 * len(seen) / sum(seen.values()))
            gone |= set(seen)
        return total - math.log10(256 - len(gone))

    n, v = sum(words.values()), len(words)
    out = []
    for t in texts:
        w = split(t)
        s = stream(w)
        base = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])
        out.append((len(w) + 1, sum(words[x] > 0 for x in [*w, None]), n, base, sum(byte(s, j) for j in range(order, len(s)))))
    return out


@pytest.mark.parametrize(("shard", "head"), [(10_000, 1000), (40, 3)])
def test_scores_match_brute_force(spark, shard, head):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += [None, "", " \t", "ABC \n Abc", "zq ÿ \x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ppm.train(docs.filter("doc_id % 3 > 0"), order=3, shard=shard)
    assert (model["shards"] > 1) == (shard < 1000)
    found = {r.doc_id: r for r in ppm.scores(docs, model, head=head).collect()}
    want = brute_scores([t for i, t in enumerate(texts) if i % 3], texts, 3)
    for i, (n, known, total, base, score) in enumerate(want):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_probabilities_add_up():
    stream, at, _, _ = ppm.streams(pa.array(["abab abc", "cab", ""]))
    gram = ppm.grams(stream, at, 2)
    keys, n = np.unique(gram, return_counts=True)
    pairs, pair_n = np.unique(gram & np.uint64(0xFFFF), return_counts=True)
    trie = ppm.Trie(keys, n, pairs, pair_n, 2)
    for context in (b"ab", b"ca", b"zz", b"\n\n", b"za"):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        assert 0.5 < (10 ** trie.log10(base + np.arange(256, dtype=np.uint64))).sum() <= 1 + 1e-9


def test_untrained_scores(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in ppm.scores(docs, ppm.train(docs.limit(0))).collect()}
    assert found[1].n_known == 0 and found[1].score == pytest.approx(4 * -math.log10(256))
