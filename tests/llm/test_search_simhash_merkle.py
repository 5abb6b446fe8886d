"""Ranked search, SimHash components and the Merkle manifest against plain brute-force versions of their contracts."""

import hashlib
import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import merkle, search, simhash
from tests.llm.test_queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WHITE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, fingerprint string, score long"


def rows_of(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"alpha{i % 50} Beta gamma{i % 7}" for i in range(5000))
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, base, "en", "web", 70, "x", "y", 1),
        (2, base + " again", "en", "web", None, "x", "y", 2),
        (3, base.replace("lazy", "sleepy"), "en", None, 71, None, None, None),
        (4, "Le renard brun saute par-dessus le chien paresseux élan été", "fr", "news", 60, "x", "y", 3),
        (5, "", "fr", "news", 0, "x", "y", 4),
        (6, None, None, None, None, None, None, None),
        (None, "orphan text about the river", "de", "web", 27, "x", "y", 5),
        (None, None, "de", "web", None, "x", "y", 6),
        (7, long, "en", "books", len(long), "x", "y", 7),
        (8, "   \t\n  ", "en", "web", 7, "x", "y", 8),
        (9, "river bank river bank RIVER", "en", "web", 27, "x", "y", 9),
        (9, "river bank river bank RIVER", "en", "web", 27, "x", "y", 9),
        (10, "日本語のテキスト river", None, "web", 12, "x", "y", 10),
        (11, "fox dog", "es", "web", 7, "x", "y", 11),
    ]
    return spark.createDataFrame(rows, DOCS)


ITEMS = [(1, "The lazy dog by the river"), (2, "alpha3 beta"), (None, "river bank"), (3, ""), (4, None), (5, "fox fox dog")]


# ---------------------------------------------------------------- ranked search


def brute_search(docs, items, k=10):
    terms = [TERM.findall(t.translate(LOWER)) if t is not None else [] for _, t in docs]
    big_n = sum(1 for t in terms if t)
    big_l = sum(len(t) for t in terms)
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, text in items:
        q = TERM.findall(text.translate(LOWER)) if text is not None else []
        found = []
        for (doc_id, _), t in zip(docs, terms):
            if not t:
                continue
            m = 25 + (75 * len(t) * big_n) // big_l
            score = 0
            for w in q:
                tf = t.count(w)
                if tf:
                    weight = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1)))
                    score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((score, doc_id))
        found.sort(key=lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0))
        out += [(item_id, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark):
    docs = rows_of(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in search.search(docs, items).collect()), key=repr)
    assert got == brute_search([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert any(r[0] is None for r in got)  # a null item_id is a query like any other


def test_search_ties_and_many_masks(spark):
    """Many documents with equal scores: ranks by ascending doc_id, exactly k of them."""
    rows = [(i, f"shared word{i % 3} filler{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "shared word1"), (2, "filler7 shared")]
    got = sorted((tuple(r) for r in search.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == brute_search(rows, items)


def test_terms_equal_the_pattern(spark):
    """Splitting between terms gives the maximal matches of the term pattern, also for digits, non-ASCII and
    supplementary characters, control characters, leading and trailing separators, empty and null texts."""
    texts = ["", None, "  ", "A1b2,,C3__d\x00e\x7f", "\U0001F600x\U0001F600 \u00e9t\u00e9!", "-lead trail-", "\u65e5\u672c\u8a9e the", "x" * 70000]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
           .select(search.terms(F.col("text")).alias("t")).orderBy("i").collect()]
    assert got == [TERM.findall(t.translate(LOWER)) if t is not None else [] for t in texts]


def test_search_sums_hits_without_an_exchange(spark, monkeypatch):
    """The postings are written in buckets of rows, so the hits of a row are summed per query where they are read."""
    plans = {}
    keep = search.narrow

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(search, "narrow", spy)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    search.search(rows_of(spark), items).collect()
    scored = plans["search-scored"]
    above_scan = scored.split("search_postings_")[0]
    assert "Bucketed: true" in scored and "Exchange hashpartitioning(_item" not in scored
    assert "BroadcastHashJoin" in above_scan


def test_search_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs, items).count() == 0
    assert search.search(rows_of(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- simhash


def brute_simhash(docs):
    prints = []
    for _, text in docs:
        words = [w for w in WHITE.split((text or "").translate(LOWER)) if w]
        if not words:
            prints.append(0)
            continue
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs)))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[root(j)] = root(i)
    lows = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            r = root(i)
            lows[r] = min(lows.get(r, doc_id), doc_id)
    return sorted(((d, f"{p:016x}", lows.get(root(i))) for i, ((d, _), p) in enumerate(zip(docs, prints))), key=repr)


def test_simhash_equals_brute_force(spark):
    docs = rows_of(spark)
    got = simhash.components(docs)
    assert {"leaf", "score"} <= set(got.columns)
    rows = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr)
    assert rows == brute_simhash([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_split_hot_block(spark, monkeypatch):
    """A block value shared by more fingerprints than a task holds is split into chunk pairs; links stay whole."""
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "SMALL", 2)
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(base[: 3 + i % 10] + [f"x{i}"])) for i in range(40)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(docs).collect()), key=repr)
    assert got == brute_simhash(rows)


def test_simhash_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_simhash"](spark, sf_dir).collect()), key=repr)
    assert got == brute_simhash([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_simhash_empty(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, n_chars=None):
    values = (r.doc_id, r.source, r.lang, r.n_chars if n_chars is None else n_chars, r.text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def path_of(levels, at):
    path = []
    for below in levels[:-1]:
        mate = at ^ 1
        path.append((mate < at, below[mate]) if mate < len(below) else (False, None))
        at //= 2
    return path


def fold_of(digest, path):
    for left, mate in path:
        digest = H(digest) if mate is None else (H(mate + digest) if left else H(digest + mate))
    return digest


def brute_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees, subroots = {}, []
    for lang in langs:
        group = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[lang] = (group, levels_of([leaf_of(r) for r in group]))
        subroots.append(trees[lang][1][-1][0])
    top = levels_of(subroots)
    out = []
    for li, lang in enumerate(langs):
        group, levels = trees[lang]
        for at, r in enumerate(group):
            path = path_of(levels, at) + path_of(top, li)
            tampered = r.n_chars is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            changed = leaf_of(r, r.n_chars + 1 if tampered else None)
            folded = fold_of(changed, path)
            proof = H("".join(m for _, m in path if m is not None))
            out.append((r.doc_id, leaf_of(r), levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def _manifest_rows(found):
    changed = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    folded = merkle.fold(F.when(hit, changed).otherwise(F.col("leaf")), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("f"), (folded == F.col("root")).alias("v"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_manifest_equals_brute_force(spark):
    docs = rows_of(spark)
    assert _manifest_rows(merkle.manifest(docs)) == brute_manifest(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 33, 300])
def test_manifest_sizes(spark, n):
    """Trees of every shape around the stride: lone leaves, exact powers and one past them."""
    rows = [(i, f"t{i}", "en" if i % 3 else "fr", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _manifest_rows(merkle.manifest(docs)) == brute_manifest(docs.collect())


def test_manifest_query_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()), key=repr)
    want = brute_manifest(docs.collect())
    assert got == want
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(docs).count() == 0
