"""Queries of the package against their SQL, and edge cases that all operators share."""

import pytest
from pyspark.sql import functions as F

from granary import llm
from granary.llm import automaton, decontam, exact, jaccard, langid, pack, ppm, refine, toxic
from tests.oracle import compare, connect

QUERIES, ORACLES = llm.load()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def odd_documents(spark):
    """Nulls, empty and very long texts, copies, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997} thing{i % 31}" for i in range(30_000))
    texts = [None, "", " \t\n", "a", "a", None, long, long + " end", "é " * 50, "x" * 3000, "no letters? 123"]
    rows = [(i, t, None if i % 2 else "en", "src", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({n: F.lit(1) for n in ("key", "n", "begin", "row", "digest", "hot", "words", "seed")}), texts


def bench(spark, rows=((1, None), (2, ""), (3, "too short"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def operators(spark):
    return {
        "pack": lambda d: pack.pack(d).pieces,
        "automaton": automaton.dedup_passages,
        "refine": refine.dedup_bytes,
        "langid": lambda d: langid.identify(d, langid.fit(d)),
        "jaccard": jaccard.near_duplicates,
        "toxic": lambda d: toxic.with_scores(d, toxic.fit(d, spark.createDataFrame([(0, 1, None), (1, 0, 1)], "doc_id long, quality int, toxic int"))),
        "ppm": lambda d: ppm.scores(d, ppm.train(d)),
        "exact": lambda d: exact.dedup(d, exact.fresh_index(spark), 2),
        "decontam": lambda d: decontam.decontaminate(d, bench(spark)),
    }


NAMES = ["pack", "automaton", "refine", "langid", "jaccard", "toxic", "ppm", "exact", "decontam"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_documents(spark, name):
    docs, texts = odd_documents(spark)
    found = operators(spark)[name](docs).select("doc_id").toPandas()
    assert sorted(set(found.doc_id)) == list(range(len(texts)))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_null_and_repeated_ids(spark, name):
    docs = spark.createDataFrame([(None, "one two three", "en", "s", 1), (None, "four", None, None, None), (7, "five six", "en", "s", 1), (7, "five six", "en", "s", 1)], DOCS)
    found = operators(spark)[name](docs).select("doc_id").toPandas()
    assert len(found) == 4 and found.doc_id.isna().sum() == 2
