"""The pipeline against a brute-force version of its stages."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_pairs import brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables with toxic documents, copies, near copies and benchmark passages, and what should remain."""
    rng = random.Random(8)
    syllables = ["na", "po", "ki", "dun", "ga", "mer", "los", "tai"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    item = " ".join(word() for _ in range(30))
    texts = {}
    for i in range(400):
        words = [word() for _ in range(rng.randrange(30, 90))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = "vile"
        elif i % 7 == 0:
            words[10:10] = item.split()
        texts[i] = " ".join(words)
    clean = [i for i in texts if i % 5 and i % 7]
    for k, i in enumerate(clean[:30]):
        texts[400 + k] = texts[i].replace(" ", "  ") if k % 2 else texts[i] + " " + word()
    texts[500] = None
    texts[501] = ""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in texts.items() if i % 10 != 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, item


def test_stages(spark, made):
    path, texts, item = made
    docs = corpus_pipeline.table(spark, path, "documents")
    want = {i: t for i, t in texts.items() if "vile" not in (t or "")}
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "stage")
        assert docs.columns == COLUMNS
        steps.append({r.doc_id: r.text for r in docs.collect()})
    assert steps[0] == want
    first = {}
    for i in sorted(want):
        first.setdefault(" ".join((want[i] or "").split(" ")).replace("  ", " "), i)
    want = {i: want[i] for i in first.values()}
    assert steps[1] == want
    classes = brute_classes(want)
    want = {i: t for i, t in want.items() if classes[i][0] == i}
    assert steps[2] == want
    want = {i: t for i, t in want.items() if item not in (t or "")}
    assert steps[3] == want
    packed = corpus_pipeline.pack_sequences(spark, docs, path).toPandas()
    assert set(packed.doc_id) == set(want)


def test_run_with_extra_columns_and_odd_rows(spark, made, tmp_path):
    path, _, _ = made
    docs = corpus_pipeline.table(spark, path, "documents")
    more = docs.unionByName(spark.createDataFrame([(None, " ".join(["nakipo"] * 9), None, None, None), (0, None, None, None, None)], docs.schema))
    more = more.unionByName(docs.filter("doc_id = 1")).selectExpr("*", "1 AS toxicity", "2 AS digest", "3 AS _kept_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, more, path), "odd")
        assert out.columns == more.columns, name
        more = out
    ids = [r.doc_id for r in more.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 1


def test_empty_table(spark, made, tmp_path):
    path, _, _ = made
    docs = corpus_pipeline.table(spark, path, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0
