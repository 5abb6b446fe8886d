"""Properties of trained trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import boost, crossval
from granary.operators.forest import load_model, predict, save_model
from granary.operators.relate import bag_difference
from granary.operators.train import train_gbt
from granary.plans import boosting
from granary.sources import synth

FAST = {"max_depth": 2, "max_bin": 16, "eta": 0.3}
ROWS = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    return spark.range(2000).select(
        "id",
        F.when(i % 10 != 3, (i * 7919 % 1000) / 100.0).alias("f0"),
        ((i * 104729) % 50).cast("double").alias("f1"),
        (i % 6).cast("int").alias("f2"),
    ).withColumns(
        {
            "y": F.coalesce(F.col("f0"), F.lit(9.0)) * 2 + F.when(F.col("f2").isin(1, 4), 15.0).otherwise(0.0),
            "is_valid": F.col("id") % 5 == 0,
        }
    ).withColumns({"b": (F.col("y") > 12).cast("int"), "c": (F.col("f1") / 20).cast("int")}).repartition(4).persist()


def rmse(df, y="y", p="prediction"):
    return df.agg(F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2))).first()[0]


def test_loss_falls_and_nodes_are_consistent(spark, data):
    model = train_gbt(data, ROWS, "y", FAST, 3, valid="is_valid")
    scores = [h["train", "rmse"] for h in model.history]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)
    assert model.history[-1]["valid", "rmse"] < 0.9 * model.history[0]["valid", "rmse"]
    for t in model.trees:
        assert t.cover[0] == 1600
        for n, f in enumerate(t.feature):
            if f >= 0:
                assert t.cover[n] == pytest.approx(t.cover[t.left[n]] + t.cover[t.right[n]])
    # the score of the last round is that of the stored model
    assert rmse(predict(data.where("NOT is_valid"), model)) == pytest.approx(scores[-1], rel=1e-9)


def test_one_split_equals_the_split_operator(spark, data):
    model = train_gbt(data, ["f1"], "y", {**FAST, "max_depth": 1, "eta": 1.0, "tree_method": "exact"}, 1)
    t = model.trees[0]
    base = model.base[0]
    cut = t.split_value[0]
    left = data.where(F.col("f1") < cut).agg(F.sum(F.col("y") - base), F.count("*")).first()
    assert t.weight[t.left[0]][0] == pytest.approx(left[0] / (left[1] + 1), rel=1e-6)
    # and the gain is that of the best split over all values
    hist = boost.histogram(
        data.select(F.lit(0).alias("node"), F.col("f1").alias("b"), (F.lit(base) - F.col("y")).alias("g"), F.lit(1.0).alias("h")), ["b"]
    )
    best = boost.best_splits(hist, FAST).first()
    assert t.gain[0] == pytest.approx(best["gain"], rel=1e-6)


def test_rounds_beyond_a_truncation(spark, data, monkeypatch):
    from granary.operators import train

    plain = train_gbt(data, ROWS, "y", FAST, 3, exact_cuts=True)
    monkeypatch.setattr(train, "TRUNCATE_EVERY", 1)
    cut = train_gbt(data, ROWS, "y", FAST, 3, exact_cuts=True)
    assert [t.weight for t in plain.trees] == [t.weight for t in cut.trees]


def test_partitioning_does_not_matter(spark, data):
    a = train_gbt(data.repartition(5), ROWS, "y", FAST, 2, exact_cuts=True, n_tasks=5)
    b = train_gbt(data.repartition(3, "f2"), ROWS, "y", FAST, 2, exact_cuts=True, n_tasks=1)
    assert bag_difference(a.nodes(spark), b.nodes(spark)).first()["equal"]


def test_sampling_is_reproducible_and_needs_an_id(spark, data):
    params = {**FAST, "subsample": 0.5, "colsample_bytree": 0.7, "colsample_bynode": 0.7}
    with pytest.raises(ValueError):
        train_gbt(data, ROWS, "y", params, 1)
    a = train_gbt(data, ROWS, "y", params, 1, row_id="id", exact_cuts=True)
    b = train_gbt(data.repartition(3), ROWS, "y", params, 1, row_id="id", exact_cuts=True)
    assert a.trees[0].weight == b.trees[0].weight
    assert 800 < a.trees[0].cover[0] < 1200


def test_forest_averages_its_trees(spark, data):
    model = train_gbt(data, ROWS, "y", {**FAST, "num_parallel_tree": 3, "eta": 1.0}, 1, exact_cuts=True)
    one = train_gbt(data, ROWS, "y", {**FAST, "eta": 1.0}, 1, exact_cuts=True)
    # without sampling the trees are alike, so three thirds make one tree
    assert len(model.trees) == 3
    assert np.allclose(3 * np.array(model.trees[0].weight), np.array(one.trees[0].weight))


def test_lossguide_limits_leaves(spark, data):
    model = train_gbt(data, ROWS, "y", {**FAST, "grow_policy": "lossguide", "max_leaves": 4, "max_depth": 0}, 1)
    assert sum(f < 0 for f in model.trees[0].feature) == 4


def test_categorical_splits_need_no_order(spark, data):
    params = {**FAST, "max_depth": 1, "eta": 1.0, "reg_lambda": 0.0}
    part = train_gbt(data, ["f2"], "y", {**params, "max_cat_to_onehot": 1}, 1, categorical=["f2"])
    left = set(part.trees[0].categories[0])
    assert left in ({1, 4}, {0, 2, 3, 5})
    hot = train_gbt(data, ["f2"], "y", {**params, "max_cat_to_onehot": 100}, 1, categorical=["f2"])
    assert len(hot.trees[0].categories[0]) == 1
    assert rmse(predict(data, part)) < rmse(predict(data, hot))


def test_unknown_category_takes_the_default_side(spark, data):
    model = train_gbt(data, ["f2"], "y", {**FAST, "max_depth": 1, "max_cat_to_onehot": 1}, 1, categorical=["f2"])
    odd = spark.createDataFrame([(99,), (None,)], "f2 INT")
    assert predict(odd, model).count() == 2


@pytest.mark.parametrize("objective,label,extra", [("binary:logistic", "b", {}), ("multi:softprob", "c", {"num_class": 3})])
def test_classifiers(spark, data, objective, label, extra):
    model = train_gbt(data, ROWS, label, {**FAST, "eta": 1.0, "objective": objective, **extra}, 2)
    losses = [next(iter(h.values())) for h in model.history]
    assert losses[1] < losses[0]
    out = predict(data, model, output="class")
    assert out.agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).first()[0] > 0.9
    probs = predict(data, model).select("prediction").first()[0]
    if extra:
        assert sum(probs) == pytest.approx(1.0)
    else:
        assert 0 < probs < 1


def test_multi_target_strategies(spark, data):
    df = data.withColumn("y2", F.col("y") * 3)
    joint = train_gbt(df, ROWS, ["y", "y2"], {**FAST, "multi_strategy": "multi_output_tree"}, 1)
    assert len(joint.trees) == 1 and len(joint.trees[0].weight[0]) == 2
    single = train_gbt(df, ROWS, ["y", "y2"], FAST, 1)
    assert [t.targets for t in single.trees] == [[0], [1]]
    got = predict(df, joint).select("prediction").first()[0]
    assert len(got) == 2


def test_exact_method_uses_every_value(spark, data):
    model = train_gbt(data, ["f1"], "y", {**FAST, "tree_method": "exact"}, 1)
    assert all(v.is_integer() for v in model.trees[0].split_value if v == v)


def test_model_round_trip(spark, data, tmp_path):
    model = train_gbt(data, ROWS, "y", {**FAST, "max_cat_to_onehot": 1}, 1, categorical=["f2"])
    save_model(model, spark, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert bag_difference(model.nodes(spark), again.nodes(spark)).first()["equal"]
    assert again.params == model.params


def test_callback_sees_every_round(spark, data):
    seen = []
    train_gbt(data, ["f1"], "y", {**FAST, "max_depth": 1}, 3, on_round=lambda r, s: seen.append((r, s["train", "rmse"])))
    assert [r for r, _ in seen] == [0, 1, 2]


def test_synthetic_data_trains(spark):
    df = synth.batches(synth.row_range(spark, 512), 256, 8, sparsity=0.3)
    wide = df.select(*[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(8)], F.get("labels", F.lit(0)).alias("y"))
    model = train_gbt(wide, [f"x{i}" for i in range(8)], "y", {"max_bin": 8, "max_depth": 2, "eta": 0.1}, 2)
    assert model.history[1]["train", "rmse"] < model.history[0]["train", "rmse"]


def test_array_column_equals_single_columns(spark, tmp_path):
    df = synth.batches(synth.row_range(spark, 300), 100, 4, sparsity=0.2).withColumn("y", F.get("labels", F.lit(0)))
    wide = df.select(*[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(4)], "y")
    a = train_gbt(df, "features", "y", FAST, 2, exact_cuts=True)
    b = train_gbt(wide, [f"x{i}" for i in range(4)], "y", FAST, 2, exact_cuts=True)
    assert [(t.feature, t.bin, t.weight) for t in a.trees] == [(t.feature, t.bin, t.weight) for t in b.trees]
    save_model(a, spark, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert rmse(predict(df, again)) == pytest.approx(a.history[-1]["train", "rmse"])


def test_params_are_checked():
    assert boost.Params.of({"lambda": 2.0, "eta": None}).reg_lambda == 2.0
    for bad in ({"objective": "rank"}, {"grow_policy": "x"}, {"objective": "multi:softprob"}):
        with pytest.raises(ValueError):
            boost.Params.of(bad)


def test_cross_validation(spark, tables):
    out = crossval.cross_validate(
        boosting.customer_rows(tables), "label", "p_partkey", "reg:squarederror", ["hist-ohe", "ml_forest-ord"], k=2, n_iter=1, depth=2
    ).collect()
    assert {(r["algo"], r["fold"]) for r in out} == {(a, f) for a in ("hist-ohe", "ml_forest-ord") for f in (0, 1)}
    assert all(r["fit_time"] > 0 and r["score"] < 0 for r in out)


def test_cross_validation_of_classes(spark, data):
    rows = data.select("id", "f0", F.col("f2").cast("string").alias("kind"), "b")
    out = crossval.cross_validate(rows, "b", "id", "binary:logistic", ["hist-part"], k=2, n_iter=1, depth=2).collect()
    assert all(0.5 < r["score"] <= 1 for r in out)


@pytest.mark.parametrize("objective, label", [("reg:squarederror", "y"), ("binary:logistic", "b"), ("multi:softprob", "c")])
def test_subtraction_equals_counting_both_children(spark, data, monkeypatch, objective, label):
    """Larger children derived from parent minus sibling give the same trees as counting every child."""
    from granary.operators import train

    params = {**FAST, "max_depth": 4, "objective": objective, **({"num_class": 3} if objective.startswith("multi") else {})}
    counted_children = []
    subtracted = train._Run._subtracted

    def spy(self, trees, pairs, r):
        counted_children.extend((i, c) for i, _, c, _ in pairs)
        return subtracted(self, trees, pairs, r)

    monkeypatch.setattr(train._Run, "_subtracted", spy)
    derived = train_gbt(data, ROWS, label, params, 2, categorical=["f2"], exact_cuts=True)
    assert counted_children  # the derived path ran

    def count_both(self, trees, pairs, r):
        return self._histogram(trees, sorted({(i, n) for i, _, c, d in pairs for n in (c, d)}), r)

    monkeypatch.setattr(train._Run, "_subtracted", count_both)
    counted = train_gbt(data, ROWS, label, params, 2, categorical=["f2"], exact_cuts=True)
    assert bag_difference(derived.nodes(spark), counted.nodes(spark)).first()["equal"]
    assert [t.weight for t in derived.trees] == [t.weight for t in counted.trees]
