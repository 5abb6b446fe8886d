"""Boosting queries: the steps with SQL oracles, and whole training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arith import int_div
from granary.operators import boost, crossval
from granary.operators.forest import Ensemble, Tree, load_model, predict, save_model
from granary.operators.train import train_gbt
from granary.plans import fixtures as fx
from granary.plans.boosting_sql import evals_sql, training_sql
from granary.plans.registry import Tables, query, r6
from granary.session import materialize, scratch_path
from granary.sources.datasets import BINARY, REGRESSION

SOFTMAX_SQL = ", ".join(
    f"round(exp(m{k}) / (exp(m0) + exp(m1) + exp(m2)) - CASE WHEN cls = {k} THEN 1 ELSE 0 END, 6) AS sg{k}, "
    f"round(2 * (exp(m{k}) / (exp(m0) + exp(m1) + exp(m2))) * (1 - exp(m{k}) / (exp(m0) + exp(m1) + exp(m2))), 6) AS sh{k}"
    for k in range(3)
)


@query(
    "grad_hess",
    f"""
    WITH s AS (SELECT l_orderkey, l_extendedprice AS y, l_quantity * 2000 AS m, (l_quantity - 25) / 10 AS lm,
      CAST(l_linestatus = 'O' AS INTEGER) AS pos, l_quantity / 50 AS m0, l_discount * 10 AS m1, l_tax * 10 AS m2,
      l_linenumber % 3 AS cls FROM lineitem)
    SELECT l_orderkey, round(m - y, 6) AS g, 1.0e0 AS h, round(1 / (1 + exp(-lm)) - pos, 6) AS lg,
      round(1 / (1 + exp(-lm)) * (1 - 1 / (1 + exp(-lm))), 6) AS lh, {SOFTMAX_SQL} FROM s
    """,
)
def _(t: Tables):
    s = t.lineitem.select(
        "l_orderkey",
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.lit(2000)).alias("m"),
        ((F.col("l_quantity") - F.lit(25)) / F.lit(10)).alias("lm"),
        (F.col("l_linestatus") == "O").cast("int").alias("pos"),
        (F.col("l_quantity") / F.lit(50)).alias("m0"),
        (F.col("l_discount") * F.lit(10)).alias("m1"),
        (F.col("l_tax") * F.lit(10)).alias("m2"),
        F.pmod("l_linenumber", F.lit(3)).alias("cls"),
    )
    s = boost.grad_hess(s, REGRESSION, "y", "m").withColumnsRenamed({"g": "g0", "h": "h0"})
    s = boost.grad_hess(s, BINARY, "pos", "lm").withColumnsRenamed({"g": "lg", "h": "lh"})
    s = boost.grad_hess(s, "multi:softprob", "cls", ["m0", "m1", "m2"])
    soft = []
    for k in range(3):
        soft += [r6(F.get("g", F.lit(k))).alias(f"sg{k}"), r6(F.get("h", F.lit(k))).alias(f"sh{k}")]
    return s.select(
        "l_orderkey", r6("g0").alias("g"), F.col("h0").alias("h"), r6("lg").alias("lg"), r6("lh").alias("lh"), *soft
    )


def binned(t: Tables) -> DataFrame:
    """Line items with three binned features, the last with missing values, in two nodes."""
    price = int_div(F.col("o_totalprice").cast("bigint"), 50000).cast("int")
    return fx.enriched(t).select(
        F.pmod("l_linenumber", F.lit(2)).alias("node"),
        int_div(F.col("l_quantity").cast("bigint"), 5).cast("int").alias("b0"),
        F.round(F.col("l_discount") * F.lit(100)).cast("int").alias("b1"),
        F.coalesce(price, F.lit(-1)).alias("b2"),
        (F.lit(50000.0) - F.col("l_extendedprice")).alias("g"),
        F.lit(1.0).alias("h"),
    )


BINNED_SQL = f"""SELECT CAST(l_linenumber % 2 AS INTEGER) AS node, CAST(trunc(l_quantity) AS BIGINT) // 5 AS b0,
  CAST(round(l_discount * 100) AS BIGINT) AS b1,
  CASE WHEN o_totalprice IS NULL THEN -1 ELSE CAST(trunc(o_totalprice) AS BIGINT) // 50000 END AS b2,
  50000.0e0 - l_extendedprice AS g, 1.0e0 AS h FROM ({fx.ENRICHED_SQL})"""
HIST_SQL = "SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT node, {i} AS feature, CAST(b{i} AS INTEGER) AS bin, g, h FROM ({BINNED_SQL})" for i in range(3)
) + ") GROUP BY 1, 2, 3"


@query("gbt_histogram", f"SELECT node, feature, bin, round(g, 2) AS g, h, n FROM ({HIST_SQL})")
def _(t: Tables):
    return boost.histogram(binned(t), ["b0", "b1", "b2"]).withColumn("g", F.round("g", 2))


SPLIT_SQL = """
    WITH hist AS ({hist}), c AS (
      SELECT node, feature, bin, sum(g) OVER all_bins AS tg, sum(h) OVER all_bins AS th,
        coalesce(sum(CASE WHEN bin = -1 THEN g END) OVER all_bins, 0) AS mg,
        coalesce(sum(CASE WHEN bin = -1 THEN h END) OVER all_bins, 0) AS mh,
        sum(CASE WHEN bin >= 0 THEN g ELSE 0 END) OVER upto AS cg, sum(CASE WHEN bin >= 0 THEN h ELSE 0 END) OVER upto AS ch
      FROM hist WINDOW all_bins AS (PARTITION BY node, feature), upto AS (PARTITION BY node, feature ORDER BY bin
        ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, FALSE AS default_left, cg AS lg, ch AS lh FROM c WHERE bin >= 0
      UNION ALL SELECT *, TRUE, cg + mg, ch + mh FROM c WHERE bin >= 0),
    e AS (SELECT *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) AS gain
      FROM d WHERE lh >= 1 AND th - lh >= 1)
    SELECT node, feature, bin, default_left, round(gain, 0) AS gain FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 0) DESC, feature, bin, default_left) AS pos FROM e)
    WHERE pos = 1
    """


@query("gbt_best_split", SPLIT_SQL.format(hist=HIST_SQL))
def _(t: Tables):
    best = boost.best_splits(boost.histogram(binned(t), ["b0", "b1", "b2"]), {"reg_lambda": 1.0}, digits=0)
    return best.select("node", "feature", "bin", "default_left", "gain")


BRANDS_SQL = """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS brand FROM part"""
CAT_HIST_SQL = f"""SELECT CAST(l_linenumber % 2 AS INTEGER) AS node, brand AS bin, sum(50000.0e0 - l_extendedprice) AS g,
  CAST(count(*) AS DOUBLE) AS h FROM lineitem JOIN ({BRANDS_SQL}) ON l_partkey = p_partkey GROUP BY 1, 2"""


def brand_histogram(t: Tables) -> DataFrame:
    from granary.operators.encode import apply_dictionary, dictionary

    brands = apply_dictionary(t.part.select("p_partkey", "p_brand"), dictionary(t.part, "p_brand"), "p_brand", "brand")
    joined = t.lineitem.join(brands, F.col("l_partkey") == F.col("p_partkey")).select(
        F.pmod("l_linenumber", F.lit(2)).alias("node"),
        "brand",
        (F.lit(50000.0) - F.col("l_extendedprice")).alias("g"),
        F.lit(1.0).alias("h"),
    )
    return boost.histogram(joined, ["brand"])


def _left_set(best: DataFrame) -> DataFrame:
    codes = F.array_join(F.sort_array("categories").cast("array<string>"), ",")
    return best.select("node", codes.alias("left_set"), "gain")


CAT_SPLIT_SQL = """
    WITH hist AS ({hist}), c AS (SELECT node, bin, sum(g) OVER w AS tg, sum(h) OVER w AS th, {left},
        row_number() OVER o AS pos, count(*) OVER w AS nb
      FROM hist WINDOW w AS (PARTITION BY node), o AS (PARTITION BY node ORDER BY g / (h + 1), bin ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, round(lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1), 0) AS gain
      FROM c WHERE lh >= 1 AND th - lh >= 1 AND {bound})
    SELECT node, array_to_string(list_sort(cats), ',') AS left_set, gain FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, bin) AS r FROM e) WHERE r = 1
    """


@query(
    "gbt_categorical_split",
    CAT_SPLIT_SQL.format(
        hist=CAT_HIST_SQL, left="sum(g) OVER o AS lg, sum(h) OVER o AS lh, list(bin) OVER o AS cats",
        bound="(pos <= 8 OR nb - pos <= 8)",
    ),
)
def _(t: Tables):
    """Categories ordered by leaf weight; at most eight of them on the smaller side."""
    best = boost.best_splits(brand_histogram(t), {"max_cat_threshold": 8}, {0: "partition"}, digits=0)
    return _left_set(best)


@query(
    "gbt_onehot_split",
    CAT_SPLIT_SQL.format(hist=CAT_HIST_SQL, left="g AS lg, h AS lh, [bin] AS cats", bound="TRUE"),
)
def _(t: Tables):
    """One category against the rest."""
    return _left_set(boost.best_splits(brand_histogram(t), {}, {0: "onehot"}, digits=0))


FEATURES = ["l_quantity", "l_discount", "l_tax", "o_totalprice"]
SMALL = {"max_depth": 3, "max_bin": 32, "eta": 0.5}


def training_rows(t: Tables, row_id=None) -> DataFrame:
    """Whole line items with a validation mark by ship date and several labels; ``row_id`` by default a hash of the item."""
    if row_id is None:
        row_id = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return fx.enriched(t).select(
        *FEATURES,
        (F.col("l_extendedprice") / F.lit(1000)).alias("price"),
        (F.col("l_extendedprice") * F.col("l_discount") / F.lit(1000)).alias("rebate"),
        (F.col("l_extendedprice") > 50000).cast("int").alias("dear"),
        F.pmod("l_linenumber", F.lit(3)).alias("line_class"),
        (F.dayofmonth("l_shipdate") >= 25).alias("is_valid"),
        row_id.alias("row_id"),
    )


def stored_rows(t: Tables, *columns: str, row_id=None) -> DataFrame:
    """The features and the named columns of ``training_rows``, written: a training run reads its rows several times, and
    the join behind them is made once."""
    return materialize(training_rows(t, row_id).select(*FEATURES, *columns), "training-rows")


def training_rows_sql(label: str, valid: str = "day(l_shipdate) >= 25", key: str = "NULL") -> str:
    """Rows numbered by ``rid``; ``skey`` is the key that row sampling draws from."""
    return f"""SELECT row_number() OVER () AS rid, {key} AS skey, {", ".join(FEATURES)}, {label} AS y, {valid} AS is_valid
      FROM ({fx.ENRICHED_SQL})"""


# a line item's key as one integer, the same in Spark and SQL (not unique: items that share it are drawn together)
LINE_KEY_SQL = "l_orderkey * 8 + l_linenumber"
ROW_SAMPLE = {**SMALL, "subsample": 0.5, "seed": 7}


@query(
    "train_gbt_rowsample",
    training_sql(
        training_rows_sql("l_extendedprice / 1000", key=LINE_KEY_SQL), FEATURES, ROW_SAMPLE, 2, evals_sql(2),
        keep=lambda r: boost.subsample_keep_sql("skey", r, 0, ROW_SAMPLE["subsample"], ROW_SAMPLE["seed"]),
    ),
)
def _(t: Tables):
    """Row sampling: each round's tree learns from the half of the rows that an integer mix of the line key selects."""
    rows = stored_rows(t, "price", "is_valid", "row_id", row_id=F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    model = train_gbt(rows, FEATURES, "price", ROW_SAMPLE, 2, row_id="row_id", valid="is_valid", exact_cuts=True)
    return model.evals(t.spark).withColumn("score", r6("score"))


@query("train_gbt", training_sql(training_rows_sql("l_extendedprice / 1000"), FEATURES, SMALL, 3, evals_sql(3)))
def _(t: Tables):
    model = train_gbt(stored_rows(t, "price", "is_valid"), FEATURES, "price", SMALL, 3, valid="is_valid", exact_cuts=True)
    return model.evals(t.spark).withColumn("score", r6("score"))


@query(
    "train_gbt_logistic",
    training_sql(training_rows_sql("CAST(l_extendedprice > 50000 AS DOUBLE)"), FEATURES, SMALL, 2, evals_sql(2, True), True),
)
def _(t: Tables):
    params = {**SMALL, "objective": BINARY}
    model = train_gbt(stored_rows(t, "dear", "is_valid"), FEATURES, "dear", params, 2, valid="is_valid", exact_cuts=True)
    return model.evals(t.spark).withColumn("score", r6("score"))


@query("train_gbt_lossguide")
def _(t: Tables):
    params = {**SMALL, "grow_policy": "lossguide", "max_leaves": 5, "max_depth": 0}
    return train_gbt(stored_rows(t, "price", "is_valid"), FEATURES, "price", params, 2, valid="is_valid").nodes(t.spark)


@query("train_gbt_subsample")
def _(t: Tables):
    params = {**SMALL, "subsample": 0.5, "colsample_bytree": 0.75, "colsample_bynode": 0.75}
    return train_gbt(stored_rows(t, "price", "row_id"), FEATURES, "price", params, 2, row_id="row_id").nodes(t.spark)


@query("train_gbt_forest")
def _(t: Tables):
    params = {**SMALL, "num_parallel_tree": 3, "subsample": 0.7}
    return train_gbt(stored_rows(t, "price", "row_id"), FEATURES, "price", params, 1, row_id="row_id").nodes(t.spark)


@query("train_gbt_multi")
def _(t: Tables):
    """One multi-output run, one run with a tree per output and one multi-class run."""
    rows = stored_rows(t, "price", "rebate", "line_class")
    runs = {
        "joint": ({**SMALL, "multi_strategy": "multi_output_tree"}, ["price", "rebate"]),
        "single": (SMALL, ["price", "rebate"]),
        "softmax": ({**SMALL, "objective": "multi:softprob", "num_class": 3}, "line_class"),
    }
    out = None
    for name, (params, labels) in runs.items():
        evals = train_gbt(rows, FEATURES, labels, params, 1).evals(t.spark).withColumn("run", F.lit(name))
        out = evals if out is None else out.unionByName(evals)
    return out


@query(
    "train_partition_invariance",
    training_sql(
        training_rows_sql("l_extendedprice / 1000", "FALSE"), FEATURES, SMALL, 2,
        f"SELECT tasks, e.* FROM ({evals_sql(2)}) e CROSS JOIN (VALUES (2), (7)) AS v(tasks)",
    ),
)
def _(t: Tables):
    """The same model, bit for bit, from two ways of cutting the rows into tasks, and its scores."""
    rows = stored_rows(t, "price")
    models = {
        n: train_gbt(r, FEATURES, "price", SMALL, 2, exact_cuts=True, n_tasks=n)
        for r, n in ((rows.repartition(7), 7), (rows.repartition(3, "l_quantity"), 2))
    }
    nodes = [m.nodes(t.spark).collect() for m in models.values()]
    if nodes[0] != nodes[1]:
        raise AssertionError("the models differ")
    out = None
    for n, model in models.items():
        one = model.evals(t.spark).withColumn("score", r6("score")).withColumn("tasks", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "model_roundtrip",
    training_sql(
        training_rows_sql("l_extendedprice / 1000", "FALSE"), FEATURES, SMALL, 1,
        """SELECT count(*) AS n, round(avg(m), 6) AS mean, round(min(m), 6) AS low, round(max(m), 6) AS high
           FROM rows JOIN m1 USING (rid)""",
    ),
)
def _(t: Tables):
    """Predictions of a stored and reloaded model."""
    rows = stored_rows(t, "price")
    path = scratch_path(t.spark, "model")
    save_model(train_gbt(rows, FEATURES, "price", SMALL, 1, exact_cuts=True), t.spark, path)
    found = predict(rows, load_model(t.spark, path)).agg(
        F.count(F.lit(1)).alias("n"), *[r6(f("prediction")).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    )
    return found


@query(
    "predict_gbt",
    training_sql(
        training_rows_sql("l_extendedprice / 1000"), FEATURES, SMALL, 2,
        "SELECT is_valid, count(*) AS n, round(avg(m), 6) AS mean, round(avg(y), 6) AS mean_price FROM rows JOIN m2 USING (rid) GROUP BY is_valid",
    ),
)
def _(t: Tables):
    rows = stored_rows(t, "price", "is_valid")
    model = train_gbt(rows, FEATURES, "price", SMALL, 2, valid="is_valid", exact_cuts=True)
    out = predict(rows, model)
    return out.groupBy("is_valid").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("prediction")).alias("mean"), r6(F.avg("price")).alias("mean_price")
    )


def stump() -> Ensemble:
    """A fixed model of one split: quantity below 25 goes left, missing goes right."""
    tree = Tree(0, [0])
    tree.add([0.0], 2.0)
    left, right = tree.add([-10.5], 1.0), tree.add([20.25], 1.0)
    split = {"feature": 0, "bin": 24, "split_value": 25.0, "categories": None, "default_left": False, "gain": 1.0}
    tree.divide(0, split, left, right)
    return Ensemble(boost.Params(), ["l_quantity"], [50.0], [tree])


@query(
    "predict_stump",
    """
    SELECT l_orderkey, l_quantity, CASE WHEN l_quantity < 25 THEN 39.5e0 ELSE 70.25e0 END AS prediction
    FROM (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity FROM lineitem)
    """,
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"))
    return predict(rows, stump())


def customer_rows(t: Tables) -> DataFrame:
    """Parts with two categories and two numbers, one with missing values, and a price to predict."""
    return t.part.select(
        "p_partkey",
        "p_brand",
        "p_type",
        F.when(F.pmod("p_partkey", F.lit(9)) != 0, F.col("p_size")).alias("p_size"),
        (F.col("p_retailprice") / F.lit(10)).alias("label"),
    )


@query("ml_baseline")
def _(t: Tables):
    """Library baselines on ordinal codes with missing values filled."""
    from granary.operators.clean import fill_missing
    from granary.operators.metrics import rmse
    from granary.sources.datasets import encoded

    coded, _mask = encoded(customer_rows(t), "ord", "label")
    rows = fill_missing(coded, -1)
    features = [c for c in rows.columns if c not in ("label", "p_partkey")]
    out = None
    for name in crossval.BASELINES:
        fitted = crossval.ml_estimator(name, features, "label", REGRESSION, 3, 3).fit(rows)
        one = rmse(fitted.transform(rows), "label", "prediction").withColumn("algo", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("cross_validate")
def _(t: Tables):
    """Two of the configurations of the comparison, regression only: ordinal and native partition encoding, one round of depth two."""
    return crossval.cross_validate(
        customer_rows(t), "label", "p_partkey", REGRESSION, ["hist-ord", "hist-part"], n_iter=1, depth=2
    )
