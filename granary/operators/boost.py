"""Gradient-boosted trees as distributed histogram aggregation (Chen and Guestrin, KDD 2016).

The steps are separate operators: gradients, histograms, split choice. ``train_gbt`` in
``granary.operators.train`` runs them in a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import mix

MISSING = -1
MIN_GAIN = 1e-6
MIN_HESS = 1e-16

OBJECTIVES = ("reg:squarederror", "binary:logistic", "multi:softprob")


@dataclass(frozen=True)
class Params:
    """Training options. Names and defaults follow the published library."""

    objective: str = "reg:squarederror"
    tree_method: str = "hist"
    grow_policy: str = "depthwise"
    max_depth: int = 6
    max_leaves: int = 0
    max_bin: int = 256
    eta: float = 0.3
    reg_lambda: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bynode: float = 1.0
    num_parallel_tree: int = 1
    multi_strategy: str = "one_output_per_tree"
    num_class: int = 0
    base_score: float | None = None
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 64
    seed: int = 0

    def __post_init__(self):
        choices = {
            "objective": OBJECTIVES,
            "tree_method": ("hist", "approx", "exact"),
            "grow_policy": ("depthwise", "lossguide"),
            "multi_strategy": ("one_output_per_tree", "multi_output_tree"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.objective == "multi:softprob" and self.num_class < 2:
            raise ValueError("multi:softprob needs num_class")

    @classmethod
    def of(cls, given: dict | Params | None) -> Params:
        """From a dictionary; options that are None keep their default, ``lambda`` is accepted."""
        if isinstance(given, Params):
            return given
        values = {("reg_lambda" if k == "lambda" else k): v for k, v in (given or {}).items() if v is not None}
        return replace(cls(), **values)

    def as_dict(self) -> dict:
        return asdict(self)


def grad_hess(df: DataFrame, objective: str, label: str, margin: str | Sequence[str]) -> DataFrame:
    """Add gradient and hessian of the loss: ``g, h``, or arrays over classes for softmax."""
    y = F.col(label).cast("double")
    if objective == "reg:squarederror":
        return df.withColumns({"g": F.col(margin) - y, "h": F.lit(1.0)})
    if objective == "binary:logistic":
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(margin)))
        return df.withColumns({"g": p - y, "h": F.greatest(p * (F.lit(1.0) - p), F.lit(MIN_HESS))})
    if objective == "multi:softprob":
        top = F.greatest(*[F.col(m) for m in margin])
        df = df.withColumn("__e", F.array(*[F.exp(F.col(m) - top) for m in margin]))
        total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
        df = df.withColumn("__p", F.transform("__e", lambda x: x / total))
        one_hot = lambda p, k: p - F.when(y == k.cast("double"), 1.0).otherwise(0.0)
        return df.withColumns(
            {
                "g": F.transform("__p", one_hot),
                "h": F.transform(
                    "__p", lambda p: F.greatest(F.lit(2.0) * p * (F.lit(1.0) - p), F.lit(MIN_HESS))
                ),
            }
        ).drop("__e", "__p")
    raise ValueError(f"unknown objective: {objective}")


def histogram(df: DataFrame, bins: Sequence[str], node: str = "node", g: str = "g", h: str = "h") -> DataFrame:
    """Sums of gradient and hessian and the count per (node, feature, bin).

    ``feature`` is the position in ``bins``. The exploded rows are combined inside each task before
    anything is shuffled, so the shuffle carries at most nodes x features x bins rows per task.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(b).cast("int").alias("bin")) for i, b in enumerate(bins)])
    long = df.select(F.col(node).alias("node"), F.col(g).alias("g"), F.col(h).alias("h"), F.inline(cells))
    return long.groupBy("node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")
    )


def leaf_weight(g: float, h: float, p: Params) -> float:
    t = max(abs(g) - p.alpha, 0.0) * (1 if g > 0 else -1)
    return -t / (h + p.reg_lambda) if h + p.reg_lambda > 0 else 0.0


def _score(g: str, h: str, p: Params) -> str:
    """SQL for the squared, L1-shrunk gradient over the regularised hessian."""
    a = float(p.alpha)
    t = f"CASE WHEN {g} > {a}D THEN {g} - {a}D WHEN {g} < -{a}D THEN {g} + {a}D ELSE 0D END" if a else g
    return f"(({t}) * ({t}) / nullif({h} + {float(p.reg_lambda)}D, 0D))"


def best_splits(
    hist: DataFrame,
    params: Params | dict | None = None,
    categorical: dict[int, str] | None = None,
    scale: tuple[float, float] = (1.0, 1.0),
    keys: Sequence[str] = ("node",),
    digits: int | None = None,
) -> DataFrame:
    """The best valid split of each node, with both directions of missing values tried.

    Input: ``*keys, [target,] feature, bin, g, h, n`` with bin -1 for missing; ``g`` and ``h`` may be integers, to
    be divided by ``scale``. A numeric split sends bins <= ``bin`` left. ``categorical`` maps a feature to
    ``onehot`` (one category against the rest) or ``partition`` (categories in the order of their leaf
    weight, at most ``max_cat_threshold`` of them on the smaller side; the left set is gathered for the winning
    split alone). A node without a valid split is absent.

    Ties go to the smaller feature, the smaller bin, then missing to the right. With sums in floating point,
    ``digits`` rounds gains so that ties do not depend on the order of addition. Windows hold one
    feature of one node: at most ``max_bin + 1`` rows.
    """
    p = Params.of(params)
    kinds = categorical or {}
    joint = "target" in hist.columns and p.multi_strategy == "multi_output_tree"
    key = ", ".join(keys)
    target = "target" if "target" in hist.columns else "0"
    at = f"{key}, feature, target"
    sg, sh = (f"{float(x)!r}D" for x in scale)
    lam = f"{float(p.reg_lambda)}D"

    def among(kind: str) -> str:
        return f"feature IN ({', '.join(str(f) for f, k in kinds.items() if k == kind) or 'NULL'})"

    if kinds:
        ratio = f"g / {sg} / nullif(h / {sh} + {lam}, 0D)"
        rank_key = (
            f"CASE WHEN bin = {MISSING} THEN double('-Infinity') WHEN {among('partition')} THEN {ratio} ELSE double(bin) END"
        )
        lg, lh = (f"CASE WHEN {among('onehot')} THEN {c} ELSE u{c} - m{c} END" for c in "gh")
        present = f"nullif(bin, {MISSING})"
        gathered = f"CASE WHEN {among('onehot')} THEN array(bin) END"
        position, n_bins = f"count({present}) OVER upto", f"count({present}) OVER every"
        small = f"least(position, n_bins - position) <= {p.max_cat_threshold}"
        bounded = f"coalesce(NOT ({among('partition')}), TRUE) OR {small}"
    else:
        rank_key, lg, lh = "bin", "ug - mg", "uh - mh"
        gathered, position, n_bins, bounded = "CAST(NULL AS ARRAY<INT>)", "0", "0", "TRUE"

    gain = f"""{_score(f"(left_g / {sg})", f"(left_h / {sh})", p)} + {_score(f"((tg - left_g) / {sg})", f"((th - left_h) / {sh})", p)}
        - {_score(f"(tg / {sg})", f"(th / {sh})", p)}"""
    sums = "struct(target, left_g, left_h, tg - left_g AS right_g, th - left_h AS right_h)"
    shown = "gain" if digits is None else f"round(gain, {digits})"
    if joint:
        # with several targets in one tree a split is one decision: gains add up, hessians are averaged
        merged = f"""SELECT {key}, feature, bin, default_left, position, n_bins, any_value(categories) AS categories,
            sum({gain}) AS gain, avg(left_h / {sh}) AS left_weight, avg((th - left_h) / {sh}) AS right_weight,
            sort_array(collect_list({sums})) AS sums
          FROM sides GROUP BY {key}, feature, bin, default_left, position, n_bins"""
    else:
        merged = f"""SELECT {key}, feature, bin, default_left, position, n_bins, categories, {gain} AS gain,
            left_h / {sh} AS left_weight, (th - left_h) / {sh} AS right_weight, array({sums}) AS sums FROM sides"""
    best = hist.sparkSession.sql(
        f"""
        WITH ranked AS (
          SELECT {key}, {target} AS target, feature, bin, g, h, {rank_key} AS rank_key FROM {{hist}}),
        -- missing sorts first, so one sort by rank serves the running sums and the totals
        cumulated AS (
          SELECT *, sum(g) OVER upto AS ug, sum(h) OVER upto AS uh, {gathered} AS categories, {position} AS position
          FROM ranked
          WINDOW upto AS (PARTITION BY {at} ORDER BY rank_key, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        totals AS (
          SELECT *, sum(g) OVER every AS tg, sum(h) OVER every AS th,
            sum(if(bin = {MISSING}, g, 0)) OVER every AS mg, sum(if(bin = {MISSING}, h, 0)) OVER every AS mh,
            {n_bins} AS n_bins
          FROM cumulated WINDOW every AS (PARTITION BY {at})),
        lefts AS (
          SELECT {at}, bin, tg, th, mg, mh, n_bins, position, categories, {lg} AS lg, {lh} AS lh
          FROM totals WHERE bin <> {MISSING}),
        sides AS (
          SELECT {at}, bin, tg, th, n_bins, position, categories, inline(array(
            struct(FALSE AS default_left, lg AS left_g, lh AS left_h),
            struct(TRUE AS default_left, lg + mg AS left_g, lh + mh AS left_h))) FROM lefts),
        merged AS ({merged}),
        valid AS (
          SELECT *, {shown} AS shown FROM merged
          WHERE left_weight >= {float(p.min_child_weight)}D AND right_weight >= {float(p.min_child_weight)}D
            AND ({bounded}) AND gain > {max(float(p.gamma), MIN_GAIN)}D)
        SELECT {key}, best.* FROM (
          SELECT {key}, max_by(struct(feature, bin, default_left, shown AS gain, categories, sums, position),
            struct(shown, -feature, -bin, int(NOT default_left))) AS best FROM valid GROUP BY {key})
        """,
        hist=hist,
    )
    if "partition" not in kinds.values():
        return best.drop("position")
    # only the split that won needs its categories: those ranked up to its position, by the first target
    ranked = hist.sparkSession.sql(
        f"""
        SELECT {key}, feature, bin, row_number() OVER (PARTITION BY {key}, feature ORDER BY ratio, bin) AS position FROM (
          SELECT {key}, feature, bin, {ratio} AS ratio, min({target}) OVER (PARTITION BY {key}, feature) AS first, {target} AS target
          FROM {{hist}} WHERE {among("partition")} AND bin <> {MISSING}) WHERE target = first
        """,
        hist=hist,
    ).withColumnsRenamed({"feature": "__feature", "bin": "__bin", "position": "__position"})
    chosen = best.join(ranked, list(keys)).where((F.col("feature") == F.col("__feature")) & (F.col("__position") <= F.col("position")))
    sets = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__position", "__bin"))).alias("__set"))
    sets = sets.select(*keys, F.transform("__set", lambda s: s["__bin"]).alias("__set"))
    out = best.join(sets, list(keys), "left")
    return out.withColumn("categories", F.coalesce("categories", "__set")).drop("__set", "position")


def sample_key(round_: int, tree: int, seed: int) -> int:
    """The key of one tree's row sample, below 2**40."""
    return ((seed % 65536) * 65536 + round_ % 65536) * 256 + tree % 256


def subsample_keep(row_id: Column, round_: int, tree: int, rate: float, seed: int) -> Column:
    """Whether a row takes part in a tree: integer mixing of the row id and the tree's key, so the same on any cluster and
    in SQL (``subsample_keep_sql``)."""
    return mix.sample_draw(row_id, sample_key(round_, tree, seed)) < F.lit(int(rate * mix.MODULUS))


def subsample_kept(row_id: np.ndarray, round_: int, tree: int, rate: float, seed: int) -> np.ndarray:
    """``subsample_keep`` of an array of row ids."""
    return mix.sample_draw(mix.Whole(row_id), sample_key(round_, tree, seed)).values < int(rate * mix.MODULUS)


def subsample_keep_sql(row_id: str, round_: int, tree: int, rate: float, seed: int) -> str:
    """``subsample_keep`` as an SQL predicate on the integer expression ``row_id``."""
    return f"({mix.sample_draw(mix.Sql(row_id), sample_key(round_, tree, seed))} < {int(rate * mix.MODULUS)})"
