"""A whole training run as SQL: exact cuts, histograms, splits and leaf weights of every level, unrolled.

Only for one output and numeric features; the queries that use it train with ``exact_cuts``. Gradients are rounded to
integers and added exactly, as the trainer does, so that equal gains stay equal.
"""

from __future__ import annotations

from collections.abc import Sequence

UNIT = 2.0**30


def _bins(features: Sequence[str], max_bin: int) -> str:
    cells = " UNION ALL ".join(f"SELECT rid, is_valid, {k} AS f, CAST({c} AS DOUBLE) AS v FROM rows" for k, c in enumerate(features))
    return f"""
    cells AS MATERIALIZED ({cells}),
    counts AS (SELECT f, v, count(*) AS n FROM cells WHERE v IS NOT NULL AND NOT is_valid GROUP BY 1, 2),
    upto AS (SELECT f, v, n, sum(n) OVER (PARTITION BY f ORDER BY v) AS upto, sum(n) OVER (PARTITION BY f) AS total FROM counts),
    cuts AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS k FROM upto
      WHERE least(upto * {max_bin} // total, {max_bin - 1}) > (upto - n) * {max_bin} // total),
    bins AS MATERIALIZED (SELECT rid, c.f, CASE WHEN c.v IS NULL THEN -1 ELSE coalesce(k, 0) END AS bin
      FROM cells c ASOF LEFT JOIN cuts ON c.f = cuts.f AND c.v >= cuts.v)"""


def _level(name: str, before: str, grads: str, lam: float, keep: str = "TRUE") -> str:
    """Nodes of the next level: rows of a node with a valid split move to 2n or 2n + 1."""
    score = lambda g, h: f"(({g}) / {UNIT}e0) * (({g}) / {UNIT}e0) / (({h}) / {UNIT}e0 + {lam}e0)"
    return f"""
    {name}_h AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h FROM {before} JOIN {grads} USING (rid) JOIN bins USING (rid)
      WHERE NOT is_valid AND {keep} GROUP BY ALL),
    {name}_c AS (SELECT *, sum(g) OVER u AS ug, sum(h) OVER u AS uh, sum(g) OVER e AS tg, sum(h) OVER e AS th,
        coalesce(sum(g) FILTER (bin = -1) OVER e, 0) AS mg, coalesce(sum(h) FILTER (bin = -1) OVER e, 0) AS mh
      FROM {name}_h WINDOW u AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY node, f)),
    {name}_s AS (SELECT node, f, bin, lost_left, tg, th, ug - CASE WHEN lost_left THEN 0 ELSE mg END AS lg,
        uh - CASE WHEN lost_left THEN 0 ELSE mh END AS lh
      FROM {name}_c CROSS JOIN (VALUES (FALSE), (TRUE)) AS d(lost_left) WHERE bin <> -1),
    {name}_g AS (SELECT *, {score("lg", "lh")} + {score("tg - lg", "th - lh")} - {score("tg", "th")} AS gain FROM {name}_s
      WHERE lh / {UNIT}e0 >= 1 AND (th - lh) / {UNIT}e0 >= 1),
    {name}_b AS MATERIALIZED (SELECT node, f, bin, lost_left FROM {name}_g WHERE gain > 1e-6
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin, lost_left) = 1),
    {name} AS MATERIALIZED (SELECT r.rid, CASE WHEN s.node IS NULL THEN r.node
        ELSE 2 * r.node + CASE WHEN b.bin = -1 THEN (NOT s.lost_left)::INT ELSE (b.bin > s.bin)::INT END END AS node
      FROM {before} r LEFT JOIN {name}_b s ON r.node = s.node LEFT JOIN bins b ON b.rid = r.rid AND b.f = s.f)"""


def training_sql(
    rows: str, features: Sequence[str], params: dict, rounds: int, result: str, logistic: bool = False, keep=None
) -> str:
    """``result`` may read ``rows`` (rid, y, is_valid, features) and ``m0`` .. (rid, m), the margins before each round.

    ``keep(r)``, if given, is the SQL predicate on the columns of ``rows`` that selects the rows the tree of round r learns
    from (row sampling); all rows still pass through the tree and get its weights.
    """
    lam, eta, depth = params.get("reg_lambda", 1.0), params["eta"], params["max_depth"]
    mean = "CAST(printf('%.9g', avg(y)) AS DOUBLE)"
    base = f"ln({mean} / (1 - {mean}))" if logistic else mean
    parts = [f"rows AS MATERIALIZED ({rows})", _bins(features, params["max_bin"])]
    parts.append(f"m0 AS MATERIALIZED (SELECT rid, m FROM rows CROSS JOIN (SELECT {base} AS m FROM rows WHERE NOT is_valid))")
    for r in range(rounds):
        if logistic:
            p = "(1 / (1 + exp(-m)))"
            g, h = f"{p} - y", f"greatest({p} * (1 - {p}), 1e-16)"
        else:
            g, h = "m - y", "1e0"
        parts.append(
            f"g{r} AS MATERIALIZED (SELECT rid, is_valid, CAST(round(({g}) * {UNIT}e0) AS HUGEINT) AS g, CAST(round(({h}) * {UNIT}e0) AS HUGEINT) AS h "
            f"FROM rows JOIN m{r} USING (rid))"
        )
        parts.append(f"n{r}_0 AS (SELECT rid, 1 AS node FROM rows)")
        kept = "TRUE"
        if keep:
            parts.append(f"k{r} AS MATERIALIZED (SELECT rid FROM rows WHERE {keep(r)})")
            kept = f"rid IN (SELECT rid FROM k{r})"
        parts += [_level(f"n{r}_{d + 1}", f"n{r}_{d}", f"g{r}", lam, kept) for d in range(depth)]
        parts.append(
            f"w{r} AS (SELECT node, -{eta}e0 * (sum(g) / {UNIT}e0) / (sum(h) / {UNIT}e0 + {lam}e0) AS w FROM n{r}_{depth} JOIN g{r} USING (rid) "
            f"WHERE NOT is_valid AND {kept} GROUP BY node)"
        )
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT rid, m + w AS m FROM m{r} JOIN n{r}_{depth} USING (rid) JOIN w{r} USING (node))")
    return f"WITH {', '.join(parts)} {result}"


def evals_sql(rounds: int, logistic: bool = False) -> str:
    """Scores of both parts after each round."""
    if logistic:
        q = "least(greatest(1 / (1 + exp(-m)), 1e-16), 1 - 1e-16)"
        metric, score = "logloss", f"avg(-CASE WHEN y > 0 THEN ln({q}) ELSE ln(1 - {q}) END)"
    else:
        metric, score = "rmse", "sqrt(avg((m - y) * (m - y)))"
    return " UNION ALL ".join(
        f"SELECT CASE WHEN is_valid THEN 'valid' ELSE 'train' END AS dataset, '{metric}' AS metric, {r} AS round, round({score}, 6) AS score "
        f"FROM rows JOIN m{r + 1} USING (rid) GROUP BY is_valid"
        for r in range(rounds)
    )
