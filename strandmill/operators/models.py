"""Matched subsets, logistic regression as aggregates, and permutation importance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.scan import within
from strandmill.operators.stats import length_bins


def _shuffled(seed: str, key: str) -> Column:
    """A seeded order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def matched_subset(df: DataFrame, key: str, is_case: Column, length: str, parts: int = 5, ratio: int = 1, seed: str = "match") -> DataFrame:
    """The cases, and of the others a seeded sample without replacement with ``ratio`` times as many rows in each quantile bin of
    the cases' lengths, or all where a bin has fewer; with ``is_case`` and ``length_bin``. Rows outside the cases' range are left out."""
    rows = df.withColumn("is_case", F.coalesce(is_case, F.lit(False)))
    binned = length_bins(rows, length, F.col("is_case"), parts).where("length_bin IS NOT NULL")
    quotas = binned.where("is_case").groupBy("length_bin").agg((F.count(F.lit(1)) * ratio).alias("__quota"))
    ranked = within(binned.where("NOT is_case").withColumn("__seeded", _shuffled(seed, key)), ["length_bin"], ["__seeded", key], "__place")
    kept = ranked.join(F.broadcast(quotas), "length_bin").where("__place <= __quota")  # parts rows
    columns = [*df.columns, "is_case", "length_bin"]
    return binned.where("is_case").select(*columns).unionByName(kept.select(*columns))


def _probability(xs: list[Column], beta: np.ndarray) -> Column:
    eta = F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:]):
        eta = eta + x * F.lit(float(b))
    return 1 / (1 + F.exp(-eta))


def logistic(df: DataFrame, y: str, xs: list[str], rounds: int = 50, tolerance: float = 1e-10) -> list[dict]:
    """Logistic regression of a 0/1 column by reweighted least squares: per term (intercept first) coefficient, standard error, odds ratio.

    Each round is one aggregate of the normal equations, terms squared sums, so that rows stay where
    they are. Columns are centred and scaled within. Rows with a null take no part. Raises where
    a column does not vary or the rounds do not converge, as with separable classes."""
    rows = df.select(F.col(y).cast("double").alias(y), *(F.col(x).cast("double").alias(x) for x in xs)).dropna()
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("y"), *(z for x in xs for z in (F.avg(x).alias(f"m_{x}"), F.stddev_pop(x).alias(f"s_{x}")))).first()
    if not first["n"] or not 0 < first["y"] < 1:
        raise ValueError(f"{y} does not vary")
    mean, sd = np.array([first[f"m_{x}"] for x in xs]), np.array([first[f"s_{x}"] for x in xs])
    if not (sd > 0).all():
        raise ValueError(f"{[x for x, s in zip(xs, sd) if not s > 0]} do not vary")
    zs = [(F.col(x) - F.lit(float(m))) / F.lit(float(s)) for x, m, s in zip(xs, mean, sd)]
    p = len(xs) + 1
    design = [F.lit(1.0), *zs]
    beta = np.zeros(p)
    beta[0] = np.log(first["y"] / (1 - first["y"]))
    for _ in range(rounds):
        prob = _probability(zs, beta)
        w, r = prob * (1 - prob), F.col(y) - prob
        got = rows.agg(*(F.sum(w * design[i] * design[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(r * design[i]).alias(f"g{i}") for i in range(p))).first()
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        step = np.linalg.solve(h, np.array([got[f"g{i}"] for i in range(p)]))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
        if np.abs(beta).max() > 1e3:
            raise ValueError("the classes are separable: no finite coefficients")
    else:
        raise ValueError(f"no convergence within {rounds} rounds")
    # back to the columns as they are
    back = np.eye(p)
    back[1:, 1:] = np.diag(1 / sd)
    back[0, 1:] = -mean / sd
    raw, error = back @ beta, np.sqrt(np.diag(back @ np.linalg.inv(h) @ back.T))
    return [{"term": t, "coefficient": float(b), "standard_error": float(e), "odds_ratio": float(np.exp(b))} for t, b, e in zip(["intercept", *xs], raw, error)]


def permuted(df: DataFrame, key: str, column: str, seed: str = "permute") -> DataFrame:
    """``df`` with the values of a column dealt anew: the n-th row by key gets the value of the n-th row in a seeded order."""
    place, dealt = within(df, [], [key], "__place"), within(df.select(key, column, _shuffled(seed, key).alias("__seeded")), [], ["__seeded", key], "__place")
    return place.drop(column).join(dealt.select("__place", column), "__place").select(*df.columns)


def log_loss(df: DataFrame, y: str, terms: list[dict]) -> float:
    """The mean negative log likelihood of a 0/1 column under a fitted model."""
    beta = np.array([t["coefficient"] for t in terms])
    p = _probability([F.col(t["term"]) for t in terms[1:]], beta)
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(F.when(F.col(y) == 1, -F.ln(p)).otherwise(-F.ln(1 - p)))).first()[0]


def permutation_importance(df: DataFrame, key: str, y: str, terms: list[dict], seed: str = "permute") -> dict[str, float]:
    """By term of a fitted model: how much its log loss grows when the term's column is permuted."""
    rows = df.dropna(subset=[y, *(t["term"] for t in terms[1:])])
    base = log_loss(rows, y, terms)
    return {t["term"]: log_loss(permuted(rows, key, t["term"], f"{seed}:{t['term']}"), y, terms) - base for t in terms[1:]}
