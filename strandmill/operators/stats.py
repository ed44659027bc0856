"""Contingency and rank statistics with control of the false discovery rate.

Counts, ranks and sums are Spark aggregates and windows. Tail probabilities of a test are
computed by Arrow UDFs over one row per test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandmill.functions.scalar import haldane_log2_or
from strandmill.operators.scan import quantiles, within

#: Below this a cell or an arm is described, not tested.
LEAST = 5


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the probability of all tables with the margins that are no likelier than this one."""
    row, col, n = a + b, a + c, a + b + c + d
    if not row or not col or row == n or col == n:
        return 1.0
    lg = math.lgamma
    fixed = lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1)
    log = lambda k: fixed - lg(k + 1) - lg(row - k + 1) - lg(col - k + 1) - lg(n - row - col + k + 1)
    lo, hi = max(0, row + col - n), min(row, col)
    bound = log(a) + 1e-7
    # unimodal: walk outwards from the mode until terms no longer count
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))
    total = 0.0
    for step, k in ((-1, mode), (1, mode + 1)):
        while lo <= k <= hi:
            x = log(k)
            if x <= bound:
                total += math.exp(x)
                if x < bound - 60:
                    break
            k += step
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact test of (a, b) against (c, d); null with any null or negative cell."""
    return pd.Series([None if any(pd.isna(x) or x < 0 for x in t) else _fisher(*map(int, t)) for t in zip(a, b, c, d)], dtype="float64")


def compare_binary(df: DataFrame, a_pos: str, a_tot: str, b_pos: str, b_tot: str) -> DataFrame:
    """``df`` with rates, log2_or (null where an arm has no carrier), p_value and descriptive_only."""
    a, c = F.col(a_pos), F.col(b_pos)
    b, d = F.col(a_tot) - a, F.col(b_tot) - c
    return df.withColumns(
        {
            "rate_group": F.try_divide(a, F.col(a_tot)),
            "rate_ref": F.try_divide(c, F.col(b_tot)),
            "log2_or": haldane_log2_or(a, b, c, d),
            "p_value": fisher_p(a, b, c, d),
            "descriptive_only": F.least(a, b, c, d) < LEAST,
        }
    )


def one_vs_rest(df: DataFrame, group: str, value: str, weight: Column | None = None, report_values: list | None = None) -> DataFrame:
    """Counts of every group and value, zero cells included, against all other groups: n_pos_group, n_tot_group, n_pos_ref, n_tot_ref.

    ``report_values`` names the values that are given, also where none occurs: one side of a feature
    with two values, say. Totals are over all values. ``weight`` counts rows by a whole number."""
    w = weight if weight is not None else F.lit(1)
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = known.groupBy(group, value).agg(F.sum(w).alias("n"))
    by_group, by_value, all_ = counts.groupBy(group).agg(F.sum("n").alias("n_tot_group")), counts.groupBy(value).agg(F.sum("n").alias("n_value")), counts.agg(F.sum("n").alias("n_all"))
    if report_values is not None:
        asked = df.sparkSession.createDataFrame([(v,) for v in report_values], f"`{value}` {df.schema[value].dataType.simpleString()}")
        by_value = F.broadcast(asked).join(by_value, value, "left").select(value, F.coalesce("n_value", F.lit(0)).alias("n_value"))
    # groups and values are vocabularies, and a row for each of their pairs is what is asked for
    cells = by_group.join(by_value, how="cross").join(F.broadcast(all_), how="cross").join(counts, [group, value], "left")
    n = F.coalesce("n", F.lit(0))
    return cells.select(group, value, n.alias("n_pos_group"), "n_tot_group", (F.col("n_value") - n).alias("n_pos_ref"), (F.col("n_all") - F.col("n_tot_group")).alias("n_tot_ref"))


def against_reference(df: DataFrame, group: str, carrier: Column, is_reference: Column) -> DataFrame:
    """Carriers of each group against the rows of a fixed reference."""
    ref = df.agg(F.count_if(carrier & is_reference).alias("n_pos_ref"), F.count_if(is_reference).alias("n_tot_ref"))
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_if(carrier).alias("n_pos_group"), F.count(F.lit(1)).alias("n_tot_group"))
    return per.join(F.broadcast(ref), how="cross")  # one row


def against_reference_by(df: DataFrame, block: str, group: str, carrier: Column, is_reference: Column) -> DataFrame:
    """The same within each block; groups without rows in a block have none."""
    ref = df.groupBy(block).agg(F.count_if(carrier & is_reference).alias("n_pos_ref"), F.count_if(is_reference).alias("n_tot_ref"))
    per = df.where(F.col(group).isNotNull()).groupBy(block, group).agg(F.count_if(carrier).alias("n_pos_group"), F.count(F.lit(1)).alias("n_tot_group"))
    return per.join(ref, block)


def length_bins(df: DataFrame, length: str, is_reference: Column, parts: int = 5) -> DataFrame:
    """``df`` with ``length_bin``: which quantile of the reference's lengths a row falls in, null outside their range. Bins are right-closed, the first on both sides."""
    cuts = [i / parts for i in range(parts + 1)]
    found = quantiles(df.where(is_reference), [], [length], cuts).first()
    edges = sorted(set(found["quantiles"])) if found else []
    x, at = F.col(length), F.lit(0)
    for e in edges:
        at = at + (x > F.lit(e)).cast("int")
    inside = (x >= edges[0]) & (x <= edges[-1]) if edges else F.lit(False)
    return df.withColumn("length_bin", F.when(inside, F.greatest(at, F.lit(1))))


def average_ranks(df: DataFrame, blocks: list[str], value: str) -> DataFrame:
    """``df`` with ``rank`` (ties share their mean) and ``ties`` within each block; null values have none.

    Ties are counted by value first, so that ranks need a running sum over different values only."""
    by = df.where(F.col(value).isNotNull()).groupBy(*blocks, value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = within(by, blocks, [value], __upto=("sum", F.col("ties"))).withColumn("rank", F.col("__upto") - F.col("ties") + (F.col("ties") + 1) / 2)
    return df.join(ranked.drop("__upto"), [*blocks, value], "left")


def _mann_whitney(n1: float, n2: float, u: float, tie_sum: float) -> float:
    """Two-sided p: exact for small samples without ties, else normal with continuity and tie corrections."""
    n1, n2 = int(n1), int(n2)
    if tie_sum == 0 and min(n1, n2) <= 8:
        ways = [1] + [0] * (n1 * n2)
        # Gaussian binomial coefficients, one factor at a time
        for i in range(1, n1 + 1):
            for k in range(len(ways) - 1, n2 + i - 1, -1):
                ways[k] -= ways[k - n2 - i]
            for k in range(i, len(ways)):
                ways[k] += ways[k - i]
        big = int(max(u, n1 * n2 - u))
        return min(1.0, 2 * sum(ways[big:]) / math.comb(n1 + n2, n1))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1))))
    if not sd:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    return min(1.0, math.erfc(z / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def mann_whitney_p(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(w) or a < 2 or b < 2 else _mann_whitney(a, b, w, t) for a, b, w, t in zip(n1, n2, u, ties)], dtype="float64")


def compare_continuous(df: DataFrame, blocks: list[str], value: str, in_group: Column, in_reference: Column) -> DataFrame:
    """Per block: n, median, mean and sd of both arms, u, cliffs_delta, p_value, descriptive_only.

    delta = 2u / (n1 n2) - 1; both it and p are null with fewer than two values in an arm."""
    arm = F.when(in_group, 1).when(in_reference, 0)
    ranked = average_ranks(df.where(F.col(value).isNotNull()).withColumn("__arm", arm).where("__arm IS NOT NULL"), blocks, value)
    g, r = F.col("__arm") == 1, F.col("__arm") == 0
    stat = lambda f, cond: f(F.when(cond, F.col(value)))
    n1, n2 = F.count_if(g), F.count_if(r)
    per = ranked.groupBy(*blocks).agg(
        n1.alias("n_group"),
        n2.alias("n_ref"),
        *(stat(f, c).alias(f"{n}_{a}") for n, f in (("median", F.median), ("mean", F.avg), ("sd", F.stddev_samp)) for a, c in (("group", g), ("ref", r))),
        (F.sum(F.when(g, F.col("rank"))) - n1 * (n1 + 1) / 2).alias("u"),
        # each of t tied values brings t*t - 1; together t**3 - t
        F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("__ties"),
    )
    enough = (F.col("n_group") >= 2) & (F.col("n_ref") >= 2)
    return per.withColumns(
        {
            "cliffs_delta": F.when(enough, 2 * F.col("u") / (F.col("n_group").cast("double") * F.col("n_ref")) - 1),
            "p_value": mann_whitney_p("n_group", "n_ref", "u", "__ties"),
            "descriptive_only": F.least("n_group", "n_ref") < LEAST,
        }
    ).drop("__ties")


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two labels, in bits."""
    t = crosstab(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    return t.agg(F.sum(F.col("n") / F.col("n_all") * F.col("log2_oe")).alias("bits"))


def _chi2_sf(x: float, k: int) -> float:
    """Survival function of the chi-square distribution."""
    if x <= 0:
        return 1.0
    a, y = k / 2, x / 2
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-y + a * math.log(y) - math.lgamma(a)) * h


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or n < 1 else _chi2_sf(float(v), int(n)) for v, n in zip(x, k)], dtype="float64")


def kruskal(df: DataFrame, blocks: list[str], value: str, group: str) -> DataFrame:
    """Per block: h with the correction for ties, n, n_groups and epsilon_squared."""
    ranked = average_ranks(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), blocks, value)
    per = ranked.groupBy(*blocks, group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m"), F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("t"))
    n = F.col("n").cast("double")
    got = per.groupBy(*blocks).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum("t").alias("t"))
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("t") / (n * n * n - n))
    return got.select(*blocks, "n", "n_groups", h.alias("h")).withColumn("epsilon_squared", F.try_divide(F.col("h"), F.col("n") - 1))


def benjamini_hochberg(df: DataFrame, blocks: list[str], p: str = "p_value", out: str = "p_fdr") -> DataFrame:
    """``df`` with adjusted p values within each block; null p values take no part and stay null."""
    part = W.partitionBy(*blocks)
    known = F.col(p).isNotNull()
    rank = F.row_number().over(part.orderBy(F.col(p).asc_nulls_last()))
    ranked = df.withColumns({"__r": rank, "__m": F.count(p).over(part)})
    down = part.orderBy(F.col("__r").desc()).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min(F.when(known, F.col(p) * F.col("__m") / F.col("__r"))).over(down)))).drop("__r", "__m")


def mean_enrichment(df: DataFrame, group: str, counts: dict[str, Column], length: Column, pseudo: float = 1e-6) -> DataFrame:
    """Per group and item: the mean of the rows' shares (count over length), the pooled share of all rows, and log2 of the one over
    the other with a small constant added to both. Rows without length take no part."""
    rows = df.where(length > 0)
    per = rows.where(F.col(group).isNotNull()).groupBy(group).agg(*(F.avg(c / length).alias(k) for k, c in counts.items())).unpivot([group], list(counts), "item", "mean")
    pooled = rows.agg(*((F.sum(c) / F.sum(length)).alias(k) for k, c in counts.items())).unpivot([], list(counts), "item", "pooled")
    return per.join(F.broadcast(pooled), "item").withColumn("log2_enrichment", F.log2((F.col("mean") + pseudo) / (F.col("pooled") + pseudo)))  # a row per item


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long: n, its shares of row, column and all, the expected count and log2 observed over expected."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("n_all"))
    r, c = F.sum("n").over(W.partitionBy(row)), F.sum("n").over(W.partitionBy(column))
    out = n.withColumns({"n_row": r, "n_column": c}).join(F.broadcast(total), how="cross")
    expected = F.col("n_row") * F.col("n_column") / F.col("n_all")
    return out.withColumns({"row_share": F.col("n") / F.col("n_row"), "column_share": F.col("n") / F.col("n_column"), "expected": expected, "log2_oe": F.log2(F.col("n") / expected)})


def fold_enrichment(df: DataFrame, block: str, inner: str, cls: str) -> DataFrame:
    """Share of a class among a block's inner groups over its share in the block."""
    n = df.where(F.col(cls).isNotNull()).groupBy(block, inner, cls).agg(F.count(F.lit(1)).alias("observed_n"))
    w = lambda *by: F.sum("observed_n").over(W.partitionBy(*by))
    out = n.withColumns({"class_n": w(block, inner), "superclass_n": w(block, cls), "method_n": w(block)})
    fold = (F.col("observed_n") / F.col("class_n")) / (F.col("superclass_n") / F.col("method_n"))
    return out.withColumns({"fold": fold, "log2_fold": F.log2(fold)})


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, of two labellings of the same rows."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda x: x.cast("double") * (x - 1) / 2
    rows = n.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("ra"))
    cols = n.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rb"))
    both = n.agg(F.sum(two(F.col("n"))).alias("rab"), two(F.sum("n")).alias("all"))
    expected = F.col("ra") * F.col("rb") / F.col("all")
    return both.join(F.broadcast(rows), how="cross").join(F.broadcast(cols), how="cross").select(((F.col("rab") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected)).alias("ari"))


def odds_ratio_interval(a: Column, b: Column, c: Column, d: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """log odds ratio with halves added, and the ends of its interval."""
    h = [x + 0.5 for x in (a, b, c, d)]
    lo = F.ln(h[0] * h[3] / (h[1] * h[2]))
    se = F.sqrt(sum((1 / x for x in h[1:]), 1 / h[0]))
    return lo, lo - z * se, lo + z * se
