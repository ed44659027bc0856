"""Rank contrasts of many groups and metrics at once, from counts of equal values.

Rows are reduced to how often a value occurs in a group; ranks are running sums over a metric's
different values in sorted ranges, so that a metric with all rows of the table is the work of
all tasks. The reference, or the rest, is counted once and met by value: its rows are not
repeated for each group. Medians are read off the running counts of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.scan import within
from strandmill.operators.stats import LEAST, chi2_p, compare_binary, mann_whitney_p
from strandmill.operators.storage import stored


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet; the keys stay once."""
    renamed = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    return a.join(renamed, on, how).drop(*(f"__b_{k}" for k in keys))


def medians(counts: DataFrame, keys: list[str], value: str, n: str, name: str = "median") -> DataFrame:
    """The median of each key's values, from (keys, value, n): the mean of the middle two where n is even."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("__total"))
    placed = _same(within(counts.select(*keys, value, n), keys, [value], __upto=("sum", F.col(n))), totals, keys)
    low = F.min(F.when(F.col("__upto") >= F.floor((F.col("__total") + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("__upto") >= F.floor(F.col("__total") / 2) + 1, F.col(value)))
    return placed.groupBy(*keys).agg(((low + high) / 2).alias(name))


def _moments(counts: DataFrame, keys: list[str], value: str, n: str, suffix: str = "") -> DataFrame:
    """n, mean and sd of each key's values, from counts of equal values; deviations are from the mean."""
    v, k = F.col(value), F.col(n)
    means = counts.groupBy(*keys).agg(F.sum(k).alias("__n"), (F.sum(v * k) / F.sum(k)).alias("__mean"))
    per = _same(counts, means, keys).groupBy(*keys).agg(F.max("__n").alias(f"n{suffix}"), F.max("__mean").alias(f"mean{suffix}"), F.sum(k * (v - F.col("__mean")) * (v - F.col("__mean"))).alias("__squares"))
    return per.withColumn(f"sd{suffix}", F.when(F.col(f"n{suffix}") > 1, F.sqrt(F.col("__squares") / (F.col(f"n{suffix}") - 1)))).drop("__squares")


def _cube(n: Column) -> Column:
    x = n.cast("double")
    return x * x * x - x


def with_reference(long: DataFrame, blocks: list[str], group: str, value: str, is_reference: Column) -> DataFrame:
    """Per block and group with values: n, median, mean and sd of the group and of the block's reference rows,
    u, cliffs_delta, p_value, descriptive_only; as ``stats.compare_continuous`` gives for one pair.

    A row may be of a group and of the reference. Null values and groups take no part; a block
    without reference rows has n_ref 0 and no test."""
    rows = long.where(F.col(value).isNotNull()).select(*blocks, group, F.col(value).cast("double").alias("__v"), F.coalesce(is_reference, F.lit(False)).alias("__ref"))
    counts = stored(rows.groupBy(*blocks, group, "__ref", "__v").agg(F.count(F.lit(1)).alias("__n")), "counts")
    own = counts.where(F.col(group).isNotNull()).groupBy(*blocks, group, "__v").agg(F.sum("__n").alias("__g"))
    ref = counts.groupBy(*blocks, "__v").agg(F.coalesce(F.sum(F.when(F.col("__ref"), F.col("__n"))), F.lit(0)).alias("__r"))
    ranked = within(ref, blocks, ["__v"], __upto=("sum", F.col("__r")))
    g, r = F.col("__g"), F.col("__r")
    met = _same(own, ranked, [*blocks, "__v"]).groupBy(*blocks, group).agg(F.sum(g * (F.col("__upto") - r + r / 2)).alias("u"), F.sum(_cube(g + r) - _cube(r)).alias("__ties"))
    there = ref.where("__r > 0")
    ties = ref.groupBy(*blocks).agg(F.sum(_cube(r)).alias("__ref_ties"))
    found = _same(met, _moments(own, [*blocks, group], "__v", "__g", "_group"), [*blocks, group])
    found = _same(found, medians(own, [*blocks, group], "__v", "__g", "median_group"), [*blocks, group])
    for table in (_moments(there, blocks, "__v", "__r", "_ref"), medians(there, blocks, "__v", "__r", "median_ref"), ties):
        found = _same(found, table, blocks, "left")
    n_ref = F.coalesce("n_ref", F.lit(0))
    enough = (F.col("n_group") >= 2) & (n_ref >= 2)
    return found.withColumn("n_ref", n_ref).select(
        *blocks,
        group,
        *(f"{s}_{a}" for s in ("n", "median", "mean", "sd") for a in ("group", "ref")),
        F.when(F.col("n_ref") > 0, F.col("u")).alias("u"),
        F.when(enough, 2 * F.col("u") / (F.col("n_group").cast("double") * F.col("n_ref")) - 1).alias("cliffs_delta"),
        mann_whitney_p("n_group", "n_ref", "u", F.col("__ties") + F.col("__ref_ties")).alias("p_value"),
        (F.least("n_group", "n_ref") < LEAST).alias("descriptive_only"),
    )


def of_metrics(df: DataFrame, group: str, is_reference: Column, metrics: list[str]) -> DataFrame:
    """``with_reference`` of every metric, a column of doubles: a row per (metric, group)."""
    wide = df.select(group, F.coalesce(is_reference, F.lit(False)).alias("__ref"), *(F.col(m).cast("double").alias(m) for m in metrics))
    return with_reference(wide.unpivot([group, "__ref"], metrics, "metric", "__value"), ["metric"], group, "__value", F.col("__ref"))


def with_rest(long: DataFrame, blocks: list[str], group: str, value: str) -> DataFrame:
    """Per block and group: n, median, mean, sd, delta_vs_rest (of the group against the block's other groups), and the
    block's omnibus_h and omnibus_p over its groups of two values or more, null with fewer than two such groups."""
    rows = long.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*blocks, group, F.col(value).cast("double").alias("__v"))
    own = stored(rows.groupBy(*blocks, group, "__v").agg(F.count(F.lit(1)).alias("__g")), "counts")
    sizes = own.groupBy(*blocks, group).agg(F.sum("__g").alias("n"))
    counted = _same(own, sizes, [*blocks, group])
    # the omnibus test leaves out groups of one value, the contrasts do not
    every = counted.groupBy(*blocks, "__v").agg(F.sum("__g").alias("__a"), F.sum(F.when(F.col("n") >= 2, F.col("__g")).otherwise(0)).alias("__b"))
    ranked = within(every, blocks, ["__v"], __upto=("sum", F.col("__a")), __upto_b=("sum", F.col("__b")))
    g, a, b = F.col("__g"), F.col("__a"), F.col("__b")
    sums = _same(own, ranked, [*blocks, "__v"]).groupBy(*blocks, group).agg(F.sum(g * (F.col("__upto") - a + (a + 1) / 2)).alias("__r"), F.sum(g * (F.col("__upto_b") - b + (b + 1) / 2)).alias("__rb"))
    per = _same(_same(_moments(own, [*blocks, group], "__v", "__g"), medians(own, [*blocks, group], "__v", "__g"), [*blocks, group]), sums, [*blocks, group])
    large = F.col("n") >= 2
    totals = per.groupBy(*blocks).agg(
        F.sum("n").alias("__all"),
        F.sum(F.when(large, F.col("n"))).cast("double").alias("__m"),
        F.count_if(large).alias("__groups"),
        F.sum(F.when(large, F.col("__rb") * F.col("__rb") / F.col("n"))).alias("__s"),
    )
    totals = _same(totals, every.groupBy(*blocks).agg(F.sum(_cube(b)).alias("__ties")), blocks)
    m = F.col("__m")
    h = F.when(F.col("__groups") >= 2, F.try_divide(12 / (m * (m + 1)) * F.col("__s") - 3 * (m + 1), 1 - F.try_divide(F.col("__ties"), m * m * m - m)))
    n, rest = F.col("n"), F.col("__all") - F.col("n")
    delta = F.when((n >= 2) & (rest >= 2), 2 * (F.col("__r") - n * (n + 1) / 2) / (n.cast("double") * rest) - 1)
    out = _same(per, totals, blocks).withColumn("omnibus_h", h)
    return out.select(*blocks, group, "n", "median", "mean", "sd", delta.alias("delta_vs_rest"), "omnibus_h", chi2_p(F.col("omnibus_h"), F.col("__groups") - 1).alias("omnibus_p"), (n < LEAST).alias("descriptive_only"))


def label_counts(entities: DataFrame, items: DataFrame, key: str, group: str, label: str, is_reference: Column) -> DataFrame:
    """Carriers of each label in each group against all reference entities: n_pos_group, n_tot_group, n_pos_ref, n_tot_ref.

    Labels are counted where they are; entities without one are the complement. Every label met
    among the entities' items is given with every group, also where the group has no carrier."""
    known = entities.select(key, group, F.coalesce(is_reference, F.lit(False)).alias("__ref"))
    carriers = items.where(F.col(label).isNotNull()).select(key, label).distinct().join(known, key)
    pos = carriers.where(F.col(group).isNotNull()).groupBy(label, group).agg(F.count(F.lit(1)).alias("n_pos_group"))
    ref = carriers.groupBy(label).agg(F.count_if("__ref").alias("n_pos_ref"))
    total = known.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_tot_group"))
    n_ref = known.agg(F.count_if("__ref").alias("n_tot_ref"))
    # labels and groups are vocabularies, and a row for each of their pairs is what is asked for
    cells = ref.join(total, how="cross").join(F.broadcast(n_ref), how="cross").join(pos, [label, group], "left")
    return cells.select(label, group, F.coalesce("n_pos_group", F.lit(0)).alias("n_pos_group"), "n_tot_group", "n_pos_ref", "n_tot_ref")


def label_block(entities: DataFrame, items: DataFrame, key: str, group: str, label: str, length: str, size: str, is_reference: Column) -> DataFrame:
    """Two measures of each label and group against the reference entities, in one table with a column ``measure``.

    ``carrier_rate``: Fisher's test of how many entities carry the label. ``occupancy_among_carriers``:
    the label's summed length over the entity's size, of carriers only; groups without carriers have no row."""
    rates = compare_binary(label_counts(entities, items, key, group, label, is_reference), "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref")
    summed = items.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.sum(length).alias("__sum"))
    known = entities.select(key, group, size, F.coalesce(is_reference, F.lit(False)).alias("__ref"))
    occupied = summed.join(known, key).withColumn("__v", F.try_divide(F.col("__sum"), F.col(size)))
    shares = with_reference(occupied, [label], group, "__v", F.col("__ref"))
    tagged = lambda df, name: df.withColumn("measure", F.lit(name))
    return tagged(rates, "carrier_rate").unionByName(tagged(shares, "occupancy_among_carriers"), allowMissingColumns=True)


def presence_vs_rest(entities: DataFrame, items: DataFrame, key: str, group: str, label: str) -> DataFrame:
    """Carriers of each label in each group against the entities of all other groups, with rates, odds ratio and p.

    Entities are counted once per group; those without a group take no part."""
    base = entities.where(F.col(group).isNotNull()).select(key, group).distinct()
    carriers = items.where(F.col(label).isNotNull()).select(key, label).distinct().join(base, key)
    pos = carriers.groupBy(label, group).agg(F.count(F.lit(1)).alias("n_pos_group"))
    by_label = pos.groupBy(label).agg(F.sum("n_pos_group").alias("__label"))
    total = base.groupBy(group).agg(F.count(F.lit(1)).alias("n_tot_group"))
    every = base.agg(F.count(F.lit(1)).alias("__all"))
    cells = by_label.join(total, how="cross").join(F.broadcast(every), how="cross").join(pos, [label, group], "left")
    own = F.coalesce("n_pos_group", F.lit(0))
    counts = cells.select(label, group, own.alias("n_pos_group"), "n_tot_group", (F.col("__label") - own).alias("n_pos_ref"), (F.col("__all") - F.col("n_tot_group")).alias("n_tot_ref"))
    return compare_binary(counts, "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref")


def label_fractions(items: DataFrame, keys: list[str], label: str, length: str, size: str, top: int = 8, other: str = "other") -> DataFrame:
    """Per entity (``keys`` name it with its group) and label: its summed length over the entity's size; all but the ``top`` commonest labels are one."""
    common = items.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), label).limit(top).select(F.col(label).alias("__label"))
    named = items.join(F.broadcast(common), F.col(label) == F.col("__label"), "left").withColumn(label, F.coalesce("__label", F.lit(other)))  # top rows
    summed = named.groupBy(*keys, size, label).agg(F.sum(length).alias("__sum"))
    return summed.select(*keys, label, F.try_divide(F.col("__sum"), F.col(size)).alias("fraction"))
