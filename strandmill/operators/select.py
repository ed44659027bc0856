"""Picking rows: best of a group, priority unions and lookups, joins with audits, ordered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a stated order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pick(df: DataFrame, keys: list[str], order: list[Column], *columns: str) -> DataFrame:
    """Like ``best``, for few columns: combined before the shuffle, without a sort. ``order`` must decide every tie."""
    got = F.min_by(F.struct(*columns), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(got.alias("__b")).select(*keys, *(F.col(f"__b.{c}").alias(c) for c in columns))


def upgraded(df: DataFrame, keys: list[str], order: list[Column], preferred: Column, value: str) -> DataFrame:
    """Per key the first value in order among the preferred rows, else among all, with ``n_rows`` and ``upgraded``: whether
    a preferred one came after another. ``order`` must decide every tie."""
    at = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    rows = df.where(F.col(value).isNotNull()).withColumn("__p", F.coalesce(preferred, F.lit(False)))
    some = F.when(F.col("__p"), at)
    got = rows.groupBy(*keys).agg(F.min_by(value, some).alias("__best"), F.min_by(value, at).alias("__first"), F.min_by("__p", at).alias("__was"), F.bool_or("__p").alias("__any"), F.count(F.lit(1)).alias("n_rows"))
    return got.select(*keys, F.when(F.col("__any"), F.col("__best")).otherwise(F.col("__first")).alias(value), "n_rows", (F.col("__any") & ~F.col("__was")).alias("upgraded"))


def ends(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first and the last ``n`` rows of each group, with ``place`` from 1 and ``from_end`` from 1."""
    by = W.partitionBy(*keys)
    up, down = F.row_number().over(by.orderBy(*(F.col(c).asc_nulls_first() for c in order))), F.row_number().over(by.orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    return df.withColumn("place", up).withColumn("from_end", down).where((F.col("place") <= n) | (F.col("from_end") <= n))


def occurrence(df: DataFrame, keys: list[str], *order: Column, name: str = "instance") -> DataFrame:
    """Numbers equal keys from 0."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def instance_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column], how: str = "left") -> DataFrame:
    """Joins the n-th row of a key with the n-th row of that key."""
    return occurrence(left, keys, *left_order).join(occurrence(right, keys, *right_order), [*keys, "instance"], how)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; reading it fails if a key occurs twice."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    checked = df.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{keys} is not unique"))).otherwise(F.lit(True)))
    return checked.where("__ok").drop("__n", "__ok")


def left_join_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that cannot multiply rows."""
    return left.join(assert_unique(right, keys), keys, "left")


def audited_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join with ``match``: both or left_only."""
    return left.join(right.withColumn("__hit", F.lit(True)), keys, "left").withColumn("match", F.when(F.col("__hit"), "both").otherwise("left_only")).drop("__hit")


def fallback_lookup(left: DataFrame, steps: list[tuple[str, DataFrame, str]], value: str, how_name: str = "matched_by") -> DataFrame:
    """``value`` from the first lookup that has it. A step is a column of ``left``, a table and its key; of equal keys the last by its ``ord`` column counts."""
    out, found = left, []
    for i, (column, table, key) in enumerate(steps):
        t = table.groupBy(F.col(key).alias(f"__k{i}")).agg(F.max_by(value, "ord").alias(f"__v{i}"))
        out = out.join(t, F.col(column) == F.col(f"__k{i}"), "left")
        found.append((F.col(f"__v{i}"), column))
    named = None
    for v, c in found:
        named = F.when(v.isNotNull(), c) if named is None else named.when(v.isNotNull(), c)
    return out.withColumns({value: F.coalesce(*(v for v, _ in found)), how_name: named.otherwise("none")}).drop(*(f"__{x}{i}" for i in range(len(steps)) for x in "kv"))


def chained_lookup(left: DataFrame, first: DataFrame, second: DataFrame, key: str, via: str) -> DataFrame:
    """Looks ``key`` up in ``first`` to get ``via``, and that in ``second``: status renamed, uncertain or dead."""
    a = left.join(first, key, "left")
    b = a.join(second.select(F.col(via)).distinct().withColumn("__s", F.lit(True)), via, "left")
    return b.withColumn("status", F.when(F.col(via).isNull(), "dead").when(F.col("__s"), "renamed").otherwise("uncertain")).drop("__s")


def priority_union(tables: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """A row per key from the first table that has it; its order is ``priority``."""
    whole = None
    for i, t in enumerate(tables):
        t = t.select(*keys, *columns).withColumn("priority", F.lit(i))
        whole = t if whole is None else whole.unionByName(t)
    return pick(whole, keys, [F.col("priority"), *(F.col(c) for c in columns)], *columns, "priority")


def join_sorted(values: Column, sep: str = "; ") -> Column:
    """The different values of a group in order."""
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


def join_ordered(values: Column, order: Column, sep: str = "; ") -> Column:
    """The different values of a group, each where it first stands."""
    inside = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_join(F.array_distinct(F.transform(inside, lambda x: x["v"])), sep)


def aggregate_by_rules(df: DataFrame, keys: list[str], rules: dict[str, str], order: Column) -> DataFrame:
    """Each column that is there by its rule: first (in ``order``), max, min, any, sum or join."""
    kinds = {
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)),
        "max": F.max,
        "min": F.min,
        "any": F.bool_or,
        "sum": F.sum,
        "join": lambda c: join_ordered(F.col(c), order),
    }
    return df.groupBy(*keys).agg(*(kinds[r](c).alias(c) for c, r in rules.items() if c in df.columns))


def top_or_other(df: DataFrame, column: str, k: int, other: str = "other") -> DataFrame:
    """``df`` with all but the k commonest values (ties to the smaller) replaced."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    top = counts.orderBy(F.col("__c").desc(), F.col(column)).limit(k).select(column, F.lit(True).alias("__top"))
    return df.join(top, column, "left").withColumn(column, F.when(F.col("__top"), F.col(column)).when(F.col(column).isNotNull(), other)).drop("__top")


def presence(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each of a fixed list of values."""
    return df.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col(column) == v, 1)), F.lit(0)).alias(str(v)) for v in values))


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one value, in one pass."""
    seen = df.agg(*((F.min(c) != F.max(c)).alias(c) for c in columns)).first()
    return [c for c in columns if seen[c]]
