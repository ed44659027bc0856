"""Running numbers, sums and extremes within a key that use all tasks, however the rows fall on keys.

A window over a key puts all of its rows into one task. Here rows are sorted into ranges of
(key, order), so that a hot key fills many ranges; each range is scanned alone; and what a key
had in earlier ranges is added. Only the first key of a range can have begun before it, so
that the table of what is added has at most one row per range and is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.operators.storage import stored

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_WAYS = {"asc": F.asc_nulls_first, "desc": F.desc_nulls_last, "desc_nulls_first": F.desc_nulls_first}
#: Rows of a key that one task takes in a window.
KEY_ROWS = 1_000_000


def _ordered(order: list) -> list[tuple[Column, str]]:
    return [(F.col(c[0]) if isinstance(c[0], str) else c[0], c[1]) if isinstance(c, tuple) else (F.col(c) if isinstance(c, str) else c, "asc") for c in order]


def hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether some key has more rows than one task should take."""
    return bool(df.groupBy(*keys).count().where(F.col("count") > KEY_ROWS).head(1))


def within(df: DataFrame, keys: list[str], order: list, number: str | None = None, before: bool = False, many: bool | None = None, **columns: tuple[str, Column]) -> DataFrame:
    """``running``, by a window over each key where no key is hot, else over sorted ranges; ``many`` tells which, if known."""
    if many if many is not None else hot(df, keys):
        return running(df, keys, order, number, before=before, **columns)
    by = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*(_WAYS[way](c) for c, way in _ordered(order)))
    frame = by.rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    made = {name: _COMBINE[how](c).over(frame) for name, (how, c) in columns.items()}
    return df.withColumns(made | ({number: F.row_number().over(by).cast("long")} if number else {}))


def running(df: DataFrame, keys: list[str | Column], order: list, number: str | None = None, ranges: int | None = None, before: bool = False, **columns: tuple[str, Column]) -> DataFrame:
    """``df`` with columns over the rows of a key up to the row itself, which counts unless they are asked for ``before`` it.

    ``order`` lists columns, ascending with nulls first, or pairs (column, "desc"), with nulls
    last, or (column, "desc_nulls_first"). ``number`` names a column of places from 1. Other
    columns are given as (sum, max, min or last, value); values that are null count for nothing, as in Spark's aggregates. Rows that tie in
    ``order`` stand in an order of their own, the same in all columns. Null keys are one key. An
    empty table gives an empty one. Columns of the same names are replaced."""
    spark = df.sparkSession
    if bad := {how for how, _ in columns.values()} - set(_COMBINE):
        raise ValueError(f"unknown aggregates {sorted(bad)}")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in df.columns if c != number and c not in columns]
    fresh = "__scan"
    while any(c.startswith(fresh) for c in df.columns):
        fresh += "_"
    k, o, v = (f"{fresh}_{x}" for x in "kov")
    part, at, first = f"{fresh}_part", f"{fresh}_at", f"{fresh}_first"
    ways = _ordered(order)
    held = df.select(
        *(F.col(f"`{c}`") for c in keep),
        F.struct(*(keys or [F.lit(0)])).alias(k),
        *(c.alias(f"{o}{i}") for i, (c, _) in enumerate(ways)),
        *(c.alias(f"{v}_{name}") for name, (_, c) in columns.items()),
        F.monotonically_increasing_id().alias(f"{o}_tie"),
    )
    by = [F.col(k), *(_WAYS[way](F.col(f"{o}{i}")) for i, (_, way) in enumerate(ways)), F.col(f"{o}_tie")]
    sorted_ = held.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    rows = stored(sorted_.select(*(F.col(f"`{c}`") for c in keep), k, *(f"{v}_{n}" for n in columns), F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), "scan")

    # what each key has in each range, and had in the ranges before
    each = rows.groupBy(part, k).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("upto"), *((F.max_by(f"{v}_{n}", F.when(F.col(f"{v}_{n}").isNotNull(), F.col(at))) if how == "last" else _COMBINE[how](f"{v}_{n}")).alias(f"own_{n}") for n, (how, _) in columns.items()))
    earlier = W.partitionBy(k).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = each.select(
        F.col(part),
        F.col("upto"),
        F.row_number().over(W.partitionBy(k).orderBy(part)).alias("nth"),
        F.sum("n").over(earlier).alias("before"),
        *(_COMBINE[how](f"own_{n}").over(earlier).alias(f"own_{n}") for n, (how, _) in columns.items()),
    ).where("nth > 1")
    carried = F.broadcast(carried.select(F.col(part), F.col("upto").alias(f"{fresh}_upto"), F.col("before").alias(f"{fresh}_before"), *(F.col(f"own_{n}").alias(f"{fresh}_own_{n}") for n in columns)))

    here = W.partitionBy(part, k).orderBy(at).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    local = rows.select("*", F.row_number().over(W.partitionBy(part, k).orderBy(at)).alias(first), *(_COMBINE[how](f"{v}_{n}").over(here).alias(f"{fresh}_here_{n}") for n, (how, _) in columns.items()))
    met = local.join(carried, part, "left")
    goes_on = F.col(at) <= F.col(f"{fresh}_upto")
    out = []
    if number:
        out.append((F.col(first) + F.coalesce(F.when(goes_on, F.col(f"{fresh}_before")), F.lit(0))).cast("long").alias(number))
    for n, (how, _) in columns.items():
        mine, had = F.col(f"{fresh}_here_{n}"), F.when(goes_on, F.col(f"{fresh}_own_{n}"))
        if how == "sum":
            total = F.when(mine.isNull(), had).when(had.isNull(), mine).otherwise(mine + had)
        else:
            total = {"max": F.greatest, "min": F.least, "last": F.coalesce}[how](mine, had)
        out.append(total.alias(n))
    return met.select(*(F.col(f"`{c}`") for c in keep), *out)


def numbered(df: DataFrame, keys: list[str | Column], order: list, name: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place within its key, from 1."""
    return running(df, keys, order, name, ranges)


def quantiles(df: DataFrame, keys: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """Exact quantiles of columns, interpolated: keys, ``column`` and ``quantiles``, an array in the order of ``shares``; null where a column has no value.

    From counts of equal values: in one buffer where a key has few, else off running counts in sorted ranges."""
    wide = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    long = wide.unpivot(keys, columns, "column", "__v").where("__v IS NOT NULL") if keys else wide.unpivot([], columns, "column", "__v").where("__v IS NOT NULL")
    by = [*keys, "column"]
    counts = long.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    if not hot(counts, by):
        return counts.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, shares)), F.col("__n")).alias("quantiles"))
    key = F.struct(*by)
    placed = running(counts.withColumn("__key", key), ["__key"], ["__v"], __upto=("sum", F.col("__n")))
    totals = counts.groupBy(key.alias("__key")).agg(F.sum("__n").alias("__all"))
    met, found = placed.join(totals, "__key"), []
    for q in shares:
        at = F.lit(q) * (F.col("__all") - 1)
        low, high = (F.min(F.when(F.col("__upto") > f(at), F.col("__v"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        found.append(low + part * (high - low))
    return met.groupBy("__key").agg(F.array(*found).alias("quantiles")).select("__key.*", "quantiles")
