"""Sums of distances to the members of every cluster, exactly and without pairs of rows.

Gower's and Manhattan's distances are sums over columns, and within a column the distances of a
value to all values of a cluster follow from how many of them are not above it and from their
sum: running counts and sums by value, in sorted ranges where they are many. So medoids and
silhouettes take a pass over rows x columns x clusters, however large a cluster is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.scan import within


def gower_scaled(df: DataFrame, blocks: list[str], binary: list[str], continuous: list[str], categorical: list[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns scaled within their block so that the sum of their differences is Gower's distance, and a weight column
    for each categorical one: the mean over the kinds that vary of Hamming, mismatch and range-scaled Manhattan."""
    numeric = [*binary, *continuous]
    spans = df.groupBy(*blocks).agg(*(x for c in [*numeric, *categorical] for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))))
    varies = lambda c: (F.col(f"__lo_{c}") < F.col(f"__hi_{c}")).cast("int")
    kinds = [k for k in (binary, continuous, categorical) if k]
    n = {id(k): sum((varies(c) for c in k[1:]), varies(k[0])) for k in kinds}
    total = sum((F.when(n[id(k)] > 0, 1).otherwise(0) for k in kinds[1:]), F.when(n[id(kinds[0])] > 0, 1).otherwise(0))
    share = lambda k: F.coalesce(F.try_divide(F.lit(1.0), n[id(k)] * total), F.lit(0.0))
    span = lambda c: F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
    met = df.join(F.broadcast(spans), how="cross") if not blocks else df.join(spans, blocks)
    scaled = {c: F.when(varies(c) == 1, F.col(c) * share(k) / (span(c) if k is continuous else F.lit(1.0))).otherwise(0.0) for k in kinds if k is not categorical for c in k}
    weights = {f"__w_{c}": F.when(varies(c) == 1, share(categorical)).otherwise(0.0) for c in categorical}
    made = met.withColumns(weights | scaled) if weights else met.withColumns(scaled)
    return made.drop(*(f"__{e}_{c}" for c in [*numeric, *categorical] for e in ("lo", "hi"))), {c: f"__w_{c}" for c in categorical}


def sums(df: DataFrame, blocks: list[str], key: str, cluster: str, numeric: list[str], categorical: dict[str, str] | None = None) -> DataFrame:
    """Per row and cluster of its block: blocks, key, ``cluster`` (the row's own), other, total (of distances to the other's members), n (its members).

    ``categorical`` leads from a column to that of its weight. Rows with a null cluster or a null among the columns take no part."""
    categorical = categorical or {}
    known = df.where(F.col(cluster).isNotNull()).dropna(subset=[*numeric, *categorical])
    sizes = known.groupBy(*blocks, F.col(cluster).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    at, parts = [*blocks, "__dim"], []
    if numeric:
        cells = F.array(*(F.struct(F.lit(i).alias("__dim"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(numeric)))
        long = known.select(*blocks, key, cluster, F.explode(cells).alias("__c")).select(*blocks, key, cluster, "__c.__dim", "__c.__v")
        counts = long.groupBy(*at, F.col(cluster).alias("other"), "__v").agg(F.count(F.lit(1)).alias("__m"))
        values = counts.select(*at, "__v").distinct()
        grid = (values.join(sizes, blocks) if blocks else values.join(F.broadcast(sizes), how="cross")).join(counts, [*at, "other", "__v"], "left").withColumn("__m", F.coalesce("__m", F.lit(0)))
        placed = within(grid, [*at, "other"], ["__v"], __n=("sum", F.col("__m")), __s=("sum", F.col("__m") * F.col("__v")))
        whole = counts.groupBy(*at, "other").agg(F.sum(F.col("__m") * F.col("__v")).alias("__all"))
        v, n, s = F.col("__v"), F.col("__n"), F.col("__s")
        far = v * n - s + (F.col("__all") - s) - v * (F.col("n") - n)
        table = placed.join(whole, [*at, "other"]).select(*at, "__v", "other", far.alias("__d"))
        parts.append(long.join(table, [*at, "__v"]).groupBy(*blocks, key, cluster, "other").agg(F.sum("__d").alias("__d")))
    for c, w in categorical.items():
        counts = known.groupBy(*blocks, F.col(cluster).alias("other"), F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
        values = counts.select(*blocks, "__v").distinct()
        grid = (values.join(sizes, blocks) if blocks else values.join(F.broadcast(sizes), how="cross")).join(counts, [*blocks, "other", "__v"], "left")
        table = grid.select(*blocks, "__v", "other", (F.col("n") - F.coalesce("__m", F.lit(0))).alias("__far"))
        parts.append(known.select(*blocks, key, cluster, F.col(c).alias("__v"), F.col(w).alias("__w")).join(table, [*blocks, "__v"]).select(*blocks, key, cluster, "other", (F.col("__w") * F.col("__far")).alias("__d")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*blocks, key, cluster, "other").agg(F.greatest(F.sum("__d"), F.lit(0.0)).alias("total")).join(sizes, [*blocks, "other"])


def medoids(summed: DataFrame, blocks: list[str], key: str, cluster: str) -> DataFrame:
    """The member of each cluster with the least sum of distances to the others (ties to the smaller key), and their mean."""
    own = summed.where(F.col("other") == F.col(cluster))
    best = own.groupBy(*blocks, cluster).agg(F.min_by(F.struct(key, "total"), F.struct(F.round("total", 9), key)).alias("b"), F.max("n").alias("size"))
    return best.select(*blocks, cluster, F.col(f"b.{key}").alias("medoid"), F.when(F.col("size") > 1, F.col("b.total") / (F.col("size") - 1)).otherwise(0.0).alias("mean_distance"), "size")


def silhouettes(summed: DataFrame, blocks: list[str], key: str, cluster: str) -> DataFrame:
    """Per row: blocks, key, cluster, and its silhouette: 0 alone in its cluster, null where there is no other cluster."""
    own = F.col("other") == F.col(cluster)
    per = summed.groupBy(*blocks, key, cluster).agg(F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(*blocks, key, cluster, value.alias("silhouette"))
