"""Connected components of very large graphs: no node, link or component is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import cut


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node with a link, root being the least node of its component, from links (a, b).

    Alternates large and small stars until nothing changes: each round every node hands its
    larger, then its smaller neighbours to the least one it knows. Minima are combined before
    they are shuffled, and the joins are plain ones that Spark may split where a node is hot."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    before = _print_of(links)
    if not before[0]:
        return links.select("a", F.col("b").alias("root"))
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        links = cut(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = _print_of(links)
        if now == before:
            return links.select("a", F.col("b").alias("root"))
        before = now
