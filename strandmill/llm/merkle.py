"""Merkle dataset manifest: a tree of hashes per group of rows and one over the groups, kept as parents' preimages.

A leaf is the hash of a row's fields, each ``-`` if null and else its UTF-8 byte count, a colon
and its value. A group's leaves ascend by the order column; while several nodes remain, every
``arity`` consecutive ones become the hash of their concatenated hashes, the last run also where
it is shorter. What remains is the group's subroot; subroots, by group, likewise give the root.
All hashes are SHA-256 in lower-case hex.

A parent is stored as its preimage, the concatenated hashes of its children, by blocks of some
levels: a row holds the preimages of all parents over one aligned block of nodes. A leaf joins
its block, whose row already carries the preimages above it. Cutting its own 64 characters out
of each preimage leaves the siblings; overlaying them with a recomputed hash folds up to the root.

Null groups and null order values come first. Rows that are equal in the order column stand in
order of their leaves. An empty table has no root. Groups and ties may be of any size: places are
numbered over sorted ranges, and a block holds at most ``arity ** LEVELS`` nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import let
from strandmill.llm._common import keep, prepare
from strandmill.operators.scan import numbered

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block: 64 nodes of a binary tree.
LEVELS = 6
HEX = 64


def field(value: Column) -> Column:
    """A field of a leaf's preimage."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass
class Manifest:
    """Stored tables of a tree.

    ``leaves``: the kept columns, leaf, group, place (from 0). ``blocks``: one row per lowest
    block: group, block, preimages by level, path (what lies above the block, up to the root),
    subroot. ``subroots``: group, hash. ``root``: null for an empty table."""

    leaves: DataFrame
    blocks: DataFrame
    subroots: DataFrame
    root: str | None
    arity: int

    def paths(self) -> DataFrame:
        """The leaves with subroot and ``path``: from the leaf up, each ancestor's preimage and the child's place in it."""
        size = self.arity**LEVELS
        at = self.leaves.withColumn("block", F.floor(F.col("place") / size))
        met = at.join(self.blocks, ["group", "block"])
        path = F.concat(_path_in(F.col("preimages"), F.col("place") % size, self.arity), F.col("path"))
        return met.select(*(F.col(f"`{c}`") for c in self.leaves.columns), "subroot", path.alias("path"))


def siblings(path: Column) -> Column:
    """The hashes beside a path, concatenated: level by level upwards, left to right."""
    others = lambda e: F.overlay(e["preimage"], F.lit(""), e["child"] * HEX + 1, F.lit(HEX))
    return F.array_join(F.transform(path, others), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to beside the siblings of a path."""
    up = lambda h, e: F.sha2(F.overlay(e["preimage"], h, e["child"] * HEX + 1, F.lit(HEX)), 256)
    return F.aggregate(path, leaf, up)


def _path_in(preimages: Column, place: Column, arity: int) -> Column:
    """The preimages above a node of a block, with the child's place in each; ``place`` counts within the block."""

    def step(level: Column, i: Column) -> Column:
        below = F.pow(F.lit(arity), i).cast("long")  # leaves under a child
        parent = F.floor(place / (below * arity)).cast("int")
        child = (F.floor(place / below) % arity).cast("int")
        return F.struct(F.get(level, parent).alias("preimage"), child.alias("child"))

    return F.transform(preimages, step)


def _levels(n: Column, arity: int) -> Column:
    """The number of levels over n nodes."""
    step = lambda a, _: F.when(a["size"] < n, F.struct((a["size"] * arity).alias("size"), (a["levels"] + 1).alias("levels"))).otherwise(a)
    start = F.struct(F.lit(1).cast("long").alias("size"), F.lit(0).alias("levels"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, step, lambda a: a["levels"])


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Blocks of the trees over nodes (group, place, hash), a stored table for every ``LEVELS`` levels, from below.

    Columns: group, block, preimages, hash (of the block's top), rest (levels above it in its group)."""
    size, strata = arity**LEVELS, []
    levels = nodes.groupBy("group").agg(_levels(F.count(F.lit(1)), arity).alias("levels"))
    while True:
        blocks = nodes.groupBy("group", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("nodes"))
        blocks = blocks.join(levels, "group")
        own = F.least("levels", F.lit(LEVELS))
        start = F.struct(F.col("nodes")["hash"].alias("hashes"), F.array().cast("array<array<string>>").alias("preimages"))

        def level(a: Column, _: Column) -> Column:
            parents = F.ceil(F.size(a["hashes"]) / arity).cast("int")
            runs = F.transform(F.sequence(F.lit(0), parents - 1), lambda i: F.array_join(F.slice(a["hashes"], i * arity + 1, F.lit(arity)), ""))
            return let(runs, lambda r: F.struct(F.transform(r, lambda x: F.sha2(x, 256)).alias("hashes"), F.concat(a["preimages"], F.array(r)).alias("preimages")))

        steps = F.when(own > 0, F.sequence(F.lit(1), own)).otherwise(F.array().cast("array<int>"))
        made = blocks.select("group", "block", F.aggregate(steps, start, level).alias("tree"), (F.col("levels") - own).alias("rest"))
        strata.append(keep(made.select("group", "block", "tree.preimages", F.col("tree.hashes")[0].alias("hash"), "rest"), "merkle"))
        going = strata[-1].where("rest > 0")
        if going.isEmpty():
            return strata
        nodes = going.select("group", F.col("block").alias("place"), "hash")
        levels = going.groupBy("group").agg(F.max("rest").alias("levels"))


def _descend(strata: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest blocks with what lies above them: ``tops`` holds group, path (above the group's top) and further columns to hand down."""
    size, handed, above = arity**LEVELS, [c for c in tops.columns if c != "group"], None
    for stratum in reversed(strata):
        here = stratum.where("rest = 0").join(tops, "group")
        if above is not None:
            up = above.select("group", F.col("block").alias("__up"), F.col("preimages").alias("__above"), *handed)
            met = stratum.where("rest > 0").withColumn("__up", F.floor(F.col("block") / size)).join(up, ["group", "__up"])
            path = F.concat(_path_in(F.col("__above"), F.col("block") % size, arity), F.col("path"))
            here = here.unionByName(met.withColumn("path", path).select(*here.columns))
        above = here
    return above


def build(docs: DataFrame, columns=COLUMNS, group_col: str = "lang", order_col: str = "doc_id", arity: int = 2, kept: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table; ``kept`` names what the leaves carry along besides leaf, group and place."""
    prepare(docs.sparkSession)
    kept = kept if kept is not None else {order_col: F.col(f"`{order_col}`")}
    group = F.col(f"`{group_col}`").cast("string")
    # a key without nulls, in the same order: null, then bytewise
    key = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    rows = docs.select(*(c.alias(n) for n, c in kept.items()), F.col(f"`{order_col}`").alias("__order"), leaf_hash([F.col(f"`{c}`") for c in columns]).alias("leaf"), key.alias("group"))
    leaves = numbered(rows, ["group"], ["__order", "leaf"]).withColumn("place", F.col("place") - 1).drop("__order")
    leaves = keep(leaves, "leaves")
    strata = _climb(leaves.select("group", "place", F.col("leaf").alias("hash")), arity)
    subroots = None
    for stratum in strata:
        ended = stratum.where("rest = 0").select("group", "hash")
        subroots = ended if subroots is None else subroots.unionByName(ended)
    subroots = keep(numbered(subroots, [], ["group"]).withColumn("place", F.col("place") - 1), "subroots")
    upper = _climb(subroots.select(F.lit("").alias("group"), "place", "hash"), arity)
    root = upper[-1].select("hash").first()
    none = F.array().cast("array<struct<preimage:string,child:int>>")
    roots = upper[-1].select("group", none.alias("path"))
    over = _descend(upper, roots, arity).select(F.col("block"), "preimages", "path")
    size = arity**LEVELS
    named = subroots.withColumn("block", F.floor(F.col("place") / size)).join(over, "block")
    tops = named.select("group", F.concat(_path_in(F.col("preimages"), F.col("place") % size, arity), F.col("path")).alias("path"), F.col("hash").alias("subroot"))
    blocks = _descend(strata, keep(tops, "tops"), arity).select("group", "block", "preimages", "path", "subroot")
    return Manifest(leaves, blocks, subroots.select("group", "hash"), root[0] if root else None, arity)


def audit(docs: DataFrame, changed: dict[str, Column], columns=COLUMNS, group_col: str = "lang", order_col: str = "doc_id", arity: int = 2) -> DataFrame:
    """Per row: the order column, leaf, subroot, root, proof_sha256, and what its row as ``changed`` folds to.

    ``changed`` gives columns their values at the time of the audit; the tree is that of the
    rows as they are. ``verified``: the folded root is the root."""
    now = leaf_hash([changed.get(c, F.col(f"`{c}`")) for c in columns])
    manifest = build(docs, columns, group_col, order_col, arity, {order_col: F.col(f"`{order_col}`"), "__now": now})
    rows = manifest.paths()
    root = F.lit(manifest.root).cast("string")
    out = rows.select(order_col, "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("__now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(order_col: str = "doc_id", count_col: str = "n_chars") -> dict[str, Column]:
    """One added to a count where 7 divides the CRC-32 of the order column's decimal digits; nulls stay."""
    hit = F.crc32(F.col(f"`{order_col}`").cast("string").cast("binary")) % 7 == 0
    count = F.col(f"`{count_col}`")
    return {count_col: F.when(hit, count + 1).otherwise(count)}
