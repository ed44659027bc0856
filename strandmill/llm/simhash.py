"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints that differ in at most ``max_bits`` bits share at least one of ``max_bits + 1``
parts. So there is a trie for each part, of the fingerprints turned so that the part leads:
within it only equal nodes are paired, below it pairs of nodes are traversed together, the
differing bits of their paths add up, and a pair beyond the budget is pruned. Node pairs of
many fingerprints are descended as tables, level by level, each a plain join of node counts;
pairs of few are finished in one task each, many at a time. No pair of fingerprints is
emitted: a task gives the links of a spanning forest of what it has found.

A null or empty text, or one without words, has the fingerprint zero and is linked like any
other. A text of fewer words than a shingle has one shingle of all its words. Repeated rows
stay rows of their own; null ids count for no minimum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import cut, numbered, prepare, raw, small
from strandmill.llm.graph import components

#: Node pairs of so many fingerprints at most are finished in one task.
FEW = 256
#: Bits that a level of the distributed descent takes.
STEP = 4


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of a text's bytes, unsigned: a bit is 1 if more than half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    cut_at = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in cut_at), "<u8", len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp`` (the fingerprint as a signed long) in place of the text."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, "fp")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(len(rest))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(fps)], names=[*rest, "fp"])

    return docs.select(*(F.col(f"`{c}`") for c in rest), raw(F.col(text_col)).alias("__raw")).mapInArrow(run, schema)


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _node(trie: Column, rot: Column, widths: list[int], deeper: int) -> Column:
    """The path of a fingerprint so many bits below the leading part."""
    out = F.lit(None).cast("long")
    for r, w in enumerate(widths):
        out = F.when(trie == r, F.shiftrightunsigned(rot, 64 - min(64, w + deeper))).otherwise(out)
    return out


def traverse(rot: np.ndarray, pairs: np.ndarray, bit: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the places of ``rot`` by the joint traversal of node pairs.

    ``pairs`` has the columns (a's start, a's end, b's start, b's end, bits that differ so
    far), each node being a stretch of fingerprints in order that agree in their first
    ``bit`` bits; equal nodes mean the pairs within. Fingerprints within a node differ."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(pairs, bit)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        p, bit = stack.pop()
        if len(p) > 1 << 19:  # bounded memory: the halves in turn
            stack += [(p[len(p) // 2 :], bit), (p[: len(p) // 2], bit)]
            continue
        same = p[:, 0] == p[:, 2]
        single = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        i, j = p[single & ~same, 0], p[single & ~same, 2]
        ok = np.bitwise_count(rot[i] ^ rot[j]) <= budget
        found.append((i[ok], j[ok]))
        p, same = p[~single], same[~single]
        if not len(p) or bit == 64:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((rot >> np.uint64(63 - bit)) & np.uint64(1))]).astype(np.int64)
        c = ones[bit]
        a0, a1, b0, b1, err = p.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        apart = ~same
        nxt = np.concatenate(
            [
                np.stack([a0, am, b0, bm, err], 1),
                np.stack([am, a1, bm, b1, err], 1),
                np.stack([a0, am, bm, b1, err + 1], 1),
                np.stack([am, a1, b0, bm, err + 1], 1)[apart],
            ]
        )
        stack.append((nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)], bit + 1))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that chains of at most ``max_bits`` bits connect.

    ``fps`` has one column ``fp`` of distinct longs."""
    parts = max_bits + 1
    widths = [64 // parts + (r >= parts - 64 % parts) for r in range(parts)]
    shifts = [sum(widths[:r]) for r in range(parts)]
    tries = fps.select(F.explode(F.array(*(F.struct(F.lit(r).alias("r"), _turned(F.col("fp"), s).alias("rot")) for r, s in enumerate(shifts)))).alias("t")).select("t.*")
    at = lambda deeper: tries.withColumn("node", _node(F.col("r"), F.col("rot"), widths, deeper))
    counted = at(0).groupBy("r", "node").count().where("count > 1")
    pairs = cut(counted.select("r", F.col("node").alias("p"), F.col("node").alias("q"), F.col("count").alias("np"), F.col("count").alias("nq")))
    size = F.when(F.col("p") == F.col("q"), F.col("np")).otherwise(F.col("np") + F.col("nq"))
    members = []
    deeper = 0
    while True:
        last = deeper >= 64 - min(widths)
        small = pairs if last else pairs.where(size <= FEW)
        block = small.select("r", "p", "q")
        here = at(deeper)
        key = [F.col("r"), F.lit(deeper).alias("deeper"), F.col("p"), F.col("q")]
        left = here.join(block.withColumnRenamed("p", "node"), ["r", "node"]).withColumnRenamed("node", "p").select(*key, F.lit(0).alias("side"), "rot")
        members.append(left)
        if deeper:
            members.append(here.join(block.where("p <> q").withColumnRenamed("q", "node"), ["r", "node"]).withColumnRenamed("node", "q").select(*key, F.lit(1).alias("side"), "rot"))
        big = pairs.where(size > FEW)
        if last or big.isEmpty():
            break
        deeper += STEP
        # the children of every node that is in a large pair, with their counts
        nodes = big.select("r", F.col("p").alias("node")).union(big.select("r", "q")).distinct()
        up = at(deeper - STEP).withColumnRenamed("node", "parent")
        children = up.join(nodes.withColumnRenamed("node", "parent"), ["r", "parent"]).withColumn("node", _node(F.col("r"), F.col("rot"), widths, deeper)).groupBy("r", "parent", "node").count()
        children = cut(children)
        a = children.select("r", F.col("parent").alias("p"), F.col("node").alias("p2"), F.col("count").alias("np2"))
        b = children.select("r", F.col("parent").alias("q"), F.col("node").alias("q2"), F.col("count").alias("nq2"))
        met = big.select("r", "p", "q").join(a, ["r", "p"]).join(b, ["r", "q"])
        kept = met.where((F.bit_count(F.col("p2").bitwiseXOR(F.col("q2"))) <= max_bits) & ((F.col("p") != F.col("q")) | (F.col("p2") <= F.col("q2"))))
        pairs = cut(kept.select("r", F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("np2").alias("np"), F.col("nq2").alias("nq")).where("p <> q OR np > 1"))
    table = members[0]
    for m in members[1:]:
        table = table.unionByName(m)
    block_key = ["r", "deeper", "p", "q"]
    dealt = table.repartition(*block_key).sortWithinPartitions(*block_key, "side", F.col("rot") < 0, "rot")

    def finish(r, deeper, p, q, side, rot) -> pa.RecordBatch | None:
        """The links of whole blocks, given in order."""
        new = np.append(True, (r[1:] != r[:-1]) | (deeper[1:] != deeper[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(r))
        firsts = np.concatenate([[0], np.cumsum(side == 0)])
        mid = start + firsts[end] - firsts[start]
        one = p[start] == q[start]
        err = np.bitwise_count((p[start] ^ q[start]).view(np.uint64)).astype(np.int64)
        todo = np.stack([start, mid, np.where(one, start, mid), end, err], 1)
        depth = np.minimum(64, np.array(widths)[r[start]] + deeper[start])
        u = rot.view(np.uint64)
        found = [traverse(u, todo[depth == d], int(d), max_bits) for d in np.unique(depth)]
        i, j = (np.concatenate([f[x] for f in found]) for x in (0, 1))
        if not len(i):
            return None
        label = forest(len(r), i, j)
        m = np.flatnonzero(label != np.arange(len(r)))
        back = np.array(shifts, np.uint64)[r[m]]
        turn = lambda x: np.where(back == 0, x, (x >> back) | (x << ((np.uint64(64) - back) % np.uint64(64)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(turn(u[label[m]])), pa.array(turn(u[m]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            # the last block may go on in the next batch
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], 0))
            k = int(last[-1]) + 1 if len(last) else 0
            rest = [c[k:] for c in cols]
            if k and (out := finish(*(c[:k] for c in cols))):
                yield out
        if rest is not None and len(rest[0]) and (out := finish(*rest)):
            yield out

    return dealt.mapInArrow(run, "a long, b long")


def _rooted(prints: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """(fp, least): for every fingerprint the smallest ``least`` of its component."""
    distinct = cut(prints.groupBy("fp").agg(F.min(least).alias("own")))
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("a", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.join(rooted.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id that links lead to."""
    prints = cut(with_fingerprint(docs.select(id_col, text_col), text_col, shingle))
    return prints.join(_rooted(prints, F.col(id_col), max_bits), "fp").select(id_col, "fp", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, null last; of repeated ids one row."""
    stored, row = numbered(docs, "docs")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    prints = cut(with_fingerprint(stored.select(id_col, row, text_col), text_col, shingle))
    stays = _rooted(prints, first, max_bits).select(F.col("least.row").alias(row)).distinct()
    return stored.join(stays, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
