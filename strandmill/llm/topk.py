"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. A histogram of scores is
counted per query over the whole table; the bin that holds the k-th best score becomes the
next round's range, until the bin is one score wide or few candidates are left at or above
it. A last pass keeps what reaches that bound and breaks ties by the smaller id.

Candidates stay where they are stored; nothing of them is shuffled. In each round the queries
whose range is open, a small part of the table, are written as blocks with their ranges, and
every task of candidates reads these blocks one after the other. Counts are summed in the task
before they are shuffled.

Vectors that are null, empty or hold a null or non-finite component take no part. Vectors
of different lengths are not compared. Repeated rows are queries and candidates of their own:
a row is never a candidate for itself. A null id takes no part. Components become
floor(scale * x); scores are exact integers. A score beyond 64 bits raises."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import cut, filesystem, fresh_dir, prepare, small

BINS = 256
EXACT = 2**53


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point multiplication where every sum stays exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    if whole.size and max(abs(int(whole.max())), abs(int(whole.min()))) >= 2**63:
        raise OverflowError("a score does not fit in 64 bits")
    return whole.astype(np.int64)


def _stacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (row, id, v, ...): for each length of vectors the length, the places in the batch, row numbers, and the matrix."""
    v = batch.column(2)
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, batch.column(0).to_numpy()[at], flat[starts[at][:, None] + np.arange(dim)]


def _query_blocks(folder: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table in the shared folder, a block at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = filesystem(folder)
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            yield from pq.ParquetFile(opened).iter_batches(size)


def top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_block: int = 512, candidate_block: int = 4096) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank from 1, vec_id, score."""
    spark = prepare(vectors.sparkSession)
    v = F.col(vector_col)
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False)) & (F.size(v) > 0)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    named = vectors.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), is_query.alias("is_query"))
    tasks = spark.sparkContext.defaultParallelism
    dealt = named if named.rdd.getNumPartitions() >= tasks else named.repartition(tasks)
    table = cut(dealt.select(F.monotonically_increasing_id().alias("row"), "id", "v", "is_query"))
    candidates = table.select("row", "id", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = table.agg(F.max(norm)).first()[0] or 0.0
    # no score of a query is beyond its own norm times the longest; a range is cut into bins of equal width
    top = F.ceil(norm * longest * (1 + 1e-9)).cast("long") + 1
    bins = lambda span: F.ceil(span / BINS).cast("long")
    # held is -1 while a query's range can still be cut: until it is one score wide or few enough candidates reach it
    asked = cut(table.where("is_query").select("row", "id", "v", top.alias("top")))
    state = cut(asked.select("row", (-F.col("top")).alias("lo"), (2 * F.col("top") + 1).alias("span"), bins(2 * F.col("top") + 1).alias("width"), F.lit(0).cast("long").alias("above"), F.lit(-1).cast("long").alias("held")))

    def scored(state: DataFrame, task, schema: str) -> DataFrame:
        """``task(...)`` over every task of candidates, as an iterator of its blocks' scores against all queries of ``state``."""
        folder = fresh_dir(spark, "queries")
        asked.join(state.select("row", "lo", "span", "width"), "row").select("row", "id", "v", "lo", "span", "width").write.parquet(folder)

        def blocks(batches: Iterator[pa.RecordBatch]):
            held, size = [], 0
            for b in small(batches, candidate_block):
                held.append(b)
                size += b.num_rows
                if size >= candidate_block:
                    yield held
                    held, size = [], 0
            if size:
                yield held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def scores():
                for held in blocks(batches):
                    by_dim: dict[int, list] = {}
                    for b in held:
                        for dim, at, rows, x in _stacked(b):
                            by_dim.setdefault(dim, []).append((rows, b.column(1).to_numpy()[at], x))
                    joined = {dim: tuple(np.concatenate(p) for p in zip(*parts)) for dim, parts in by_dim.items()}
                    for q in _query_blocks(folder, query_block):
                        for dim, at, rows, x in _stacked(q):
                            if dim in joined:
                                c_rows, c_ids, c = joined[dim]
                                bounds = [q.column(i).to_numpy()[at] for i in (3, 4, 5)]
                                yield rows, bounds, c_rows, c_ids, _scores(x, c)

            yield from task(scores())

        return candidates.mapInArrow(run, schema)

    def histogram(scores) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def emit():
            keys, n = (np.concatenate([x[i] for x in held.values()]) for i in range(2))
            of = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x[0]) for x in held.values()])
            return pa.RecordBatch.from_arrays([pa.array(of), pa.array(keys), pa.array(n)], names=["row", "bin", "n"])

        for rows, (lo, span, width), c_rows, _, s in scores:
            b = (s - lo[:, None]) // width[:, None]
            inside = (s >= lo[:, None]) & (s < (lo + span)[:, None]) & (rows[:, None] != c_rows[None, :])
            of = np.nonzero(inside)[0]
            counts = np.bincount(of * BINS + b[inside], minlength=len(rows) * BINS).reshape(len(rows), BINS)
            for r, c in zip(rows.tolist(), counts):
                at = np.flatnonzero(c)
                if len(at) and r in held:  # the next block of candidates meets the same query
                    both, n = np.concatenate([held[r][0], at]), np.concatenate([held[r][1], c[at]])
                    at, to = np.unique(both, return_inverse=True)
                    held[r] = (at, np.bincount(to, n).astype(np.int64))
                elif len(at):
                    held[r] = (at, c[at])
                    size += 1
            if size > 20_000:
                yield emit()
                held.clear()
                size = 0
        if held:
            yield emit()

    def reaching(scores) -> Iterator[pa.RecordBatch]:
        for rows, (lo, _, _), c_rows, c_ids, s in scores:
            found = []
            for i, q in enumerate(rows):
                ok = np.flatnonzero((s[i] >= lo[i]) & (c_rows != q))
                best = ok[np.lexsort((c_ids[ok], -s[i][ok]))][:k]  # a block's own best are enough: the order is total
                if len(best):
                    found.append((np.full(len(best), q), c_ids[best], s[i][best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["row", "vec_id", "score"])

    slack = 8 * k
    for _ in range(64):
        open_ = state.where("held = -1")
        if open_.isEmpty():
            break
        counts = scored(open_, histogram, "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        # at most BINS rows per query meet here
        per = counts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("down"), "n"))).alias("bins"))
        step = F.aggregate(
            "bins",
            F.struct(F.col("above").alias("above"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")),
            lambda a, x: F.when(a["above"] + a["n"] >= k, a).otherwise(F.struct((a["above"] + a["n"]).alias("above"), (-x["down"]).alias("bin"), x["n"].alias("n"))),
        )
        found = open_.join(per, "row", "left").withColumn("s", step)
        lo = F.when(F.col("s.bin").isNull() | (F.col("s.bin") < 0), F.col("lo")).otherwise(F.col("lo") + F.col("s.bin") * F.col("width"))
        few = F.col("bins").isNull() | (F.col("s.above") + F.col("s.n") < k)  # fewer than k candidates in all: every one is kept
        done = few | (F.col("width") == 1) | (F.col("s.above") + F.col("s.n") <= slack)
        moved = found.select(
            "row",
            F.when(few, F.col("lo")).otherwise(lo).alias("lo"),
            F.col("width").alias("span"),
            bins(F.col("width")).alias("width"),
            F.coalesce(F.col("s.above"), F.lit(0)).alias("above"),
            F.when(done, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("held"),
        )
        state = cut(state.join(open_.select("row"), "row", "left_anti").unionByName(moved))
    else:
        raise RuntimeError("the histograms did not converge")
    best = scored(state, reaching, "row long, vec_id long, score long")
    # at most k rows per query and block, and few blocks reach the bound
    ranked = best.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best"))
    one = ranked.select("row", F.posexplode("best").alias("at", "b")).join(asked.select("row", F.col("id").alias("query_id")), "row")
    return one.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))
