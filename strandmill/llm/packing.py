"""Best-fit packing of token ids into sequences of bounded length, by minimum bin slack.

A document is its ids and an end id. One longer than a sequence is cut into pieces of a full
sequence each, but for the first, which takes what is over. Sequences are filled one by one:
each takes the longest piece that is left and, of the lengths that are left, the combination
that fills it most, found by a subset-sum over bitsets that prefers longer pieces. The
combination is taken out, and taken again for as many sequences as the lengths allow: until one
of its lengths runs out the search would find it again.

The plan needs the number of pieces of each length only, so at most ``capacity`` counts reach
the driver, whatever the number of documents. Pieces are numbered within their length over
sorted ranges, and find their sequence and offset by that number.

A null text is empty, and a document of its end id alone. Repeated rows and rows with null ids
are documents of their own. An empty table gives no pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import keep, prepare
from strandmill.llm.bpe import few_at_a_time
from strandmill.llm.packed import _encoder
from strandmill.operators.scan import numbered


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` most, from (length, number), longest first; longer ones are preferred."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length, n in available:
        left, take = min(n, room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << take * length & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths, each with the number of sequences that hold it, for so many pieces of each length."""
    left, out = dict(sorted(((k, n) for k, n in counts.items() if n), reverse=True)), []
    while left:
        longest = next(iter(left))
        rest = [(k, n - (k == longest)) for k, n in left.items() if k <= capacity - longest]
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((times, chosen))
    return out


def slots(combinations: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Where the pieces of a length stand, by their numbers: rows (length, first number, pieces a sequence, first sequence, offset), in order."""
    rows, given, sequence = [], {}, 0
    for times, chosen in combinations:
        offset = 0
        for length, m in sorted(chosen.items(), reverse=True):
            rows.append((length, given.get(length, 0), m, sequence, offset))
            given[length] = given.get(length, 0) + m * times
            offset += length * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """A row per piece: the id column, piece (from 0), start, length, and its ids or, as ``digests``, their ids_crc32."""
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary: of a fixed size
    last = "ids_crc32" if digests else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held, end = _encoder(shipped.value), np.array([end_id], "<u4")
        for b in batches:
            done = 0
            for few in few_at_a_time(b.column(1), 4 << 20):
                row, piece, start, length, value = [], [], [], [], []
                for i, ids in enumerate(held.of(few)):
                    ids = np.concatenate([ids, end])
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        row.append(done + i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        value.append(zlib.crc32(ids[a:z].astype("<u4").tobytes()) if digests else ids[a:z].astype(np.int32))
                done += len(few)
                made = pa.array(value, pa.int64() if digests else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), made], names=[id_col, "piece", "start", "length", last])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, " + ("ids_crc32 long" if digests else "ids array<int>")
    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: a sequence's pieces fill it from 0 without gaps."""
    cut = keep(pieces(docs, tokenizer_json, end_id, capacity, id_col, text_col, digests), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    table = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    columns = cut.columns
    # one row per piece: a number of 2^43 pieces of a length still leaves room for lengths of 2^20
    shift = 43

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, m, sequence, offset = table.value.T
        key = (length << shift) + first
        for b in batches:
            own, number = b.column(columns.index("length")).to_numpy(), b.column(len(columns)).to_numpy() - 1
            at = np.searchsorted(key, (own << shift) + number, side="right") - 1
            nth = number - first[at]
            where = [pa.array(sequence[at] + nth // m[at]), pa.array(offset[at] + nth % m[at] * own)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *where], names=[*columns, "sequence_id", "offset"])

    placed = numbered(cut, ["length"], [id_col, "piece", "start"], "__number").select(*(F.col(f"`{c}`") for c in columns), "__number")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return placed.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences: sequence_id, ids, and where each piece of which document starts in them.

    A sequence holds at most its capacity of ids, so a group is bounded."""
    piece = F.struct("offset", "ids", F.col(f"`{id_col}`").alias("id"), "piece")
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return held.select("sequence_id", F.flatten("pieces.ids").alias("ids"), F.transform("pieces", lambda p: F.struct(p["offset"].alias("offset"), p["id"].alias("id"), p["piece"].alias("piece"))).alias("pieces"))
