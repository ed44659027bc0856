"""Token ids in packed binary files: patched frames of reference with an index of block starts.

A file holds documents in order. Their ids, end to end, are cut into blocks of ``BLOCK`` ids.
A block is its minimum, then each id less the minimum in as many bits as a stated share of the
block's ids need; ids that need more bits stand in an exception list. All integers are
little-endian.

    magic "SMPF1\\0\\0\\0", u32 block size, u64 ids, u64 documents, u64 blocks
    u64 x documents: doc ids (signed; the least 64-bit integer stands for null)
    u64 x (documents + 1): where each document's ids start
    u64 x (blocks + 1): where each block starts, from the end of this index
    blocks: u32 minimum, u8 width, u16 exceptions, packed bits (first id in the lowest bits),
            u16 x exceptions: places, u32 x exceptions: ids less the minimum

A null text is empty. Repeated and null doc ids are documents of their own, null first."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import cut, filesystem, fresh_dir, prepare, read_mapped
from strandmill.llm.bpe import MARKS, Memory, few_at_a_time

MAGIC = b"SMPF1\0\0\0"
BLOCK = 1024
#: The share of a block's ids that its width must hold; the others are exceptions.
PERCENTILE = 95
NULL_ID = -(2**63)
HEAD = struct.Struct("<8sIQQQ")


def pack_block(ids: np.ndarray) -> bytes:
    """A block of at most 65,535 ids."""
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    bits = np.frexp(rest.astype(np.float64))[1]
    width = int(np.sort(bits)[max(0, -(-len(bits) * PERCENTILE // 100) - 1)])
    over = np.flatnonzero(bits > width)
    fit = np.where(bits > width, 0, rest).astype("<u4")
    packed = np.packbits(np.unpackbits(fit.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()
    return struct.pack("<IBH", low, width, len(over)) + packed + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(data, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    low, width, over = struct.unpack_from("<IBH", data)
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 7), bitorder="little")[: n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    ids = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)
    at = np.frombuffer(data, "<u2", over, 7 + size)
    ids[at] = np.frombuffer(data, "<u4", over, 7 + size + 2 * over)
    return ids + low


class Writer:
    """Writes documents to a file as they come: only the index and an unfinished block are held."""

    def __init__(self, uri: str, block: int = BLOCK) -> None:
        self.system, self.path = filesystem(uri)
        self.block, self.docs, self.starts, self.at = block, [], [0], [0]
        self.rest = np.zeros(0, np.int64)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.body = self.system.open_output_stream(f"{self.part}.body")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        ids = np.concatenate([self.rest, ids.astype(np.int64)])
        full = len(ids) // self.block * self.block
        for i in range(0, full, self.block):
            self._put(ids[i : i + self.block])
        self.rest = ids[full:]

    def _put(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.at.append(self.at[-1] + len(data))
        self.body.write(data)

    def close(self) -> int:
        """Ends the file, under its own name only when it is whole; gives the number of ids."""
        if len(self.rest):
            self._put(self.rest)
        self.body.close()
        index = HEAD.pack(MAGIC, self.block, self.starts[-1], len(self.docs), len(self.at) - 1)
        index += b"".join(np.asarray(x, "<i8").tobytes() for x in (self.docs, self.starts, self.at))
        with self.system.open_output_stream(f"{self.part}.part") as out, self.system.open_input_stream(f"{self.part}.body") as body:
            out.write(index)
            while data := body.read(1 << 22):
                out.write(data)
        self.system.delete_file(f"{self.part}.body")
        self.system.move(f"{self.part}.part", self.path)
        return self.starts[-1]


class Reader:
    """Random access to a file's documents."""

    def __init__(self, uri: str) -> None:
        self.data = memoryview(read_mapped(uri))
        magic, self.block, self.n, docs, blocks = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        at = HEAD.size
        self.docs = np.frombuffer(self.data, "<i8", docs, at)
        self.starts = np.frombuffer(self.data, "<i8", docs + 1, at + 8 * docs)
        self.at = np.frombuffer(self.data, "<i8", blocks + 1, at + 16 * docs + 8)
        self.body = at + 16 * docs + 8 * blocks + 16
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))

    def _block(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            n = min(self.block, self.n - i * self.block)
            self.last = (i, unpack_block(self.data[self.body + int(self.at[i]) : self.body + int(self.at[i + 1])], n))
        return self.last[1]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        found = [self._block(i) for i in range(a // self.block, -(-b // self.block))] if b > a else []
        off = a // self.block * self.block
        return np.concatenate(found)[a - off : b - off] if found else np.zeros(0, np.int64)


#: Parts on the lines of one text: the library takes longer for each, alone or among very many.
LINES = 100


def library_encoder(tokenizer):
    """Encodes parts by the tokenizers library, many in one call.

    Parts without white space but a leading space stand on lines of one text: a line feed
    between them is a piece, and no part has one of its own."""
    feed = tokenizer.encode("\n", add_special_tokens=False).ids

    def alone(parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def lines(some: list[str]) -> list[bytes]:
        # without offsets, which the batch call leaves out
        texts = ["\n".join(some[a : a + LINES]) + "\n" for a in range(0, len(some), LINES)]
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]) if some else np.zeros(0, "<u4")
        ends = (4 * np.flatnonzero(ids == feed[0])).tolist()
        if len(ends) != len(some):
            raise ValueError("this tokenizer does not keep line feeds apart")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]

    def encode(parts: list[str]) -> list[bytes]:
        bare = [p[1:] if p[:1] == " " else p for p in parts]
        if len(feed) == 1 and "\n".join(bare).split() == bare:
            return [i for a in range(0, len(parts), 20_000) for i in lines(parts[a : a + 20_000])]
        plain = [i for i, q in enumerate(bare) if len(feed) == 1 and q and not any(map(str.isspace, q))]
        out = {i: ids for a in range(0, len(plain), 20_000) for i, ids in zip(plain[a : a + 20_000], lines([parts[i] for i in plain[a : a + 20_000]]))}
        others = [i for i in range(len(parts)) if i not in out]
        out.update(zip(others, alone([parts[i] for i in others])))
        return [out[i] for i in range(len(parts))]

    return encode


def cuttable(tokenizer) -> bool:
    """Whether texts may be cut at single spaces: no added token of the tokenizer holds or takes up white space."""
    return not any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in tokenizer.get_added_tokens_decoder().values())


def marks(tokenizer) -> str:
    """The marks after a word that are a piece of their own: those that no added token holds."""
    held = {c for t in tokenizer.get_added_tokens_decoder().values() for c in t.content}
    return "".join(c for c in MARKS if c not in held)


class Whole:
    """Encodes whole texts, for tokenizers whose texts may not be cut."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
            yield np.asarray(e.ids, "<u4")


_encoders: dict[str, Memory | Whole] = {}


def _encoder(tokenizer_json: str) -> Memory | Whole:
    """The worker's encoder of texts, made on first use."""
    from tokenizers import Tokenizer

    if tokenizer_json not in _encoders:
        _encoders.clear()
        tokenizer = Tokenizer.from_str(tokenizer_json)
        _encoders[tokenizer_json] = Memory(library_encoder(tokenizer), marks(tokenizer)) if cuttable(tokenizer) else Whole(tokenizer)
    return _encoders[tokenizer_json]


#: Bytes of text to a file, about: a file is one task's work.
FILE_BYTES = 16 << 20
#: Files whose sizes are summed in one task.
TOGETHER = 1000


def write_ids(docs: DataFrame, tokenizer_json: str, end_id: int, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts, an end id after each, and writes files in ascending order of the ids.

    Documents are dealt to files by id, then by a hash of the text, then by where they stand, so
    that rows of one id, or without one, may fill several files. Gives one row per file: its
    order, path, number of documents and of ids."""
    spark = prepare(docs.sparkSession)
    folder = fresh_dir(spark, "ids")
    shipped = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary: of a fixed size
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
        files = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        held = _encoder(shipped.value)
        end = np.array([end_id], "<u4")
        order = TaskContext.get().partitionId()
        path = f"{folder}/{order:06d}-{uuid.uuid4().hex}.ids"
        out, n = None, 0
        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for few in few_at_a_time(b.column(1), 4 << 20):
                for ids in held.of(few):
                    out = out or Writer(path)
                    out.add(next(doc_ids), np.concatenate([ids, end]))
                    n += 1
        if out:
            total = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([order]), pa.array([path]), pa.array([n]), pa.array([total])], names=["file", "path", "n_docs", "n_ids"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("at"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("at"))
    ordered = dealt.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return cut(ordered.select("doc_id", "text").mapInArrow(run, "file long, path string, n_docs long, n_ids long"))


def read_ids(files: DataFrame, digests: bool = False) -> DataFrame:
    """The documents of such files: doc_id, start, n_tokens and the ids, or their crc32."""
    from pyspark.sql import Window as W

    # one row per file, summed in order: within groups of files, and over groups
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = files.withColumn("group", F.floor(F.col("file") / TOGETHER))
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n_ids"), F.min("file").alias("file"))
    groups = groups.select("group", before(W.partitionBy(F.lit(0))).alias("ahead"))
    placed = grouped.withColumn("inside", before(W.partitionBy("group"))).join(groups, "group").withColumn("before", F.col("ahead") + F.col("inside"))
    n = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                file = Reader(row["path"])
                for a in range(0, len(file.docs), 2000):
                    some = range(a, min(a + 2000, len(file.docs)))
                    ids = [file.ids(k) for k in some]
                    last = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()) if digests else pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))
                    doc_ids = pa.array([None if d == NULL_ID else d for d in file.docs[a : a + 2000].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(file.starts[a : some.stop] + row["before"]), pa.array([len(i) for i in ids], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return placed.repartition(max(1, n), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))
