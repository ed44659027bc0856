"""What the operators of this subpackage share: words, session settings, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of bytes that are neither a space nor one of tab to carriage
#: return. ``bytes.split()`` without arguments cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Names the checkpoint folder; the session's settings stay as they are."""
    shared_dir(spark)
    return spark


def small(batches: Iterator, rows: int = 1000, size: int = 32 << 20) -> Iterator:
    """The same rows in batches of so many rows and bytes at most, or of one row: very long texts then fit in memory."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows <= 1 or b.num_rows <= rows and b.nbytes <= size:
                yield b
            else:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI or path without a trailing slash.

    A folder of the session's own is used only in a local session without ``spark.checkpoint.dir``, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandmill-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from reliable storage: the lineage ends here and no row is computed twice."""
    return df.checkpoint(eager=True)


def keep(df: DataFrame, what: str) -> DataFrame:
    """Like ``cut``, by a compressed table in the shared folder: for many or wide rows."""
    folder = fresh_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, with a number for each row in a column of a name that is new to it.

    Numbers that are stored are the same in every later scan."""
    name = "__row"
    while name in df.columns:
        name += "_"
    return keep(df.withColumn(name, F.monotonically_increasing_id()), what), name


def raw(column: str | Column) -> Column:
    """A text's UTF-8 bytes; null is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b""))


def filesystem(uri: str):
    """The pyarrow filesystem and the path in it; a bare path is a local one."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, data: bytes) -> None:
    """Writes a file under a passing name and renames it, so that a task that is run again leaves no half file."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(passing) as out:
        out.write(data)
    system.move(passing, path)


def read_mapped(uri: str):
    """A buffer over a whole file: memory-mapped where the folder is mounted, else read."""
    import pyarrow as pa

    system, path = filesystem(uri)
    if system.type_name == "local" and os.path.getsize(path):
        return pa.memory_map(path, "r").read_buffer()
    with system.open_input_stream(path) as f:
        return pa.py_buffer(f.read())
