"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import io
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandmill-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once and read back: lineage ends here, and no later job computes them again."""
    folder = fresh(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def put(uri: str, **arrays) -> None:
    """Stores arrays as one file of the shared folder; a task that is run again leaves no half file."""
    import numpy as np

    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    data, passing = io.BytesIO(), f"{path}.{uuid.uuid4().hex}.part"
    np.savez(data, **arrays)
    with system.open_output_stream(passing) as out:
        out.write(data.getbuffer())
    system.move(passing, path)


def get(uri: str) -> dict:
    """The arrays of such a file."""
    import numpy as np

    system, path = _filesystem(uri)
    with system.open_input_stream(path) as f:
        return dict(np.load(io.BytesIO(f.read())))
