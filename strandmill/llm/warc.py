"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record;
the request and the metadata name the response by WARC-Concurrent-To. Archives are written by
Spark's text sink, whose line separator is the end of a record, so that files are committed
like any other output. They are read as bytes and cut by Content-Length. Assembling joins the
records through their identifiers and gives one nested row per capture; payloads take no part
in that join.

A null or empty payload is an empty one. Of rows with equal payloads that are long enough
exactly one is the response, the one with the largest id (null is the smallest; among rows
repeated with that id, one). Blocks of text are UTF-8."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm._common import fresh_dir, numbered, prepare

END = "\r\n"
#: The profile of revisits of identical payloads, and the date of every record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, fields map<string,string>, content binary"


def _urn(*of: Column) -> Column:
    h = F.md5(F.concat_ws("|", *of))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    """A record without the line ends after it."""
    named = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *more]
    head = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v, F.lit(END))).otherwise(F.lit("")) for n, v in named]
    return F.concat(F.lit("WARC/1.1" + END), *head, F.lit(f"Content-Type: {content_type}{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def _identified(pages: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """Columns of ``pages`` and one that knows a row in every scan: its file and place there; rows that come from no file are stored with numbers."""
    try:
        found = pages.select(*(F.col(f"`{c}`") for c in columns), F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("__place"))
        found.schema
        return found, "__place"
    except AnalysisException:
        return numbered(pages.select(*(F.col(f"`{c}`") for c in columns)), "pages")


def write_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, records_per_file: int = 3000) -> str:
    """Writes the captures of ``pages`` and gives the folder of the archives."""
    spark = prepare(pages.sparkSession)
    folder = fresh_dir(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages, row = _identified(pages, [id_col, url_col, payload_col])
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"), payload.alias("payload"), F.col(row).cast("string").alias("row"))
    base = base.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("record", _urn(F.col("row"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("digest")))
    long_enough = base.where(F.octet_length("payload") >= min_revisit)
    # one row per payload: combined before the shuffle, however many rows are equal
    first = long_enough.groupBy("digest").agg(F.max(F.struct(F.col("id"), F.col("record"))).alias("m")).select("digest", F.col("m.record").alias("original"))
    met = base.join(first, "digest", "left")
    is_revisit = F.col("original").isNotNull() & (F.col("original") != F.col("record"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"), F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    uri = F.col("url")
    main = F.when(
        is_revisit,
        _record("revisit", F.col("record"), uri, "application/http;msgtype=response", http, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.col("original")), ("WARC-Profile", F.lit(PROFILE))),
    ).otherwise(_record("response", F.col("record"), uri, "application/http;msgtype=response", http, ("WARC-Payload-Digest", digest)))
    request = _record("request", _urn(F.col("record"), F.lit("request")), uri, "application/http;msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}{END}")), ("WARC-Concurrent-To", F.col("record")))
    about = F.concat(F.when(F.col("id").isNotNull(), F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(END))).otherwise(F.lit("")), F.lit(f"fetched-by: strandmill{END}"))
    metadata = _record("metadata", _urn(F.col("record"), F.lit("metadata")), uri, "application/warc-fields", about, ("WARC-Concurrent-To", F.col("record")))
    lines = met.select(F.explode(F.array(request, main, metadata)).alias("value"))
    lines.write.option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(folder)
    return folder


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, whole files or members compressed by gzip or plain; a torn one raises."""
    import zlib

    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(rest) + d.flush())
            rest = d.unused_data.lstrip(b"\0")
        data = b"".join(parts)
    at = 0
    while at < len(data):
        split = data.find(b"\r\n\r\n", at)
        if split < 0 or not data.startswith(b"WARC/", at):
            if data[at:].strip():
                raise ValueError("not a WARC record")
            return
        head = data[at:split].decode("utf-8", "replace").split("\r\n")[1:]
        named = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in head)}
        start = split + 4
        end = start + int(named["content-length"])
        if end > len(data):
            raise ValueError("a WARC record is cut short")
        block, payload = data[start:end], None
        kind = named.get("warc-type", "")
        if kind in ("response", "revisit") and "http" in named.get("content-type", ""):
            payload = block.partition(b"\r\n\r\n")[2]
        digest = named.get("warc-payload-digest", "").rpartition(":")[2] or None
        fields = {}
        if kind == "metadata":
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()}
        yield {
            "type": kind,
            "record_id": named.get("warc-record-id"),
            "concurrent_to": named.get("warc-concurrent-to"),
            "refers_to": named.get("warc-refers-to"),
            "target_uri": named.get("warc-target-uri"),
            "payload_bytes": len(payload) if payload is not None and kind == "response" else None,
            "payload_digest": hashlib.sha1(payload).hexdigest() if payload is not None and kind == "response" else digest,
            "fields": list(fields.items()),
            "content": payload if payload is not None else block,
        }
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_records(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """The records of all archives of a folder; digests of responses are those of what was read."""
    prepare(spark)
    schema = RECORD if content else RECORD.replace(", content binary", "")
    names = [c.split()[0] for c in RECORD.split(", ")][: None if content else -1]
    kinds = {"payload_bytes": pa.int64(), "content": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for b in batches:
            for data in b.column(0):
                rows = []
                for r in parse(data.as_py()):
                    rows.append(r)
                    if len(rows) == 500:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``response`` with ``request`` and ``metadata`` nested beside it, null where missing."""
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    nested = lambda kind, *cols: F.first(F.when(F.col("type").isin(*kind), F.struct(*cols)), ignorenulls=True)
    # three records meet under one identifier
    return records.groupBy(key.alias("capture")).agg(
        nested(("response", "revisit"), "type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest").alias("response"),
        nested(("request",), "record_id", "target_uri").alias("request"),
        nested(("metadata",), "record_id", "fields").alias("metadata"),
    ).where("response IS NOT NULL")
