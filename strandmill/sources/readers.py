"""Readers for tabular and sequence text formats, as lazy DataFrames.

Text is cut by Spark's own readers (gzip by file name). What leaves the cluster, such as web
services and external programs, is not called: their cached outputs are read instead."""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from strandmill.functions.scalar import alnum_key, header_accession, strip_version


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, comment: str | None = None) -> DataFrame:
    """CSV or TSV, gzipped or not; all columns are strings unless a schema is given."""
    reader = spark.read.option("sep", sep).option("header", header).option("enforceSchema", True)
    if comment:
        reader = reader.option("comment", comment)
    return (reader.schema(schema) if schema else reader).csv(path)


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose separator is guessed from its first lines (tab where that fails), with or without a byte order mark."""
    lines = [r[0] for r in spark.read.text(path).limit(50).collect()]
    try:
        sep = csv.Sniffer().sniff("\n".join(lines)[:5000], delimiters=",;\t|").delimiter
    except csv.Error:
        sep = "\t"
    df = delimited(spark, path, sep=sep)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, place (of the sheet), row (from 0) and cells (strings) of .xlsx workbooks."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_sheets, "path string, sheet string, place int, row int, cells array<string>")


def workbook(spark: SparkSession, path: str, sheet: str | int | None = 0, fuzzy: bool = False) -> DataFrame:
    """A sheet of .xlsx workbooks by name or place, all of them for None (then with ``sheet``); columns are strings named by the first row.

    ``fuzzy`` takes the first sheet whose name has the same letters and digits, whatever their case."""
    rows = sheet_rows(spark, path)
    if isinstance(sheet, str) and fuzzy:
        key = re.sub("[^a-z0-9]+", "", sheet.lower())
        rows = rows.where(alnum_key(F.col("sheet")) == key)
        first = rows.agg(F.min("place")).first()[0]
        rows = rows.where(F.col("place") == first)
    elif sheet is not None:
        rows = rows.where(F.col("sheet") == sheet if isinstance(sheet, str) else F.col("place") == sheet)
    head = rows.where("row = 0").orderBy("path", "place").select("cells").first()
    if head is None:
        raise ValueError(f"no such sheet in {path}")
    named = [F.get("cells", F.lit(i)).alias(n or f"column{i + 1}") for i, n in enumerate(head[0])]
    return rows.where("row > 0").select(*(["sheet"] if sheet is None else []), *named)


def _sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            z = zipfile.ZipFile(BytesIO(content))
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for place, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns)):
                target = targets[s.get(rel)].lstrip("/")
                out = []
                for k, row in enumerate(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).findall("m:sheetData/m:row", ns)):
                    cells: list[str | None] = []
                    for c in row.findall("m:c", ns):
                        letters = re.match("[A-Z]+", c.get("r") or "")
                        at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                        cells.extend([None] * (at - len(cells)))
                        value = c.find("m:v", ns)
                        text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) or None
                        cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                    out.append((path, s.get("name"), place, k, cells))
                yield pd.DataFrame(out, columns=["path", "sheet", "place", "row", "cells"])


def fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """header, accession and sequence (case kept) of each record; strict reading fails on a file whose first line is no header."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    if strict:
        first = spark.read.text(path, wholetext=True).where(~F.ltrim("value").rlike("^\ufeff?>"))
        if not first.isEmpty():
            raise ValueError(f"{path}: a file is empty or has a sequence before any header")
    record = F.regexp_replace("value", "^\ufeff?>", "")
    header = F.trim(F.regexp_extract(record, r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s", "")
    return records.select(header.alias("header"), header_accession(header).alias("accession"), seq.alias("sequence"))


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _masked(sequences: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else [{"start": m.start() + 1, "end": m.end()} for m in re.finditer("[a-z]+", s)] for s in sequences], dtype=object)


def masked_intervals(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """``df`` with a row per longest run of lower-case letters: start, end (1-based, inclusive) and length."""
    runs = df.withColumn("__i", F.explode(_masked(sequence)))
    return runs.withColumns({"start": F.col("__i.start"), "end": F.col("__i.end"), "length": F.col("__i.end") - F.col("__i.start") + 1}).drop("__i")


def header_fields(df: DataFrame, pattern: str, names: list[str], header: str = "header") -> DataFrame:
    """``df`` with the groups of a regular expression as columns; null where it does not match."""
    hit = F.col(header).rlike(pattern)
    return df.withColumns({n: F.when(hit, F.regexp_extract(header, pattern, i + 1)) for i, n in enumerate(names)})


#: The fields of a domain table's line, in their order.
_DOMTBL = "target_name accession tlen query_name query_accession qlen full_evalue full_score full_bias n of c_evalue i_evalue score bias hmm_from hmm_to ali_from ali_to env_from env_to acc description"


def domtblout(spark: SparkSession, path: str, short: str = "fail") -> DataFrame:
    """A domain table: comments are left out; a line without a description fails, is padded or is skipped."""
    names = _DOMTBL.split()
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select(F.split(F.trim("value"), r"\s+", len(names)).alias("p"))
    n = F.size("p")
    if short == "skip":
        parts = parts.where(n == len(names))
    elif short == "pad":
        parts = parts.where(n >= len(names) - 1)
    else:
        parts = parts.where(F.when(n < len(names), F.raise_error(F.lit("a domain line has too few fields"))).otherwise(F.lit(True)))
    kinds = {c: "int" for c in "tlen qlen n of hmm_from hmm_to ali_from ali_to env_from env_to".split()} | {c: "double" for c in "full_evalue full_score full_bias c_evalue i_evalue score bias acc".split()}
    return parts.select(*(F.try_element_at("p", F.lit(i + 1)).try_cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(names)))


def gtf(spark: SparkSession, path: str, feature: str = "transcript", attributes: tuple[str, ...] = ("gene_id", "transcript_id", "protein_id", "gene_name", "transcript_biotype")) -> DataFrame:
    """Lines of a feature with named attributes, the list of tags, and the two flags of canonical transcripts."""
    raw = delimited(spark, path, "seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attribute string", sep="\t", header=False, comment="#")
    value = lambda a: F.nullif(F.regexp_extract("attribute", rf'\b{a} "([^"]*)"', 1), F.lit(""))
    rows = raw.withColumn("attribute", F.regexp_replace("attribute", r'\\"', '"')).where(F.col("feature") == feature)
    tags = F.regexp_extract_all("attribute", F.lit(r'\btag "([^"]*)"'), F.lit(1))
    return rows.select("seqname", "start", "end", "strand", *(value(a).alias(a) for a in attributes), tags.alias("tags"), F.array_contains(tags, "MANE_Select").alias("is_mane"), F.array_contains(tags, "Ensembl_canonical").alias("is_canonical"))


def stockholm(spark: SparkSession, path: str, fields: tuple[str, ...] = ("ID", "AC", "DE")) -> DataFrame:
    """Records that end with //, a column per #=GF field; accessions lose their version."""
    records = spark.read.option("lineSep", "//\n").text(path).where(F.col("value").contains("#=GF"))
    value = lambda f: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^#=GF\s+{f}\s+(.*)$", 1)), F.lit(""))
    out = records.select(*(value(f).alias(f.lower()) for f in fields))
    return out.withColumn("ac", strip_version(F.regexp_replace("ac", ";$", ""))) if "AC" in fields else out


def hmm_versions(spark: SparkSession, path: str) -> DataFrame:
    """accession and versioned, from the ACC lines of profile files."""
    lines = spark.read.text(path).where(F.col("value").startswith("ACC "))
    acc = F.trim(F.substring("value", 4, 1000))
    return lines.select(strip_version(acc).alias("accession"), acc.alias("versioned"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Nested results of a detector service, one JSON object per line: a row per protein, method and region."""
    schema = "protein_id string, results array<struct<method:string, regions:array<struct<start:int, end:int, description:string>>>>"
    rows = spark.read.schema(schema).json(path)
    r = rows.select("protein_id", F.explode("results").alias("r"))
    return r.select("protein_id", "r.method", F.explode("r.regions").alias("g")).select("protein_id", "method", "g.start", "g.end", "g.description")


def under(spark: SparkSession, folder: str, kind: str = "parquet", glob: str | None = None, **options) -> DataFrame:
    """Every file below a folder, with ``file``, its path."""
    reader = spark.read.option("recursiveFileLookup", True).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(kind).load(folder).withColumn("file", F.col("_metadata.file_path"))


def through_program(df: DataFrame, column: str, run, schema: str) -> DataFrame:
    """Rows that an external tool gives: ``run`` gets a list of strings and gives a pandas frame, once per Arrow batch."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield run(b[column].tolist())

    return df.select(column).mapInPandas(batches, schema)


def external(df: DataFrame, column: str, command: list[str], seconds: float = 3600, tries: int = 2, rows: int = 10_000) -> DataFrame:
    """The lines (``value``) that a program writes when it reads the lines of ``column``, a process per ``rows`` of a partition.

    A process that ends with another status than 0 or takes longer than ``seconds`` is tried again,
    ``tries`` times in all; then the task fails with the command, the status, the end of its
    error output and the first line that it was given, so that Spark may run it elsewhere. Lines
    of a failed try are dropped. Null and empty lines are not sent; the input may hold no line ends."""
    import subprocess

    def ask(lines: list[str]) -> list[str]:
        why = ""
        for _ in range(tries):
            try:
                done = subprocess.run(command, input="".join(f"{x}\n" for x in lines), capture_output=True, text=True, timeout=seconds)
            except subprocess.TimeoutExpired:
                why = f"no end within {seconds} s"
                continue
            if done.returncode == 0:
                return done.stdout.splitlines()
            why = f"status {done.returncode}: {done.stderr[-500:].strip()}"
        raise RuntimeError(f"{' '.join(command)} failed on {len(lines)} lines from {lines[0][:100]!r}: {why}")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            lines = [x for x in b["line"] if x]
            if bad := next((x for x in lines if "\n" in x), None):
                raise ValueError(f"a line end in {bad[:100]!r}")
            for a in range(0, len(lines), rows):
                yield pd.DataFrame({"value": pd.Series(ask(lines[a : a + rows]), dtype=object)})

    return df.select(F.col(column).cast("string").alias("line")).mapInPandas(batches, "value string")


def reuse(spark: SparkSession, folder: str, build) -> DataFrame:
    """The table in ``folder``, made by ``build()`` and written where it is missing or unfinished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
