"""A training-data pipeline over ``documents``: stages that call the operators of ``strandmill.llm``.

Quality rules reject documents; of each group of near duplicates one stays; personal data is
replaced by its kind; sources are mixed to target weights, a document taken several times
being several rows; what is left is encoded by byte-level BPE, decoded, and reported by
digests. Near duplicates are linked by 64-bit fingerprints of five-word shingles that differ in
at most four bits; the README says how far that reaches down to a similarity of 0.8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import bpe, mixing, pii, quality, simhash
from strandmill.llm._common import keep, prepare


#: Words of a shingle, and bits in which the fingerprints of near duplicates may differ.
SHINGLE, MAX_BITS = 5, 4


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps."""
    return quality.good_only(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return simhash.one_of_each(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with ``n_chars`` as it then is."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and round in which the mix takes words of it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.token_digests(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", reject_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL has neither XXH64 nor byte-level BPE; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows, each written and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prepare(spark)
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "stage")
    return docs
