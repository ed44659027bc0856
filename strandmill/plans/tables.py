"""The driver's tables in the roles of the domain: sequences, interval calls and domain hits.

``*_SQL`` are the same tables as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import sequence as S


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, seq."""
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", S.clean(F.col("text")).alias("seq"))


SEQUENCES_SQL = f"p AS (SELECT doc_id, source, lang, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{S.RESIDUES}]', '', 'g') AS seq FROM documents)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein, method, start, end, raw_id."""
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")) + 1
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("protein"), F.col("l_returnflag").alias("method"), start.alias("start"), (start + F.col("l_quantity").cast("int") - 1).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("raw_id"))


CALLS_SQL = "calls AS (SELECT l_suppkey AS protein, l_returnflag AS method, (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + 1)::INTEGER AS s, (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::INTEGER)::INTEGER AS e, l_orderkey * 10 + l_linenumber AS raw_id FROM lineitem)"


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein, domain_id, domain_start, domain_end, i_evalue; some proteins have none."""
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) + 1
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 90).alias("protein"), F.concat(F.lit("PF"), F.col("o_orderkey") % 50).alias("domain_id"), start.alias("domain_start"), (start + (F.col("o_orderkey") % 30).cast("int")).alias("domain_end"), ((F.col("o_orderkey") % 997) / 1e6).alias("i_evalue"))


DOMAINS_SQL = "domains AS (SELECT o_custkey % 90 AS protein, 'PF' || (o_orderkey % 50) AS domain_id, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1)::INTEGER AS ds, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1 + o_orderkey % 30)::INTEGER AS de, (o_orderkey % 997) / 1e6 AS ev FROM orders)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a group, a reference flag and order totals: the rows of contrasts."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_lcr"), F.sum((F.col("o_orderkey") % 30) + 1).alias("residues"))
    size = (F.col("c_custkey") * 7919 % 1500 + 50).alias("size")
    return c.join(per, "c_custkey", "left").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", size, F.coalesce("n_lcr", F.lit(0)).alias("n_lcr"), F.coalesce("residues", F.lit(0)).alias("residues"), (F.col("c_nationkey") >= 15).alias("is_ref"))


LABELLED_SQL = "lab AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, (c_custkey * 7919 % 1500 + 50) AS size, coalesce(n, 0) AS n_lcr, coalesce(r, 0)::BIGINT AS residues, c_nationkey >= 15 AS is_ref FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_orderkey % 30 + 1) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
