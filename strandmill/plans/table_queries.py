"""Queries of table shaping, class summaries and blocks per stratum, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import stats as T
from strandmill.operators import tables as B
from strandmill.plans.registry import query
from strandmill.plans.tables import LABELLED_SQL, labelled, read

six = lambda c: F.round(c, 6)


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS gene, s_acctbal AS balance FROM supplier")
def reindex_columns(spark, d):
    return B.reindex(read(spark, d, "supplier"), {"id": "long", "name": "string", "gene": "string", "balance": "double"}, {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE 'UNMAPPED_' || p_partkey END AS k FROM part")
def placeholder_keys(spark, d):
    key = F.when(F.col("p_size") > 40, F.col("p_brand")).when(F.col("p_size") > 25, F.col("p_brand")).when(F.col("p_size") > 10, " ")
    return read(spark, d, "part").select("p_partkey", B.placeholder_key(key, F.col("p_partkey")).alias("k"))


@query("WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount / 50 AS e, (l_quantity::INT - 5 + 1) / 50 AS cov FROM lineitem) SELECT l_orderkey, l_linenumber, round(cov, 6) AS coverage FROM h WHERE e <= 0.001 AND cov >= 0.3 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def domain_retention(spark, d):
    """Hits of a kept set, by E-value and the share of the model that they span."""
    h = read(spark, d, "lineitem").withColumn("cov", B.hmm_coverage(F.lit(5), F.col("l_quantity").cast("int"), F.lit(50)))
    keep = read(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return B.retained(h, keep, "l_partkey", F.col("l_discount") / 50, F.col("cov")).select("l_orderkey", "l_linenumber", six(F.col("cov")).alias("coverage"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.05 AND l_tax < 0.05")
def dual_cutoff(spark, d):
    return B.both_below(read(spark, d, "lineitem"), F.col("l_discount"), F.col("l_tax"), 0.05).select("l_orderkey", "l_linenumber")


@query("WITH a AS (SELECT o_orderpriority AS k, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders), b AS (SELECT o_orderpriority AS k, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT k, place, o_orderkey, o_custkey FROM a JOIN b USING (k, place)")
def positional_pairs(spark, d):
    """Two orders of the same rows, paired by place within each block."""
    o = read(spark, d, "orders").withColumnRenamed("o_orderpriority", "k")
    return B.paired(o.select("k", "o_orderkey"), o.select("k", "o_custkey", "o_totalprice", F.col("o_orderkey").alias("tie")), ["k"], [F.col("o_orderkey")], [("o_totalprice", "desc"), "tie"]).select("k", "place", "o_orderkey", "o_custkey")


_FLAGS = {"urgent": "1-URGENT", "high": "2-HIGH", "low": "5-LOW"}
_ITEMS = "i AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey % 30 + 1 AS n, o_orderkey % 97 AS x FROM orders)"


def _matrix(spark, d, weighted):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 7919 % 1500 + 50).alias("size"))
    i = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", (F.col("o_orderkey") % 30 + 1).alias("n"), (F.col("o_orderkey") % 97).alias("x"))
    return B.feature_matrix(c, i, "k", {f: F.col("o_orderpriority") == v for f, v in _FLAGS.items()}, "n", "size", weighted)


_PRESENT = ", ".join(f"coalesce(max((p = '{v}')::INT), 0)::INTEGER AS {k}" for k, v in _FLAGS.items())


@query(f"WITH {_ITEMS} SELECT c_custkey AS k, {_PRESENT}, count(n) AS n_items, CASE WHEN count(n) > 2 THEN '3+' ELSE count(n)::VARCHAR END AS multiplicity, round(coalesce(sum(n) / any_value(c_custkey * 7919 % 1500 + 50), 0), 6) AS coverage FROM customer LEFT JOIN i ON k = c_custkey GROUP BY 1")
def feature_matrix_all(spark, d):
    """Presences, multiplicity and coverage of every entity."""
    return _matrix(spark, d, []).drop("mean_length").withColumn("coverage", six(F.col("coverage")))


@query(f"WITH {_ITEMS} SELECT k, {_PRESENT}, count(*) AS n_items, round(avg(n), 6) AS mean_length, round(sum(n) / any_value(k * 7919 % 1500 + 50), 6) AS coverage, round(sum(x * n) / sum(n), 6) AS x FROM i JOIN customer ON k = c_custkey GROUP BY 1")
def feature_matrix_carriers(spark, d):
    """The same of carriers, with a mean weighted by length."""
    m = _matrix(spark, d, ["x"]).where("n_items > 0").drop("multiplicity")
    return m.withColumns({"mean_length": six(F.col("mean_length")), "coverage": six(F.col("coverage")), "x": six(F.col("x"))})


@query("SELECT 'rows' AS item, count(*) AS value FROM orders UNION ALL SELECT 'entities', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 'class ' || o_orderpriority, count(DISTINCT o_custkey) FROM orders GROUP BY o_orderpriority")
def qc_overview(spark, d):
    return B.overview(read(spark, d, "orders"), "o_custkey", "o_orderpriority", {"open": F.col("o_orderstatus") == "O"})


_OR = "CASE WHEN a > 0 AND c > 0 THEN round(log2(((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))), 6) END"


@query(f"WITH {LABELLED_SQL}, ed AS (SELECT list_distinct(quantile_cont(size, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS ed FROM lab WHERE is_ref), x AS (SELECT lab.*, CASE WHEN size >= list_min(ed) AND size <= list_max(ed) THEN greatest(1, len(list_filter(ed, lambda x: x < size)))::INTEGER END AS bin FROM lab, ed), r AS (SELECT bin, count(*) FILTER (WHERE is_ref AND n_lcr > 9) AS c, count(*) FILTER (WHERE is_ref AND n_lcr <= 9) AS d FROM x WHERE bin IS NOT NULL GROUP BY 1), q AS (SELECT c_mktsegment AS g, bin, count(*) FILTER (WHERE n_lcr > 9) AS a, count(*) FILTER (WHERE n_lcr <= 9) AS b FROM x WHERE bin IS NOT NULL GROUP BY 1, 2) SELECT g, bin AS length_bin, a AS n_pos_group, c AS n_pos_ref, {_OR} AS log2_or FROM q JOIN r USING (bin)")
def stratified_incidence(spark, d):
    """Each group's carriers against the reference's within every length bin."""
    b = T.length_bins(labelled(spark, d), "size", F.col("is_ref")).where("length_bin IS NOT NULL")
    carrier = F.col("n_lcr") > 9
    t = T.compare_binary(T.against_reference_by(b, "length_bin", "c_mktsegment", carrier, F.col("is_ref")), "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref")
    return t.select(F.col("c_mktsegment").alias("g"), "length_bin", "n_pos_group", "n_pos_ref", six(F.col("log2_or")).alias("log2_or"))
