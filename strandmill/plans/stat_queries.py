"""Queries of the statistics and clusterings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import rules as R
from strandmill.functions import scalar as X
from strandmill.functions import sequence as S
from strandmill.operators import cluster as C
from strandmill.operators import distances as D
from strandmill.operators import stats as T
from strandmill.plans.registry import query
from strandmill.plans.sequence_queries import n_sql
from strandmill.plans.tables import LABELLED_SQL, SEQUENCES_SQL, labelled, read, sequences

six = lambda c: F.round(c, 6)


def chi2_sql(x: str, k: str) -> str:
    """The survival function of the chi-square distribution, by the series of the lower gamma function."""
    return f"CASE WHEN {x} <= 0 THEN 1 WHEN {x} > 1400 THEN 0 ELSE greatest(0, 1 - (SELECT sum(exp(({k}) / 2.0 * ln({x} / 2.0) - {x} / 2.0 + n * ln({x} / 2.0) - lgamma(({k}) / 2.0 + n + 1))) FROM range(2000) t(n))) END"


n_rows = lambda: F.count(F.lit(1))

_OR = "log2(((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)))"
_FISHER = """(SELECT least(1, sum(exp(lp))) FROM (SELECT lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp,
lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS l0
FROM (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k)) WHERE lp <= l0 + 1e-7)"""
#: One row per cell of group by value, as counts a, b, c, d against the other groups.
_REST = """WITH n AS (SELECT g, v, count(*) AS a FROM {src} GROUP BY ALL), cells AS (SELECT * FROM (SELECT DISTINCT g FROM n), (SELECT DISTINCT v FROM n)),
m AS (SELECT g, v, coalesce(a, 0) AS a FROM cells LEFT JOIN n USING (g, v)), t AS (SELECT g, v, a, sum(a) OVER (PARTITION BY g)::BIGINT AS tg, sum(a) OVER (PARTITION BY v)::BIGINT AS tv, sum(a) OVER ()::BIGINT AS al FROM m),
q AS (SELECT g, v, a, tg - a AS b, tv - a AS c, al - tg - tv + a AS d FROM t)"""
_SRC = "(SELECT c_mktsegment AS g, o_orderpriority AS v FROM customer JOIN orders ON c_custkey = o_custkey)"


def _cells(spark, d):
    j = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return T.one_vs_rest(j, "c_mktsegment", "o_orderpriority").withColumnsRenamed({"c_mktsegment": "g", "o_orderpriority": "v"})


@query(_REST.format(src=_SRC) + " SELECT g, v, a AS n_pos_group, a + b AS n_tot_group, c AS n_pos_ref, c + d AS n_tot_ref FROM q")
def one_vs_rest(spark, d):
    return _cells(spark, d)


@query(_REST.format(src=_SRC) + f" SELECT g, v, CASE WHEN a > 0 AND c > 0 THEN round({_OR}, 6) END AS log2_or, least(a, b, c, d) < 5 AS descriptive_only FROM q")
def haldane_or(spark, d):
    return T.compare_binary(_cells(spark, d), "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref").select("g", "v", six(F.col("log2_or")).alias("log2_or"), "descriptive_only")


@query(_REST.format(src=_SRC) + f" SELECT g, v, round({_FISHER}, 6) AS p_value FROM q")
def fisher_exact(spark, d):
    return T.compare_binary(_cells(spark, d), "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref").select("g", "v", six(F.col("p_value")).alias("p_value"))


@query(_REST.format(src=_SRC) + f", p AS (SELECT g, v, {_FISHER} AS p FROM q), r AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p) AS x FROM p) SELECT g, v, round(least(1, min(x) OVER (PARTITION BY g ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_fdr FROM r")
def bh_fdr(spark, d):
    t = T.compare_binary(_cells(spark, d), "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref")
    return T.benjamini_hochberg(t, ["g"]).select("g", "v", six(F.col("p_fdr")).alias("p_fdr"))


@query(_REST.format(src="(SELECT c_mktsegment AS g, o_orderpriority AS v, unnest(range(o_orderkey % 5)) FROM customer JOIN orders ON c_custkey = o_custkey)") + " SELECT g, v, a AS n_pos_group, a + b AS n_tot_group, c AS n_pos_ref, c + d AS n_tot_ref FROM q")
def residue_basis(spark, d):
    j = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).where("o_orderkey % 5 > 0")
    return T.one_vs_rest(j, "c_mktsegment", "o_orderpriority", F.col("o_orderkey") % 5).withColumnsRenamed({"c_mktsegment": "g", "o_orderpriority": "v"})


@query(_REST.format(src=_SRC) + " SELECT g, v, round(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), 6) AS log_or, round(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) - 1.96 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)), 6) AS low, round(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) + 1.96 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)), 6) AS high FROM q")
def or_confidence(spark, d):
    a, c = F.col("n_pos_group"), F.col("n_pos_ref")
    lo, low, high = T.odds_ratio_interval(a, F.col("n_tot_group") - a, c, F.col("n_tot_ref") - c)
    return _cells(spark, d).select("g", "v", six(lo).alias("log_or"), six(low).alias("low"), six(high).alias("high"))


_INC = f"WITH {LABELLED_SQL}, r AS (SELECT count(*) FILTER (WHERE n_lcr > 9) AS rp, count(*) AS rt FROM lab WHERE is_ref), q AS (SELECT c_mktsegment AS g, count(*) FILTER (WHERE n_lcr > 9) AS a, count(*) FILTER (WHERE n_lcr <= 9) AS b, any_value(rp) AS c, any_value(rt - rp) AS d FROM lab, r GROUP BY 1)"


@query(_INC + f" SELECT g, a AS n_pos_group, round(a / (a + b), 6) AS rate_group, round(c / (c + d), 6) AS rate_ref, CASE WHEN a > 0 AND c > 0 THEN round({_OR}, 6) END AS log2_or, round({_FISHER}, 6) AS p_value, least(a, b, c, d) < 5 AS descriptive_only FROM q")
def incidence(spark, d):
    got = T.against_reference(labelled(spark, d), "c_mktsegment", F.col("n_lcr") > 9, F.col("is_ref"))
    t = T.compare_binary(got, "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref")
    return t.select(F.col("c_mktsegment").alias("g"), "n_pos_group", *(six(F.col(c)).alias(c) for c in ("rate_group", "rate_ref", "log2_or", "p_value")), "descriptive_only")


@query(f"WITH {LABELLED_SQL}, ed AS (SELECT list_distinct(quantile_cont(size, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS ed FROM lab WHERE is_ref), b AS (SELECT lab.*, CASE WHEN size >= list_min(ed) AND size <= list_max(ed) THEN greatest(1, len(list_filter(ed, lambda x: x < size)))::INTEGER END AS bin FROM lab, ed) SELECT c_mktsegment AS g, bin AS length_bin, count(*) AS n, count(*) FILTER (WHERE n_lcr > 9) AS n_pos FROM b WHERE bin IS NOT NULL GROUP BY 1, 2")
def incidence_by_quintile(spark, d):
    b = T.length_bins(labelled(spark, d), "size", F.col("is_ref")).where("length_bin IS NOT NULL")
    return b.groupBy(F.col("c_mktsegment").alias("g"), "length_bin").agg(n_rows().alias("n"), F.count_if(F.col("n_lcr") > 9).alias("n_pos"))


_U = """, m AS (SELECT * FROM (SELECT c_mktsegment AS g, is_ref, unnest(['acctbal', 'n_lcr', 'residues']) AS metric, unnest([c_acctbal, n_lcr, residues]) AS v FROM lab)),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2 AS rk FROM m),
s AS (SELECT metric, count(*) FILTER (WHERE NOT is_ref) AS n_group, count(*) FILTER (WHERE is_ref) AS n_ref, median(v) FILTER (WHERE NOT is_ref) AS med, avg(v) FILTER (WHERE is_ref) AS mean_ref, stddev_samp(v) FILTER (WHERE NOT is_ref) AS sd, sum(rk) FILTER (WHERE NOT is_ref) AS r FROM k GROUP BY 1)"""


def _metrics(spark, d):
    lab = labelled(spark, d).select("is_ref", F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("acctbal"), F.col("n_lcr").cast("double").alias("n_lcr"), F.col("residues").cast("double").alias("residues"))
    return lab.unpivot(["g", "is_ref"], ["acctbal", "n_lcr", "residues"], "metric", "v")


@query(f"WITH {LABELLED_SQL}{_U} SELECT metric, n_group, n_ref, round(med, 6) AS median_group, round(mean_ref, 6) AS mean_ref, round(sd, 6) AS sd_group, round(2 * (r - n_group * (n_group + 1) / 2) / (n_group * n_ref) - 1, 6) AS cliffs_delta FROM s")
def cliffs_delta(spark, d):
    t = T.compare_continuous(_metrics(spark, d), ["metric"], "v", ~F.col("is_ref"), F.col("is_ref"))
    return t.select("metric", "n_group", "n_ref", *(six(F.col(c)).alias(c) for c in ("median_group", "mean_ref", "sd_group", "cliffs_delta")))


#: Arms of more than eight, so that no test is exact: p is the chi-square's of one degree, of the squared normal deviate.
_MW = f"""WITH {LABELLED_SQL}, m AS (SELECT * FROM (SELECT c_mktsegment AS g, is_ref, unnest(['acctbal', 'n_lcr', 'residues']) AS metric, unnest([c_acctbal, n_lcr, residues]) AS v FROM lab)),
k AS (SELECT *, rank() OVER (PARTITION BY metric, g ORDER BY v) + (count(*) OVER (PARTITION BY metric, g, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY metric, g, v) AS t FROM m),
s AS (SELECT metric, g, count(*) FILTER (WHERE NOT is_ref)::DOUBLE AS a, count(*) FILTER (WHERE is_ref)::DOUBLE AS b, sum(rk) FILTER (WHERE NOT is_ref) AS r, sum(t::DOUBLE * t - 1) AS t FROM k GROUP BY ALL),
z AS (SELECT metric, g, r - a * (a + 1) / 2 AS u, (greatest(r - a * (a + 1) / 2, a * b - r + a * (a + 1) / 2) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))) AS z FROM s),
p AS (SELECT metric, g, u, CASE WHEN z <= 0 THEN 1 ELSE {chi2_sql("(z * z)", "1")} END AS p FROM z), f AS (SELECT *, p * count(*) OVER (PARTITION BY metric) / row_number() OVER (PARTITION BY metric ORDER BY p) AS x FROM p)
SELECT metric, g, u, round(p, 6) AS p_value, round(least(1, min(x) OVER (PARTITION BY metric ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_fdr FROM f"""


@query(_MW)
def mann_whitney(spark, d):
    """The two-sided p values of the same contrasts, per metric and segment."""
    t = T.compare_continuous(_metrics(spark, d), ["metric", "g"], "v", ~F.col("is_ref"), F.col("is_ref"))
    return T.benjamini_hochberg(t, ["metric"]).select("metric", "g", "u", six(F.col("p_value")).alias("p_value"), six(F.col("p_fdr")).alias("p_fdr"))


@query(f"""WITH {LABELLED_SQL}, k AS (SELECT c_mktsegment AS g, c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rk, count(*) OVER (PARTITION BY c_acctbal) AS t FROM lab),
s AS (SELECT g, sum(rk) AS r, count(*) AS m, sum(t::DOUBLE * t - 1) AS t FROM k GROUP BY 1), q AS (SELECT sum(r * r / m) AS s, sum(m)::DOUBLE AS n, sum(t) AS t, count(*) AS k FROM s)
SELECT n::BIGINT AS n, k AS n_groups, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h FROM q""")
def kruskal_h(spark, d):
    return T.kruskal(labelled(spark, d).withColumn("one", F.lit(1)), ["one"], "c_acctbal", "c_mktsegment").select("n", "n_groups", six(F.col("h")).alias("h"))


@query(f"""WITH {LABELLED_SQL}, k AS (SELECT c_mktsegment AS g, c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rk, count(*) OVER (PARTITION BY c_acctbal) AS t FROM lab),
s AS (SELECT g, sum(rk) AS r, count(*) AS m, sum(t::DOUBLE * t - 1) AS t FROM k GROUP BY 1), q AS (SELECT sum(r * r / m) AS s, sum(m)::DOUBLE AS n, sum(t) AS t, count(*) AS k FROM s),
h AS (SELECT n, k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM q)
SELECT n::BIGINT AS n, round({chi2_sql("h", "k - 1")}, 6) AS p_value, round(h / (n - 1), 6) AS epsilon_squared FROM h""")
def kruskal_p(spark, d):
    """The omnibus test's p value."""
    t = T.kruskal(labelled(spark, d).withColumn("one", F.lit(1)), ["one"], "c_acctbal", "c_mktsegment")
    return t.select("n", six(T.chi2_p(F.col("h"), F.col("n_groups") - 1)).alias("p_value"), six(F.col("epsilon_squared")).alias("epsilon_squared"))


_TAB = "WITH n AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT r, c, n, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS al FROM n)"


@query(_TAB + " SELECT r, c, n, round(n / nr, 6) AS row_share, round(n / nc, 6) AS column_share FROM t")
def crosstab_norm(spark, d):
    t = T.crosstab(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return t.select(F.col("o_orderpriority").alias("r"), F.col("o_orderstatus").alias("c"), "n", six(F.col("row_share")).alias("row_share"), six(F.col("column_share")).alias("column_share"))


@query(_TAB + " SELECT r, c, round(nr * nc / al, 6) AS expected, round(log2(n / (nr * nc / al)), 6) AS log2_oe, n < 5 AS sparse FROM t")
def obs_expected(spark, d):
    t = T.crosstab(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return t.select(F.col("o_orderpriority").alias("r"), F.col("o_orderstatus").alias("c"), six(F.col("expected")).alias("expected"), six(F.col("log2_oe")).alias("log2_oe"), (F.col("n") < 5).alias("sparse"))


@query("WITH n AS (SELECT l_returnflag AS m, l_linestatus AS p, (l_partkey % 6)::INT AS c, count(*) AS observed_n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(observed_n) OVER (PARTITION BY m, p) AS class_n, sum(observed_n) OVER (PARTITION BY m, c) AS sn, sum(observed_n) OVER (PARTITION BY m) AS mn FROM n) SELECT m, p, c, observed_n, class_n::BIGINT AS class_n, round((observed_n / class_n) / (sn / mn), 6) AS fold, round(log2((observed_n / class_n) / (sn / mn)), 6) AS log2_fold FROM w WHERE observed_n >= 10 AND class_n >= 30")
def fold_enrichment(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("p"), (F.col("l_partkey") % 6).cast("int").alias("c"))
    f = T.fold_enrichment(li, "m", "p", "c").where("observed_n >= 10 AND class_n >= 30")
    return f.select("m", "p", "c", "observed_n", "class_n", six(F.col("fold")).alias("fold"), six(F.col("log2_fold")).alias("log2_fold"))


@query("WITH n AS (SELECT c_mktsegment AS cls, (c_nationkey % 5)::INT AS cluster, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY cls) AS f FROM n) SELECT cls, arg_min(cluster, {'a': -n, 'b': cluster}) AS dominant, round(max(f), 6) AS share, string_agg(cluster::VARCHAR, ';' ORDER BY cluster) FILTER (WHERE f >= 0.05) AS represented FROM s GROUP BY 1")
def class_distribution(spark, d):
    t = T.crosstab(read(spark, d, "customer").select(F.col("c_mktsegment").alias("cls"), (F.col("c_nationkey") % 5).cast("int").alias("cluster")), "cls", "cluster")
    some = F.array_sort(F.collect_list(F.when(F.col("row_share") >= 0.05, F.col("cluster"))))
    return t.groupBy("cls").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("dominant"), six(F.max("row_share")).alias("share"), F.array_join(some, ";").alias("represented"))


@query("WITH i AS (SELECT c_custkey AS k, (c_custkey * 37 % 101) / 1000 AS f1, c_custkey % 7 - 3 AS l1, CASE WHEN c_custkey % 11 > 0 THEN (c_custkey * 53 % 103) / 1000 END AS f2, c_custkey % 5 - 2 AS l2, c_custkey % 9 AS n FROM customer) SELECT k, CASE WHEN f2 IS NULL OR n < 5 THEN 'external_underpowered' WHEN f1 < 0.05 AND l1 > 0 AND f2 < 0.05 AND l2 > 0 THEN 'externally_validated' WHEN f1 < 0.05 AND l1 > 0 AND f2 >= 0.05 THEN 'rbp_generic' WHEN f1 < 0.05 AND l1 > 0 AND l2 < 0 THEN 'internal_only_artifact' WHEN NOT (f1 < 0.05 AND l1 > 0) AND f2 < 0.05 AND l2 > 0 THEN 'new_external_signal' WHEN f1 < 0.05 AND l1 < 0 AND f2 < 0.05 AND l2 < 0 THEN 'validated_depletion' ELSE 'concordant_null' END AS verdict FROM i")
def validation_grid(spark, d):
    k = F.col("c_custkey")
    v = R.validation_verdict((k * 37 % 101) / 1000, k % 7 - 3, F.when(k % 11 > 0, (k * 53 % 103) / 1000), k % 5 - 2, k % 9)
    return read(spark, d, "customer").select(k.alias("k"), v.alias("verdict"))


@query("WITH n AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ab, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM n GROUP BY a)) AS ra, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM n GROUP BY b)) AS rb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM n) AS al) SELECT round((ab - ra * rb / al) / ((ra + rb) / 2 - ra * rb / al), 6) AS ari FROM x")
def adjusted_rand(spark, d):
    c = read(spark, d, "customer").withColumn("b", F.col("c_nationkey") % 5)
    return T.adjusted_rand(c, "c_mktsegment", "b").select(six(F.col("ari")).alias("ari"))


@query("WITH s AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, round((p_retailprice - b) / CASE WHEN c = a THEN 1 ELSE c - a END, 6) AS price FROM part, s")
def robust_scale(spark, d):
    p = C.robust_scale(read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), ["price"])
    return p.select("p_partkey", six(F.col("price")).alias("price"))


_GOWER = "WITH s AS (SELECT *, (s_suppkey % 2)::INT AS b FROM supplier), m AS (SELECT max(s_acctbal) - min(s_acctbal) AS r FROM s), g AS (SELECT x.s_suppkey AS i, y.s_suppkey AS j, ((x.b <> y.b)::INT + (x.s_nationkey <> y.s_nationkey)::INT + abs(x.s_acctbal - y.s_acctbal) / r) / 3 AS dist FROM s x JOIN s y ON x.s_suppkey < y.s_suppkey, m)"


def _gower(spark, d):
    s = read(spark, d, "supplier").withColumn("b", F.col("s_suppkey") % 2)
    return C.gower(s, "s_suppkey", ["b"], ["s_nationkey"], ["s_acctbal"])


@query(_GOWER + " SELECT i, j, round(dist, 6) AS distance FROM g")
def gower_distance(spark, d):
    return _gower(spark, d).withColumn("distance", six(F.col("distance")))


@query(_GOWER + ", b AS (SELECT i, j, dist FROM g UNION ALL SELECT j, i, dist FROM g), t AS (SELECT i % 4 AS c, i, sum(dist) AS t, count(*) AS n FROM b WHERE i % 4 = j % 4 GROUP BY ALL) SELECT c, arg_min(i, {'a': round(t, 9), 'b': i}) AS medoid, round(min(t) / any_value(n), 6) AS mean_distance, count(*) AS size FROM t GROUP BY 1")
def medoids(spark, d):
    """The members of clusters that are nearest to the others, without pairs."""
    s = read(spark, d, "supplier").withColumns({"b": F.col("s_suppkey") % 2, "c": F.col("s_suppkey") % 4})
    scaled, weights = D.gower_scaled(s, [], ["b"], ["s_acctbal"], ["s_nationkey"])
    found = D.medoids(D.sums(scaled, [], "s_suppkey", "c", ["b", "s_acctbal"], weights), [], "s_suppkey", "c")
    return found.select("c", "medoid", six(F.col("mean_distance")).alias("mean_distance"), "size")


@query()
def clusterings(spark, d):
    """k-medoids, average linkage, density clusters and coordinates within each label's vectors."""
    e = read(spark, d, "embeddings")
    n = e.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    names = [f"x{i}" for i in range(n)]
    return C.cluster_groups(e.select("label", "vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(names))), "label", "vec_id", names)


@query(_REST.format(src="(SELECT c_mktsegment AS g, 'cluster_' || unnest([2, 3]) || '_' || unnest([c_nationkey % 2, c_nationkey % 3]) AS v FROM customer)").replace("(SELECT DISTINCT v FROM n)", "(SELECT DISTINCT v FROM n)") + " SELECT g, v, a AS n FROM q")
def cluster_overlap(spark, d):
    """Classes against the labels of every clustering, unpivoted."""
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), (F.col("c_nationkey") % 2).alias("cluster_2"), (F.col("c_nationkey") % 3).alias("cluster_3"))
    long = c.unpivot(["g"], ["cluster_2", "cluster_3"], "name", "label").select("g", F.concat_ws("_", "name", "label").alias("v"))
    return T.one_vs_rest(long, "g", "v").select("g", "v", F.col("n_pos_group").alias("n"))


_N = ", ".join(f"'{a}'" for a in S.RESIDUES)
_C = ", ".join(n_sql(a) for a in S.RESIDUES)


@query(f"WITH {SEQUENCES_SQL}, r AS (SELECT source AS g, unnest([{_N}]) AS item, unnest([{_C}]) AS n, length(seq) AS l FROM p WHERE length(seq) > 0), b AS (SELECT item, sum(n) / sum(l) AS pooled FROM r GROUP BY 1) SELECT g, item, round(avg(n / l), 6) AS mean, round(any_value(pooled), 6) AS pooled, round(log2((avg(n / l) + 1e-6) / (any_value(pooled) + 1e-6)), 6) AS log2_enrichment FROM r JOIN b USING (item) GROUP BY 1, 2")
def aa_enrichment(spark, d):
    """Mean residue fractions of a source against the fractions of all sequences end to end."""
    c = F.col("seq")
    t = T.mean_enrichment(sequences(spark, d), "source", {a: S.count_of(c, a) for a in S.RESIDUES}, F.length(c))
    return t.select(F.col("source").alias("g"), "item", *(six(F.col(x)).alias(x) for x in ("mean", "pooled", "log2_enrichment")))


@query(f"WITH {LABELLED_SQL} SELECT c_mktsegment AS g, count(*) AS n, count(*) FILTER (WHERE n_lcr > 0) AS n_carriers, round(avg(residues / size) FILTER (WHERE n_lcr > 0), 6) AS occupancy, CASE WHEN avg(n_lcr) <= 9 THEN 'few' ELSE 'many' END AS multiplicity FROM lab GROUP BY 1")
def signature_occupancy(spark, d):
    """Carriers and their occupied share per group."""
    lab = labelled(spark, d)
    g = lab.groupBy(F.col("c_mktsegment").alias("g")).agg(n_rows().alias("n"), F.count_if(F.col("n_lcr") > 0).alias("n_carriers"), six(F.avg(F.when(F.col("n_lcr") > 0, F.col("residues") / F.col("size")))).alias("occupancy"), F.avg("n_lcr").alias("m"))
    return g.select("g", "n", "n_carriers", "occupancy", X.right_closed(F.col("m"), [9], ["few", "many"]).alias("multiplicity"))


@query(f"WITH {LABELLED_SQL} SELECT c_nationkey % 6 - 1 AS cluster, count(*) AS size, round(median(c_acctbal), 6) AS median_c_acctbal, median(residues)::DOUBLE AS median_residues, round(avg((n_lcr > 9)::INT), 6) AS share_rich FROM lab WHERE c_nationkey % 6 - 1 <> -1 GROUP BY 1")
def cluster_summary(spark, d):
    lab = labelled(spark, d).withColumns({"cluster": F.col("c_nationkey") % 6 - 1, "rich": (F.col("n_lcr") > 9).cast("int")})
    s = C.summaries(lab, "cluster", ["c_acctbal", "residues"], ["rich"])
    return s.select("cluster", "size", six(F.col("median_c_acctbal")).alias("median_c_acctbal"), "median_residues", six(F.col("share_rich")).alias("share_rich"))


@query("WITH n AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT n, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS al FROM n) SELECT round(sum(n / al * log2(n / (nr * nc / al))), 6) AS bits FROM t")
def mutual_information(spark, d):
    return T.mutual_information(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(six(F.col("bits")).alias("bits"))
