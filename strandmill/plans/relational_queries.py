"""Queries of selections, lookups, set operations and aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import scalar as X
from strandmill.operators import cluster as C
from strandmill.operators import select as P
from strandmill.operators import tables as B
from strandmill.plans.registry import query
from strandmill.plans.tables import read

six = lambda c: F.round(c, 6)
n_rows = lambda: F.count(F.lit(1))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def best_isoform(spark, d):
    order = [-F.col("l_quantity"), -F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return P.pick(read(spark, d, "lineitem"), ["l_suppkey"], order, "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1")
def best_candidate(spark, d):
    return P.best(read(spark, d, "orders"), ["o_custkey"], F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, arg_min(o_orderkey, {'a': CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 END, 'b': o_orderkey}) AS pick, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_first FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def canonical_pick(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1)
    o = read(spark, d, "orders").where(rank.isNotNull())
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank, F.col("o_orderkey"))).alias("pick"), F.count_if(rank == 0).alias("n_first"))


@query("SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal > 0 THEN 'balance' END, CASE WHEN c_nationkey < 10 THEN 'near' END, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'orders' END) AS source FROM customer")
def provenance_label(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    a = P.audited_join(read(spark, d, "customer"), o, ["c_custkey"])
    return a.select("c_custkey", X.provenance(balance=F.col("c_acctbal") > 0, near=F.col("c_nationkey") < 10, orders=F.col("match") == "both").alias("source"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.02 AND l_quantity >= 40 THEN 'strict' WHEN l_discount <= 0.05 AND l_quantity >= 20 THEN 'borderline' END AS tier FROM lineitem WHERE l_discount <= 0.05 AND l_quantity >= 20")
def tier_filter(spark, d):
    x, q = F.col("l_discount"), F.col("l_quantity")
    tiers = [("strict", (x <= 0.02) & (q >= 40)), ("borderline", (x <= 0.05) & (q >= 20))]
    return B.tiered(read(spark, d, "lineitem"), tiers).select("l_orderkey", "l_linenumber", "tier")


@query("WITH a AS (SELECT l_partkey AS k, max_by(l_shipmode, ord) AS v FROM (SELECT l_partkey, l_returnflag AS l_shipmode, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY 1), b AS (SELECT p_size AS k, max_by(p_brand, p_partkey) AS v FROM part GROUP BY 1) SELECT p_partkey, coalesce(a.v, b.v) AS label, CASE WHEN a.v IS NOT NULL THEN 'thrice' WHEN b.v IS NOT NULL THEN 'p_size' ELSE 'none' END AS matched_by FROM part LEFT JOIN a ON p_partkey * 3 = a.k LEFT JOIN b ON p_size + 3 = b.k")
def priority_lookup(spark, d):
    li = read(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    part = read(spark, d, "part").withColumn("thrice", F.col("p_partkey") * 3)
    sizes = part.select((F.col("p_size") - 3).alias("p_size"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord"))
    return P.fallback_lookup(part, [("thrice", li, "l_partkey"), ("p_size", sizes, "p_size")], "label").select("p_partkey", "label", "matched_by")


@query("SELECT c_custkey, coalesce(n1.n_name, n2.n_name) AS name, CASE WHEN n1.n_name IS NOT NULL THEN 'direct' WHEN n2.n_name IS NOT NULL THEN 'patch' ELSE 'none' END AS how FROM customer LEFT JOIN nation n1 ON n1.n_nationkey = c_custkey LEFT JOIN nation n2 ON n2.n_nationkey = c_custkey % 40")
def fallback_key_join(spark, d):
    n = read(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("c_custkey"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    j = P.left_join_one(P.left_join_one(read(spark, d, "customer").withColumn("k", F.col("c_custkey") % 40), a, ["c_custkey"]), b, ["k"])
    return j.select("c_custkey", F.coalesce("a", "b").alias("name"), F.when(F.col("a").isNotNull(), "direct").when(F.col("b").isNotNull(), "patch").otherwise("none").alias("how"))


@query("SELECT p_partkey, CASE WHEN s_nationkey IS NULL THEN 'dead' WHEN r_regionkey IS NOT NULL THEN 'renamed' ELSE 'uncertain' END AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN region ON r_regionkey = s_nationkey")
def chained_lookup(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_nationkey")
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("s_nationkey"))
    return P.chained_lookup(read(spark, d, "part"), s, r, "p_partkey", "s_nationkey").select("p_partkey", "status")


_INST = "row_number() OVER (PARTITION BY {k} ORDER BY {o}) - 1 AS instance"


@query("WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), b AS (SELECT l_suppkey AS k, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem) SELECT k, i::INTEGER AS instance, o_orderkey, l_orderkey FROM a LEFT JOIN b USING (k, i)")
def instance_join(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey")
    j = P.instance_join(a, b, ["k"], [F.col("o_orderkey")], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")])
    return j.select("k", "instance", "o_orderkey", "l_orderkey")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) SELECT k, n_orders, balance FROM a FULL JOIN b USING (k)")
def outer_feature_join(spark, d):
    a = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(n_rows().alias("n_orders"))
    b = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return a.join(b, "k", "full")


@query("SELECT 'semi' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH') UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def semi_anti(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, name: c.join(o, "c_custkey", how).agg(n_rows().alias("n")).select(F.lit(name).alias("side"), "n")
    return count("left_semi", "semi").union(count("left_anti", "anti"))


@query("SELECT 'union' AS op, k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 0 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9800) UNION ALL SELECT 'intersect', k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800) UNION ALL SELECT 'except', k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 0 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
def set_ops(spark, d):
    a = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))
    b = read(spark, d, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("k"))
    named = lambda df, n: df.select(F.lit(n).alias("op"), "k")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "intersect")).union(named(a.subtract(b), "except"))


@query("SELECT k, label, priority::INTEGER AS priority FROM (SELECT c_custkey AS k, 'direct' AS label, 0 AS priority FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'patch', 1 FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey, 'appended', 2 FROM customer) QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority) = 1")
def label_assembly(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    part = lambda cond, name: c.where(cond).select("k", F.lit(name).alias("label"))
    return P.priority_union([part("c_acctbal > 5000", "direct"), part("c_nationkey < 10", "patch"), part("true", "appended")], ["k"], ["label"])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand WHEN p_size < 20 THEN p_type ELSE p_name END AS filled FROM part")
def coalesce_fill(spark, d):
    t = F.when(F.col("p_size") < 10, F.col("p_brand")).when(F.col("p_size") < 15, "nan").when(F.col("p_size") < 20, " ")
    return read(spark, d, "part").select("p_partkey", X.fill_empty(t, F.when(F.col("p_size") < 20, F.col("p_type")).otherwise(F.col("p_name"))).alias("filled"))


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_totalprice) AS o_totalprice, string_agg(p, '; ' ORDER BY f) AS o_orderpriority FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS f, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) THEN o_orderpriority END AS p FROM orders) GROUP BY 1")
def rule_aggregation(spark, d):
    return P.aggregate_by_rules(read(spark, d, "orders"), ["o_custkey"], {"o_orderstatus": "first", "o_totalprice": "max", "o_orderpriority": "join", "absent": "min"}, F.col("o_orderkey"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities, bool_or(o_orderstatus = 'F') AS any_f FROM orders GROUP BY 1")
def string_set_agg(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(P.join_sorted(F.col("o_orderpriority")).alias("priorities"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) FILTER (WHERE l_tax > 0.01) / sum(l_quantity) FILTER (WHERE l_tax > 0.01), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(six(C.weighted_mean(F.when(F.col("l_tax") > 0.01, F.col("l_discount")), F.col("l_quantity"))).alias("mean"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_lcr, coalesce(r, 0)::BIGINT AS residues, round(m, 6) AS mean_length, round(coalesce(r, 0) / 5000, 6) AS coverage FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_orderkey % 30 + 1) AS r, avg(o_orderkey % 30 + 1) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def architecture(spark, d):
    size = F.col("o_orderkey") % 30 + 1
    per = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows().alias("n"), F.sum(size).alias("r"), F.avg(size).alias("m"))
    j = read(spark, d, "customer").join(per, "c_custkey", "left")
    r = F.coalesce("r", F.lit(0))
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_lcr"), r.alias("residues"), six(F.col("m")).alias("mean_length"), six(r / 5000).alias("coverage"))


@query("WITH t AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1), k AS (SELECT p_brand FROM t ORDER BY c DESC, p_brand LIMIT 8) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'other' END AS brand, count(*) AS n FROM part GROUP BY 1")
def topk_other(spark, d):
    return P.top_or_other(read(spark, d, "part"), "p_brand", 8).groupBy(F.col("p_brand").alias("brand")).agg(n_rows().alias("n"))


_FLAGS = ["A", "N", "R"]


@query("SELECT l_suppkey, " + ", ".join(f"coalesce(max(CASE WHEN l_returnflag = '{f}' AND l_quantity > 49 THEN 1 END), 0) AS {f}" for f in _FLAGS) + " FROM lineitem GROUP BY 1")
def presence_matrix(spark, d):
    return P.presence(read(spark, d, "lineitem").withColumn("f", F.when(F.col("l_quantity") > 49, F.col("l_returnflag"))), "l_suppkey", "f", _FLAGS)


@query("WITH m AS (SELECT l_suppkey % 7 AS c, " + ", ".join(f"sum((l_returnflag = '{f}' AND l_quantity > 25)::INT) AS {f}" for f in _FLAGS) + " FROM lineitem GROUP BY 1), u AS (UNPIVOT m ON A, N, R INTO NAME feature VALUE n), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, feature) AS rank FROM u WHERE n > 0) SELECT c, rank::INTEGER AS rank, feature, n::BIGINT AS n FROM r WHERE rank <= 2")
def top_two_presence(spark, d):
    li = read(spark, d, "lineitem")
    flags = {f: ((F.col("l_returnflag") == f) & (F.col("l_quantity") > 25)).cast("int") for f in _FLAGS}
    return C.top_features(li.select((F.col("l_suppkey") % 7).alias("c"), *(v.alias(k) for k, v in flags.items())), "c", _FLAGS)


@query("WITH u AS (SELECT l_returnflag AS g, unnest(['quantity', 'discount']) AS metric, unnest([l_quantity, l_discount]) AS v FROM lineitem) SELECT g, metric, round(median(v), 6) AS med, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3 FROM u GROUP BY 1, 2")
def quantile_summary(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = li.unpivot(["g"], ["quantity", "discount"], "metric", "v").groupBy("g", "metric").agg(q.alias("q"))
    return s.select("g", "metric", *(six(F.get("q", F.lit(i))).alias(n) for i, n in ((1, "med"), (0, "q1"), (2, "q3"))))


@query("WITH m AS (SELECT o_orderpriority AS g, median(o_totalprice) AS a, median(o_custkey)::DOUBLE AS b FROM orders GROUP BY 1) SELECT g, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS a, CASE WHEN stddev_pop(b) OVER () = 0 THEN 0 ELSE round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) END AS b FROM m")
def zscore_medians(spark, d):
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.median("o_totalprice").alias("a"), F.median("o_custkey").alias("b"))
    return C.z_score(m, ["a", "b"]).select("g", six(F.col("a")).alias("a"), six(F.col("b")).alias("b"))


@query("SELECT l_returnflag AS method, l_linestatus AS verdict, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linestatus)::INTEGER AS rank FROM lineitem GROUP BY 1, 2")
def verdict_tally(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("verdict")).agg(n_rows().alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("method").orderBy(F.col("n").desc(), "verdict")))


@query("WITH t AS (SELECT count(*) AS tot FROM supplier) SELECT l_returnflag AS tool, count(*) AS n_calls, count(DISTINCT l_suppkey) AS n_proteins, round(avg(l_quantity), 6) AS mean_length, round(count(*) / any_value(tot), 6) AS per_protein, round(count(*) / count(DISTINCT l_suppkey), 6) AS per_positive FROM lineitem, t GROUP BY 1")
def tool_summary(spark, d):
    tot = read(spark, d, "supplier").agg(n_rows().alias("tot"))
    g = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tool")).agg(n_rows().alias("n_calls"), F.count_distinct("l_suppkey").alias("n_proteins"), six(F.avg("l_quantity")).alias("mean_length"))
    return g.join(F.broadcast(tot), how="cross").select("tool", "n_calls", "n_proteins", "mean_length", six(F.col("n_calls") / F.col("tot")).alias("per_protein"), six(F.col("n_calls") / F.col("n_proteins")).alias("per_positive"))


@query("WITH n AS (SELECT o_custkey % 20 AS k, o_orderpriority AS l, count(*) AS n FROM orders GROUP BY ALL) SELECT k, arg_min(l, {'a': -n, 'b': l}) AS consensus, sum(n)::BIGINT AS votes, round(max(n) / sum(n), 6) AS agreement, count(*) = 1 AS unanimous FROM n GROUP BY 1")
def plurality_consensus(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k"), F.col("o_orderpriority").alias("l"))
    return C.plurality(o, "k", "l").withColumn("agreement", six(F.col("agreement")))


@query("SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INTEGER AS instance, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM conversations")
def occurrence_gap(spark, d):
    c = P.occurrence(read(spark, d, "conversations"), ["conv_id", "role"], F.col("turn"))
    n = F.length("text")
    return c.select("conv_id", "turn", "role", "instance", (n - F.lag(n).over(W.partitionBy("conv_id").orderBy("turn"))).cast("long").alias("delta"))
