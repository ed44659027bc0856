"""Queries of the interval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import scalar as X
from strandmill.operators import intervals as I
from strandmill.plans.registry import query
from strandmill.plans.tables import CALLS_SQL, DOMAINS_SQL, SEQUENCES_SQL, calls, domains, sequences

six = lambda c: F.round(c, 6)

_MERGE_SQL = f"""RECURSIVE {CALLS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY protein, method ORDER BY s, e, raw_id) AS rn FROM calls),
f AS (SELECT protein, method, rn, s AS cs, e AS ce, 1 AS part, false AS t0, false AS t1, false AS t2, raw_id, s, e FROM o WHERE rn = 1
UNION ALL SELECT o.protein, o.method, o.rn,
  CASE WHEN m THEN least(f.cs, o.s) ELSE o.s END, CASE WHEN m THEN greatest(f.ce, o.e) ELSE o.e END, CASE WHEN m THEN f.part ELSE f.part + 1 END,
  m AND o.s = f.cs AND o.e = f.ce, m AND o.e <= f.ce AND NOT (o.s = f.cs AND o.e = f.ce), m AND o.e > f.ce, o.raw_id, o.s, o.e
FROM f JOIN o ON o.protein = f.protein AND o.method = f.method AND o.rn = f.rn + 1,
LATERAL (SELECT (o.s >= f.cs AND o.e <= f.ce) OR greatest(0, least(o.e, f.ce) - greatest(o.s, f.cs) + 1) / least(o.e - o.s + 1, f.ce - f.cs + 1) >= 0.7 AS m)),
g AS (SELECT protein, method, part, min(s) AS "start", max(e) AS "end", count(*) AS n, bool_or(t0) AS t0, bool_or(t1) AS t1, bool_or(t2) AS t2 FROM f GROUP BY 1, 2, 3)"""
_TIER = "CASE WHEN t0 OR t1 OR t2 THEN CASE WHEN t0 THEN 'T0' ELSE '' END || CASE WHEN t1 THEN 'T1' ELSE '' END || CASE WHEN t2 THEN 'T2' ELSE '' END ELSE 'none' END"


@query(f'WITH {_MERGE_SQL} SELECT protein, method, "start", "end", "end" - "start" + 1 AS length, n::INTEGER AS n_members, {_TIER} AS merge_tier, coalesce(whole, longest) AS representative FROM g JOIN (SELECT f.protein, f.method, f.part, arg_min(raw_id, rn) FILTER (WHERE f.s = g."start" AND f.e = g."end") AS whole, arg_min(raw_id, struct_pack(a := f.s - f.e, b := rn)) AS longest FROM f JOIN g USING (protein, method, part) GROUP BY ALL) USING (protein, method, part)')
def interval_merge(spark, d):
    return I.merge(calls(spark, d), ["protein", "method"]).drop("member_intervals")


@query(f"WITH {_MERGE_SQL} SELECT method, sum(n)::BIGINT AS n_raw, count(*) AS n_merged, count(*) FILTER (WHERE n > 1) AS n_multi, round(100 * (1 - count(*) / sum(n)), 1) AS pct_redundant FROM g GROUP BY 1")
def merge_summary(spark, d):
    m = I.merge(calls(spark, d), ["protein", "method"])
    raw = F.sum(F.col("n_members").cast("long"))
    return m.groupBy("method").agg(raw.alias("n_raw"), F.count(F.lit(1)).alias("n_merged"), F.count_if(F.col("n_members") > 1).alias("n_multi"), F.round(100 * (1 - F.count(F.lit(1)) / raw), 1).alias("pct_redundant"))


@query(f"WITH {CALLS_SQL}, r AS (SELECT *, max(e) OVER (PARTITION BY protein, method ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM calls), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 4 THEN 1 ELSE 0 END) OVER (PARTITION BY protein, method ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT protein, method, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n FROM i GROUP BY protein, method, island")
def gap_bridge_merge(spark, d):
    return I.bridge(calls(spark, d), ["protein", "method"], 3)


_OV = f"WITH {CALLS_SQL}, {DOMAINS_SQL}, ov AS (SELECT *, least(e, de) - greatest(s, ds) + 1 AS ol FROM calls JOIN domains USING (protein) WHERE s <= de AND ds <= e)"


def _overlaps(spark, d):
    return I.overlap_join(calls(spark, d), domains(spark, d), ["protein"])


@query(f"{_OV} SELECT protein, raw_id, domain_id, ds AS domain_start, greatest(s, ds) AS overlap_start, least(e, de) AS overlap_end, ol AS overlap_length, round(ol / (e - s + 1), 6) AS call_share, round(ol / (de - ds + 1), 6) AS domain_share FROM ov")
def interval_overlap(spark, d):
    share = lambda a, b: six(F.col("overlap_length") / (F.col(b) - F.col(a) + 1))
    return _overlaps(spark, d).select("protein", "raw_id", "domain_id", "domain_start", "overlap_start", "overlap_end", "overlap_length", share("start", "end").alias("call_share"), share("domain_start", "domain_end").alias("domain_share"))


@query(f"{_OV} SELECT method, CASE WHEN ol / (e - s + 1) <= 0.3 THEN '<=0.3' WHEN ol / (e - s + 1) <= 0.7 THEN '0.3-0.7' ELSE '>0.7' END AS bin, count(*) AS n FROM ov GROUP BY ALL")
def overlap_class(spark, d):
    share = F.col("overlap_length") / (F.col("end") - F.col("start") + 1)
    return _overlaps(spark, d).groupBy("method", X.right_closed(share, [0.3, 0.7], ["<=0.3", "0.3-0.7", ">0.7"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_OV}, a AS (SELECT method, count(DISTINCT raw_id) AS n_calls, count(DISTINCT protein) AS n_proteins FROM calls GROUP BY 1), b AS (SELECT method, count(DISTINCT raw_id) AS hit FROM ov GROUP BY 1) SELECT method, n_calls, n_proteins, coalesce(hit, 0) AS n_overlapping, round(100 * coalesce(hit, 0) / n_calls, 2) AS pct FROM a LEFT JOIN b USING (method)")
def overlap_summary(spark, d):
    all_ = calls(spark, d).groupBy("method").agg(F.count_distinct("raw_id").alias("n_calls"), F.count_distinct("protein").alias("n_proteins"))
    hit = _overlaps(spark, d).select("method", "raw_id").distinct().groupBy("method").agg(F.count(F.lit(1)).alias("hit"))
    n = F.coalesce("hit", F.lit(0))
    return all_.join(hit, "method", "left").select("method", "n_calls", "n_proteins", n.alias("n_overlapping"), F.round(100 * n / F.col("n_calls"), 2).alias("pct"))


_NEIGHBOURS = f"""WITH {CALLS_SQL}, {DOMAINS_SQL}, j AS (SELECT c.protein, raw_id, s, e, domain_id, ds, de, ev, greatest(0, least(e, de) - greatest(s, ds) + 1) AS ol FROM calls c LEFT JOIN domains d ON c.protein = d.protein),
a AS (SELECT protein, raw_id, s, e, max(ol / (e - s + 1)) AS mf, count(domain_id) AS nd, min(ds) AS first, max(de) AS last,
  min({{'d': greatest(0, ds - e - 1, s - de - 1), 'v': ev, 'l': domain_id}}) FILTER (WHERE domain_id IS NOT NULL) AS near,
  min({{'d': -de, 'v': ev, 'l': domain_id}}) FILTER (WHERE de < s) AS lft, min({{'d': ds, 'v': ev, 'l': domain_id}}) FILTER (WHERE ds > e) AS rgt,
  coalesce(bool_or(ol > 0 AND ((s < ds AND ds <= e) OR (s <= de AND de < e) OR abs(s - ds) <= 10 OR abs(e - de) <= 10)), false) AS edge
FROM j GROUP BY ALL)"""


@query(f"{_NEIGHBOURS} SELECT raw_id, lft.l AS left_domain, rgt.l AS right_domain, s + lft.d - 1 AS left_distance, rgt.d - e - 1 AS right_distance FROM a")
def flanking_intervals(spark, d):
    n = I.neighbours(calls(spark, d), domains(spark, d), "protein", ["raw_id"])
    return n.select("raw_id", F.col("left.label").alias("left_domain"), F.col("right.label").alias("right_domain"), (F.col("start") - F.col("left.end") - 1).alias("left_distance"), (F.col("right.start") - F.col("end") - 1).alias("right_distance"))


def _classified(spark, d):
    return I.position_classes(calls(spark, d), domains(spark, d), "protein", ["raw_id"])


@query(f"{_NEIGHBOURS} SELECT raw_id, near.l AS nearest_domain, near.d::INTEGER AS nearest_distance FROM a")
def nearest_interval(spark, d):
    return _classified(spark, d).select("raw_id", "nearest_domain", "nearest_distance")


_POSITION = f"""{_NEIGHBOURS}, k AS (SELECT *, mf >= 0.7 AS i, mf <= 0.3 AND lft IS NOT NULL AND rgt IS NOT NULL AS l, mf = 0 AND near.d <= 50 AS ad, mf = 0 AND near.d > 50 AND (e < first OR s > last) AS di FROM a),
pc AS (SELECT protein, raw_id, s, e, CASE WHEN nd = 0 THEN 0 ELSE round(mf, 4) END AS max_fraction, CASE WHEN nd = 0 THEN 'unclassified_no_pfam' WHEN edge THEN 'domain_edge' WHEN i THEN 'domain_intrinsic' WHEN l THEN 'interdomain_linker' WHEN ad THEN 'domain_adjacent' WHEN di THEN 'distal_terminal' ELSE 'unclassified_partial_overlap' END AS primary_class,
CASE WHEN nd = 0 THEN 'unclassified_no_pfam' WHEN NOT (i OR edge OR l OR ad OR di) THEN 'unclassified_partial_overlap' ELSE concat_ws(';', CASE WHEN i THEN 'domain_intrinsic' END, CASE WHEN edge THEN 'domain_edge' END, CASE WHEN l THEN 'interdomain_linker' END, CASE WHEN ad THEN 'domain_adjacent' END, CASE WHEN di THEN 'distal_terminal' END) END AS class_labels FROM k)"""


@query(f"{_POSITION} SELECT * EXCLUDE (s, e) FROM pc")
def position_class(spark, d):
    return _classified(spark, d).select("protein", "raw_id", "max_fraction", "primary_class", "class_labels")


@query(f"{_POSITION}, m AS (SELECT c.method, primary_class FROM pc JOIN calls c USING (raw_id, protein, s, e)), n AS (SELECT method, primary_class, count(*) AS n FROM m GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY method), 6) AS share FROM n")
def position_shares(spark, d):
    from pyspark.sql import Window as W

    j = _classified(spark, d).join(calls(spark, d), ["protein", "raw_id", "start", "end"])
    n = j.groupBy("method", "primary_class").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", six(F.col("n") / F.sum("n").over(W.partitionBy("method"))))


@query("SELECT l_returnflag AS method, CASE WHEN x <= 1/3::DOUBLE THEN 'N-terminal' WHEN x <= 2/3::DOUBLE THEN 'middle' ELSE 'C-terminal' END AS part, count(*) AS n FROM (SELECT l_returnflag, (a + a + l_quantity::INT) / 2 / 2600 AS x FROM (SELECT *, l_orderkey % 2551 AS a FROM lineitem)) GROUP BY ALL")
def location_thirds(spark, d):
    from strandmill.plans.tables import read

    a = F.col("l_orderkey") % 2551
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("method"), X.third(a, a + F.col("l_quantity").cast("int"), F.lit(2600)).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQUENCES_SQL}, {CALLS_SQL}, m AS (SELECT raw_id, protein, (s % 3000 + 1)::INT AS a, (s % 3000 + 1 + e - s)::INT AS b FROM calls) SELECT raw_id, CASE WHEN seq IS NULL THEN 'missing_accession' WHEN b > length(seq) THEN 'end_beyond_sequence' ELSE 'ok' END AS status, CASE WHEN b <= length(seq) THEN substr(seq, a, b - a + 1) END AS stretch FROM m LEFT JOIN p ON doc_id = protein")
def sequence_slice(spark, d):
    m = calls(spark, d).select("raw_id", F.col("protein").alias("doc_id"), (F.col("start") % 3000 + 1).alias("start"), (F.col("start") % 3000 + 1 + F.col("end") - F.col("start")).alias("end"))
    return I.reslice(m, sequences(spark, d), "doc_id", "seq").select("raw_id", "status", F.col("seq").alias("stretch"))


@query(f"{_OV}, x AS (SELECT protein, domain_id, ds, count(DISTINCT method) AS k FROM ov GROUP BY ALL) SELECT k AS n_methods, count(*) AS n_domains FROM x GROUP BY 1")
def method_support(spark, d):
    per = _overlaps(spark, d).groupBy("protein", "domain_id", "domain_start").agg(F.count_distinct("method").alias("n_methods"))
    return per.groupBy("n_methods").agg(F.count(F.lit(1)).alias("n_domains"))
