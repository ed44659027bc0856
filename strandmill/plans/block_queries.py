"""Queries of contrasts by block: composition, architecture, signatures and positions of calls, with their SQL.

A document is a protein, its language the reference flag, its source the group; its sentences are
the calls on it, with the residues that they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import rules as R
from strandmill.functions import sequence as S
from strandmill.operators import contrasts as K
from strandmill.operators import stats as T
from strandmill.operators.storage import stored
from strandmill.plans.registry import query
from strandmill.plans.sequence_queries import _FEATURES_SQL, _PROPS, _SIGNATURES_SQL, frac_sql
from strandmill.plans.stat_queries import _FISHER, _OR, _REST, chi2_sql
from strandmill.plans.tables import LABELLED_SQL, labelled, read

six = lambda c: F.round(c, 6)
sixes = lambda *names: (six(F.col(c)).alias(c) for c in names)

#: The co-occurrence from which a call counts as rich in it.
CUTOFF = 0.9
PLACES = ["first", "middle", "last"]


def proteins(spark, d):
    """doc_id, g, is_ref, size (residues)."""
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("g"), (F.col("lang") == "en").alias("is_ref"), F.length(S.clean(F.col("text"))).alias("size"))


def sized(spark, d):
    """The proteins, stored: a join that finds many rows for a protein would clean its text for each of them."""
    return stored(proteins(spark, d), "proteins")


def sentences(spark, d):
    """doc_id, g, is_ref, place (which third of the document), seq, length of every sentence with a residue."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("g"), (F.col("lang") == "en").alias("is_ref"), F.split("text", r"[.\n]+").alias("parts"))
    # their number in a step of its own: beside posexplode it would be computed, text and all, for every sentence
    each = docs.select("*", F.size("parts").alias("n")).select("doc_id", "g", "is_ref", "n", F.posexplode("parts").alias("i", "s"))
    place = F.get(F.array(*map(F.lit, PLACES)), F.floor(3 * F.col("i") / F.col("n")).cast("int"))
    seqs = each.select("doc_id", "g", "is_ref", place.alias("place"), S.clean(F.col("s")).alias("seq"))
    return seqs.withColumn("length", F.length("seq")).where("length > 0")


def signed(spark, d, *more):
    """The sentences with their primary signature and ``more`` of their features, stored: the rules are evaluated once."""
    f = S.with_features(sentences(spark, d)).withColumn("hits", R.signature_hits(cutoff=CUTOFF))
    return stored(f.select("doc_id", "g", "is_ref", "place", "length", *more, R.labels_of(F.col("hits"), R.UNMAPPED)["primary"].alias("signature")), "calls")


_CLEAN = f"regexp_replace(upper(regexp_replace({{0}}, '[^A-Za-z]', '', 'g')), '[^{S.RESIDUES}]', '', 'g')"
_PROTEINS = f"pr AS (SELECT doc_id, source AS g, lang = 'en' AS is_ref, length({_CLEAN.format('text')}) AS size FROM documents)"
_CALLS = f"""w AS (SELECT doc_id, source AS g, lang = 'en' AS is_ref, regexp_split_to_array(text, '[.\\n]+') AS w FROM documents),
s AS (SELECT doc_id, g, is_ref, len(w) AS n, unnest(w) AS s, unnest(range(len(w))) AS i FROM w),
p AS (SELECT doc_id, g, is_ref, ['first', 'middle', 'last'][1 + floor(3 * i / n)::INTEGER] AS place, {_CLEAN.format('s')} AS seq FROM s)"""
_SIGNED = f"""{_CALLS}, f AS (SELECT doc_id, g, is_ref, place, length(seq) AS length, {_FEATURES_SQL} FROM p WHERE length(seq) > 0),
calls AS (SELECT doc_id, g, is_ref, place, length, coalesce(list_filter({_SIGNATURES_SQL.replace("cutoff", str(CUTOFF))}, lambda x: x IS NOT NULL)[1], '{R.UNMAPPED}') AS signature FROM f)"""


def _against(u: str) -> str:
    """A table ``k`` of every metric and group of u (metric, g, is_ref, v) against the reference rows of the metric."""
    return f"""u AS ({u}), ref AS (SELECT metric, v, count(*) FILTER (WHERE is_ref) AS r FROM u WHERE v IS NOT NULL GROUP BY ALL),
run AS (SELECT metric, v, r, sum(r) OVER (PARTITION BY metric ORDER BY v) - r AS less FROM ref), own AS (SELECT metric, g, v, count(*) AS c FROM u WHERE v IS NOT NULL AND g IS NOT NULL GROUP BY ALL),
a AS (SELECT metric, g, count(*) AS n_group, median(v) AS median_group, avg(v) AS mean_group, stddev_samp(v) AS sd_group FROM u WHERE v IS NOT NULL AND g IS NOT NULL GROUP BY ALL),
b AS (SELECT metric, count(*) AS n_ref, median(v) AS median_ref, avg(v) AS mean_ref, stddev_samp(v) AS sd_ref FROM u WHERE v IS NOT NULL AND is_ref GROUP BY ALL),
rt AS (SELECT metric, sum(r::DOUBLE * r * r - r) AS t FROM ref GROUP BY ALL),
m AS (SELECT metric, g, sum(c * (less + r / 2)) AS u, sum((c + r)::DOUBLE * (c + r) * (c + r) - (c + r) - (r::DOUBLE * r * r - r)) AS t FROM own JOIN run USING (metric, v) GROUP BY ALL),
k AS (SELECT a.*, coalesce(n_ref, 0) AS n_ref, median_ref, mean_ref, sd_ref, CASE WHEN n_ref > 0 THEN u END AS u, m.t + rt.t AS ties,
  CASE WHEN n_group >= 2 AND n_ref >= 2 THEN 2 * u / (n_group::DOUBLE * n_ref) - 1 END AS cliffs_delta, least(n_group, coalesce(n_ref, 0)) < 5 AS descriptive_only
  FROM a JOIN m USING (metric, g) JOIN rt USING (metric) LEFT JOIN b USING (metric))"""


_STATS = "round(median_group, 6) AS median_group, round(median_ref, 6) AS median_ref, round(mean_group, 6) AS mean_group, round(mean_ref, 6) AS mean_ref, round(sd_group, 6) AS sd_group, round(sd_ref, 6) AS sd_ref, round(cliffs_delta, 6) AS cliffs_delta"
_STAT_NAMES = ("median_group", "median_ref", "mean_group", "mean_ref", "sd_group", "sd_ref", "cliffs_delta")
#: p by the normal approximation, for arms of more than eight.
_P = chi2_sql("(z * z)", "1")
_Z = f"z AS (SELECT *, (greatest(u, n_group * n_ref - u) - n_group * n_ref / 2 - 0.5) / sqrt(n_group::DOUBLE * n_ref / 12 * (n_group + n_ref + 1 - ties / ((n_group + n_ref)::DOUBLE * (n_group + n_ref - 1)))) AS z FROM k), pv AS (SELECT *, CASE WHEN z <= 0 THEN 1 ELSE {_P} END AS p_value FROM z)"

_METRICS = {**{f"frac_{a}": frac_sql(a) for a in S.RESIDUES}, **_PROPS, "length": "length(seq)"}
_LONG = f"SELECT g, is_ref, unnest([{', '.join(repr(m) for m in _METRICS)}]) AS metric, unnest([{', '.join(f'({x})::DOUBLE' for x in _METRICS.values())}]) AS v FROM p WHERE length(seq) > 0"


@query(f"WITH {_CALLS}, {_against(_LONG)}, {_Z} SELECT metric, g, n_group, n_ref, {_STATS}, round(p_value, 6) AS p_value, descriptive_only FROM pv")
def composition_block(spark, d):
    """The 20 residue fractions, the ten properties and the length of calls: every source against the reference's calls."""
    c = F.col("seq")
    calls = sentences(spark, d).select("g", "is_ref", *(v.alias(k) for k, v in {**S.composition(c), **S.properties(c)}.items()), "length")
    t = K.of_metrics(calls, "g", F.col("is_ref"), list(_METRICS))
    return t.select("metric", "g", "n_group", "n_ref", *sixes(*_STAT_NAMES, "p_value"), "descriptive_only")


@query(f"WITH {LABELLED_SQL}, {_against('''SELECT c_mktsegment AS g, is_ref, unnest(['coverage', 'n_lcr', 'mean_length']) AS metric, unnest([residues / size, n_lcr, residues / n_lcr]) AS v FROM lab WHERE n_lcr > 0''')} SELECT metric, g, n_group, n_ref, round(median_group, 6) AS median_group, round(median_ref, 6) AS median_ref, round(cliffs_delta, 6) AS cliffs_delta, descriptive_only FROM k")
def architecture_block(spark, d):
    """Three metrics of carriers, every group against the reference."""
    c = labelled(spark, d).where("n_lcr > 0").select(F.col("c_mktsegment").alias("g"), "is_ref", (F.col("residues") / F.col("size")).alias("coverage"), "n_lcr", (F.col("residues") / F.col("n_lcr")).alias("mean_length"))
    t = K.of_metrics(c, "g", F.col("is_ref"), ["coverage", "n_lcr", "mean_length"])
    return t.select("metric", "g", "n_group", "n_ref", *sixes("median_group", "median_ref", "cliffs_delta"), "descriptive_only")


def _label_block_sql(label: str) -> str:
    occupancy = f"SELECT pr.g, pr.is_ref, {label} AS metric, sum(c.length) / any_value(size) AS v FROM calls c JOIN pr USING (doc_id) GROUP BY doc_id, pr.g, pr.is_ref, {label}"
    return f"""WITH {_PROTEINS}, {_SIGNED}, has AS (SELECT DISTINCT {label} AS label, doc_id FROM calls), tot AS (SELECT g, count(*) AS n FROM pr GROUP BY 1), rtot AS (SELECT count(*) AS n FROM pr WHERE is_ref),
pos AS (SELECT label, g, count(*) AS n FROM has JOIN pr USING (doc_id) GROUP BY ALL), rpos AS (SELECT label, count(*) FILTER (WHERE is_ref) AS n FROM has JOIN pr USING (doc_id) GROUP BY ALL),
q AS (SELECT rpos.label, tot.g, coalesce(pos.n, 0) AS a, tot.n - coalesce(pos.n, 0) AS b, rpos.n AS c, rtot.n - rpos.n AS d FROM rpos CROSS JOIN tot CROSS JOIN rtot LEFT JOIN pos ON pos.label = rpos.label AND pos.g = tot.g),
{_against(occupancy)}
SELECT 'carrier_rate' AS measure, label, g, a AS n_pos_group, a + b AS n_tot_group, c AS n_pos_ref, c + d AS n_tot_ref, round(a / (a + b), 6) AS rate_group, round(c / (c + d), 6) AS rate_ref, CASE WHEN a > 0 AND c > 0 THEN round({_OR}, 6) END AS log2_or, round({_FISHER}, 6) AS fisher_p, least(a, b, c, d) < 5 AS descriptive_only, NULL::BIGINT AS n_group, NULL::BIGINT AS n_ref, NULL::DOUBLE AS median_group, NULL::DOUBLE AS median_ref, NULL::DOUBLE AS cliffs_delta FROM q
UNION ALL SELECT 'occupancy_among_carriers', metric, g, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, descriptive_only, n_group, n_ref, round(median_group, 6), round(median_ref, 6), round(cliffs_delta, 6) FROM k"""


def _label_block(spark, d, label):
    t = K.label_block(sized(spark, d), signed(spark, d), "doc_id", "g", label, "length", "size", F.col("is_ref"))
    p = F.when(F.col("measure") == "carrier_rate", six(F.col("p_value"))).alias("fisher_p")
    return t.select("measure", F.col(label).alias("label"), "g", "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref", *sixes("rate_group", "rate_ref", "log2_or"), p, "descriptive_only", "n_group", "n_ref", *sixes("median_group", "median_ref", "cliffs_delta"))


@query(_label_block_sql("signature"))
def signature_block(spark, d):
    """Carrier rate and occupancy of every signature in every source against the reference proteins."""
    return _label_block(spark, d, "signature")


@query(_label_block_sql("place"))
def position_block(spark, d):
    """The same of positions."""
    return _label_block(spark, d, "place")


def _presence_sql(label: str) -> str:
    return f"""base AS (SELECT DISTINCT doc_id, g FROM calls), has AS (SELECT DISTINCT doc_id, g, {label} AS label FROM calls), pos AS (SELECT label, g, count(*) AS n FROM has GROUP BY ALL),
q AS (SELECT l.label, t.g, coalesce(pos.n, 0) AS a, t.n - coalesce(pos.n, 0) AS b, l.n - coalesce(pos.n, 0) AS c, al.n - t.n - l.n + coalesce(pos.n, 0) AS d
  FROM (SELECT label, count(*) AS n FROM has GROUP BY 1) l CROSS JOIN (SELECT g, count(*) AS n FROM base GROUP BY 1) t CROSS JOIN (SELECT count(*) AS n FROM base) al LEFT JOIN pos ON pos.label = l.label AND pos.g = t.g)"""


@query(f"WITH {_SIGNED}, {_presence_sql('signature')} SELECT label, g, a AS n_pos_group, a + b AS n_tot_group, c AS n_pos_ref, c + d AS n_tot_ref, CASE WHEN a > 0 AND c > 0 THEN round({_OR}, 6) END AS log2_or, round({_FISHER}, 6) AS p_value FROM q")
def presence_enrichment(spark, d):
    """Proteins with a signature in a source against those of the other sources; only presence is reported."""
    calls = signed(spark, d)
    t = K.presence_vs_rest(calls.select("doc_id", "g"), calls, "doc_id", "g", "signature")
    return t.select(F.col("signature").alias("label"), "g", "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref", *sixes("log2_or", "p_value"))


_MULTIPLE = f"(SELECT g, CASE WHEN n > 2 THEN '3+' ELSE n::VARCHAR END AS v FROM (SELECT doc_id, any_value(g) AS g, count(*) AS n FROM p WHERE length(seq) > 0 GROUP BY doc_id))"


@query(f"WITH {_CALLS}, " + _REST.format(src=_MULTIPLE).removeprefix("WITH ") + f" SELECT g, v, a AS n_pos_group, a + b AS n_tot_group, c AS n_pos_ref, c + d AS n_tot_ref, CASE WHEN a > 0 AND c > 0 THEN round({_OR}, 6) END AS log2_or, round({_FISHER}, 6) AS p_value FROM q")
def multiplicity_enrichment(spark, d):
    """How many calls a protein has (1, 2, 3+), a source against the others."""
    per = sentences(spark, d).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("n") > 2, "3+").otherwise(F.col("n").cast("string"))
    t = T.compare_binary(T.one_vs_rest(per.select("g", n.alias("v")), "g", "v"), "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref")
    return t.select("g", "v", "n_pos_group", "n_tot_group", "n_pos_ref", "n_tot_ref", *sixes("log2_or", "p_value"))


_ARM = "(SELECT g, (CASE WHEN length(seq) < 30 THEN 'short' ELSE 'long' END) AS v, unnest(range(length(seq))) FROM p WHERE length(seq) > 0)"


@query(f"WITH {_CALLS}, " + _REST.format(src=_ARM).removeprefix("WITH ") + " SELECT g, v, a AS n_pos_group, a + b AS n_tot_group, c AS n_pos_ref, c + d AS n_tot_ref FROM q WHERE v = 'short' UNION ALL SELECT DISTINCT g, 'none', 0, a + b, 0, c + d FROM q")
def reported_arm(spark, d):
    """One arm of a feature with two values, counted by residues, and one value that no call has."""
    arm = sentences(spark, d).select("g", F.when(F.col("length") < 30, "short").otherwise("long").alias("v"), "length")
    return T.one_vs_rest(arm, "g", "v", F.col("length"), report_values=["short", "none"])


def _rest_sql(u: str) -> str:
    """Every metric of u (metric, g, v), a group against the others, with the omnibus test over groups of two and more."""
    return f"""u AS ({u}), n AS (SELECT *, count(*) OVER (PARTITION BY metric, g) AS gn FROM u WHERE v IS NOT NULL AND g IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY metric) AS al FROM n),
o AS (SELECT metric, g, gn, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY metric, v) AS t FROM n WHERE gn >= 2),
og AS (SELECT metric, g, sum(rk) AS r, count(*) AS m, sum(t::DOUBLE * t - 1) AS t FROM o GROUP BY ALL), oh AS (SELECT metric, sum(r * r / m) AS s, sum(m)::DOUBLE AS n, sum(t) AS t, count(*) AS k FROM og GROUP BY ALL),
h AS (SELECT metric, k, CASE WHEN k >= 2 THEN (12 / (n * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - t / (n * n * n - n), 0) END AS h FROM oh), hp AS (SELECT metric, CASE WHEN h IS NOT NULL THEN round({chi2_sql("h", "k - 1")}, 6) END AS omnibus_p FROM h),
g AS (SELECT metric, g, count(*) AS n, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, CASE WHEN count(*) >= 2 AND any_value(al) - count(*) >= 2 THEN round(2 * (sum(rk) - count(*) * (count(*) + 1) / 2) / (count(*)::DOUBLE * (any_value(al) - count(*))) - 1, 6) END AS delta_vs_rest FROM k GROUP BY ALL)
SELECT metric, g, n, median, mean, sd, delta_vs_rest, omnibus_p, n < 5 AS descriptive_only FROM g LEFT JOIN hp USING (metric)"""


def _rested(t):
    return t.select("metric", "g", "n", *sixes("median", "mean", "sd", "delta_vs_rest", "omnibus_p"), "descriptive_only")


@query("WITH " + _rest_sql("SELECT 'c_acctbal' AS metric, c_mktsegment AS g, c_acctbal AS v FROM customer"))
def class_summary(spark, d):
    """A metric's n, median, mean, sd and delta against the rest, per class, with the omnibus p."""
    return _rested(K.with_rest(read(spark, d, "customer").select(F.lit("c_acctbal").alias("metric"), F.col("c_mktsegment").alias("g"), "c_acctbal"), ["metric"], "g", "c_acctbal"))


_FRACTIONS = "SELECT 'property_fraction__' || l AS metric, g, sum(length) / any_value(size) AS v FROM (SELECT c.doc_id, c.g, length, size, CASE WHEN signature IN (SELECT signature FROM calls GROUP BY 1 ORDER BY count(*) DESC, signature LIMIT 8) THEN signature ELSE 'other' END AS l FROM calls c JOIN pr USING (doc_id)) GROUP BY doc_id, g, l UNION ALL SELECT 'coverage', c.g, sum(length) / any_value(size) FROM calls c JOIN pr USING (doc_id) GROUP BY doc_id, c.g"


@query(f"WITH {_PROTEINS}, {_SIGNED}, " + _rest_sql(_FRACTIONS))
def property_fractions(spark, d):
    """Coverage, and what the eight commonest signatures and all others take up of a protein: each source against the rest."""
    items = signed(spark, d).join(sized(spark, d).select("doc_id", "size"), "doc_id")
    parts = K.label_fractions(items, ["doc_id", "g"], "signature", "length", "size")
    whole = items.groupBy("doc_id", "g", "size").agg((F.sum("length") / F.col("size")).alias("fraction"))
    long = parts.select(F.concat(F.lit("property_fraction__"), "signature").alias("metric"), "g", "fraction").unionByName(whole.select(F.lit("coverage").alias("metric"), "g", "fraction"))
    return _rested(K.with_rest(long, ["metric"], "g", "fraction"))
