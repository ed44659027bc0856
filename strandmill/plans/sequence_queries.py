"""Queries of the sequence functions and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import rules as R
from strandmill.functions import scalar as X
from strandmill.functions import sequence as S
from strandmill.plans.registry import query
from strandmill.plans.tables import SEQUENCES_SQL, read, sequences

six = lambda c: F.round(c, 6)


# SQL for the same functions


def n_sql(letters: str) -> str:
    return f"(length(seq) - length(translate(seq, '{letters}', '')))"


def frac_sql(letters: str) -> str:
    return f"CASE WHEN length(seq) > 0 THEN {n_sql(letters)} / length(seq) ELSE 0 END"


def track_sql(letters: str) -> str:
    """1 at the residues among ``letters``, 0 elsewhere."""
    return f"regexp_replace(regexp_replace(seq, '[{letters}]', '1', 'g'), '[^1]', '0', 'g')"


def lens_sql(text: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: length(x))"


def cluster_sql(motif: str) -> str:
    """The spacing bits from matches and the texts between them."""
    m, g = f"regexp_extract_all(seq, '{motif}')", f"regexp_split_to_array(seq, '{motif}')"
    bits = f"array_to_string(list_transform(range(1, len({m})), lambda i: CASE WHEN length({m}[i]) + length({g}[i + 1]) <= 10 THEN '1' ELSE '0' END), '')"
    best = f"(coalesce(list_max({lens_sql(bits, '1+')}), 0) + 1)"
    return f"CASE WHEN len({m}) >= 3 AND {best} >= 3 THEN {best} ELSE 0 END::INTEGER"


def label_sql(letters: str) -> str:
    runs = lens_sql(track_sql(letters), "1+")
    share = f"list_max({runs}) / length(seq)"
    return f"CASE WHEN len({runs}) = 0 THEN 'insufficient' WHEN len({runs}) = 1 AND {share} > 0.4 THEN 'compact' WHEN len({runs}) BETWEEN 2 AND 3 AND {share} > 0.35 THEN 'compact' ELSE 'dispersed' END"


def cooc_sql() -> str:
    w = "greatest(5, length(seq) // 4)"
    without = lambda letters: f"coalesce(list_sum(list_transform({lens_sql(track_sql(letters), '0+')}, lambda r: greatest(r - {w} + 1, 0))), 0)"
    n = f"(length(seq) - {w} + 1)"
    return f"CASE WHEN length(seq) >= {w} THEN ({n} - {without(S.POSITIVE)} - {without(S.AROMATIC)} + {without(S.POSITIVE + S.AROMATIC)}) / {n} ELSE 0 END"


@query(f"""WITH {SEQUENCES_SQL}, f AS (SELECT source, length(seq) AS n, {frac_sql("DE")} AS neg, {frac_sql("RK")} AS pos FROM p), g AS (
SELECT source, n, CASE WHEN neg >= 0.12 AND pos - neg <= -0.02 THEN 'acidic' WHEN pos >= 0.12 AND pos - neg >= 0.02 THEN 'basic' WHEN pos + neg >= 0.20 AND abs(pos - neg) <= 0.05 THEN 'polyampholyte' ELSE 'unmapped' END AS charge_class FROM f)
SELECT source, charge_class, count(*) AS n, median(n)::DOUBLE AS median_length FROM g GROUP BY ALL""")
def charge_classes(spark, d):
    p = sequences(spark, d)
    seq = F.col("seq")
    pos, neg = S.fraction(seq, S.POSITIVE), S.fraction(seq, S.NEGATIVE)
    f = p.select("source", F.length("seq").alias("n"), pos.alias("pos"), neg.alias("neg"))
    net = F.col("pos") - F.col("neg")
    rules = [("acidic", (F.col("neg") >= 0.12) & (net <= -0.02), None), ("basic", (F.col("pos") >= 0.12) & (net >= 0.02), None), ("polyampholyte", (F.col("pos") + F.col("neg") >= 0.20) & (F.abs(net) <= 0.05), None)]
    return f.withColumn("hits", R.hits_of(rules)).withColumn("charge_class", R.labels_of(F.col("hits"), "unmapped")["primary"]).groupBy("source", "charge_class").agg(F.count(F.lit(1)).alias("n"), F.median("n").alias("median_length"))


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, " + ", ".join(f"round({frac_sql(a)}, 6) AS frac_{a}" for a in S.RESIDUES) + " FROM p")
def seq_composition(spark, d):
    return sequences(spark, d).select("doc_id", *(six(v).alias(k) for k, v in S.composition(F.col("seq")).items()))


_PROPS = {"frac_polar": frac_sql(S.POLAR), "frac_hydrophobic": frac_sql(S.HYDROPHOBIC), "frac_strong_hydro": frac_sql(S.STRONG_HYDROPHOBIC), "frac_aromatic": frac_sql(S.AROMATIC), "frac_disorder": frac_sql(S.DISORDER), "frac_positive": frac_sql("RK"), "frac_negative": frac_sql("DE"), "fcr": frac_sql("RKDE"), "ncpr": f"CASE WHEN length(seq) > 0 THEN ({n_sql('RK')} - {n_sql('DE')}) / length(seq) ELSE 0 END", "frac_GS": frac_sql("GS")}


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _PROPS.items()) + " FROM p")
def seq_properties(spark, d):
    return sequences(spark, d).select("doc_id", *(six(v).alias(k) for k, v in S.properties(F.col("seq")).items()))


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, round(" + " + ".join(f"CASE WHEN {n_sql(a)} > 0 THEN -({n_sql(a)} / length(seq)) * log2({n_sql(a)} / length(seq)) ELSE 0 END" for a in S.RESIDUES) + ", 6) AS entropy FROM p")
def seq_entropy(spark, d):
    return sequences(spark, d).select("doc_id", six(S.entropy(F.col("seq"))).alias("entropy"))


@query("WITH u AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, length(p_name) AS n FROM part), v AS (SELECT p_partkey, c, count(*) / any_value(n) AS q FROM u GROUP BY 1, 2) SELECT p_partkey, round(sum(-q * log2(q)), 6) AS entropy FROM v GROUP BY 1")
def entropy_observed(spark, d):
    return read(spark, d, "part").select("p_partkey", six(S.entropy_observed(F.col("p_name"))).alias("entropy"))


@query(f"WITH {SEQUENCES_SQL}, c AS (SELECT doc_id, length(seq) AS n, list_max([" + ", ".join(f"{{'n': {n_sql(a)}, 'l': '{a}'}}" for a in S.RESIDUES) + "]) AS t FROM p) SELECT doc_id, CASE WHEN t.n > 0 THEN t.l END AS letter, CASE WHEN n > 0 THEN round(t.n / n, 6) END AS share, CASE WHEN n > 0 THEN round(log10(n), 6) END AS log_length FROM c")
def dominant_residue(spark, d):
    p = sequences(spark, d).withColumn("t", S.dominant(F.col("seq")))
    return p.select("doc_id", "t.letter", six(F.col("t.share")).alias("share"), six(F.when(F.length("seq") > 0, F.log10(F.length("seq")))).alias("log_length"))


_MOTIFS = {"n_RG_motifs": S.RG_MOTIF, "n_SR_motifs": S.RS_MOTIF, "n_GS_motifs": S.GS_MOTIF}


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(seq, '{m}'))::INTEGER AS {k}" for k, m in _MOTIFS.items()) + ", " + ", ".join(f"regexp_matches(seq, '{m}') AS {k}" for k, m in S.PRESENCE_MOTIFS.items()) + " FROM p")
def motif_counts(spark, d):
    seq = F.col("seq")
    return sequences(spark, d).select("doc_id", *(S.motif_count(seq, m).alias(k) for k, m in _MOTIFS.items()), *(seq.rlike(m).alias(k) for k, m in S.PRESENCE_MOTIFS.items()))


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, {cluster_sql(S.RG_MOTIF)} AS rg, {cluster_sql(S.RS_MOTIF)} AS rs, {cluster_sql(S.GS_MOTIF)} AS gs FROM p")
def repeat_cluster(spark, d):
    seq = F.col("seq")
    return sequences(spark, d).select("doc_id", S.repeat_cluster(seq, S.RG_MOTIF).alias("rg"), S.repeat_cluster(seq, S.RS_MOTIF).alias("rs"), S.repeat_cluster(seq, S.GS_MOTIF).alias("gs"))


def _run_sql(letters: str) -> str:
    b = track_sql(letters)
    runs, gaps = lens_sql(b, "1+"), lens_sql(f"regexp_replace({b}, '^0+|0+$', '', 'g')", "0+")
    return f"SELECT doc_id, {runs} AS r, {gaps} AS g, {label_sql(letters)} AS label FROM p"


@query(f"WITH {SEQUENCES_SQL}, t AS ({_run_sql(S.AROMATIC)}) SELECT doc_id, len(r)::INTEGER AS n_runs, round(list_avg(r), 6) AS mean_run_length, coalesce(list_max(r), 0)::INTEGER AS max_run_length, CASE WHEN len(r) >= 2 THEN round(list_avg(g), 6) END AS mean_gap, CASE WHEN len(r) >= 2 THEN round(list_stddev_pop(g) / list_avg(g), 6) END AS cv_gap, label FROM t")
def run_gap_stats(spark, d):
    p = sequences(spark, d).withColumn("r", S.run_stats(F.col("seq"), S.AROMATIC))
    return p.select("doc_id", "r.n_runs", *(six(F.col(f"r.{c}")).alias(c) for c in ("mean_run_length", "mean_gap", "cv_gap")), "r.max_run_length", "r.label")


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, " + ", ".join(f"{label_sql(v)} AS {k}" for k, v in S.TRACKS.items()) + " FROM p WHERE length(seq) > 0")
def track_labels(spark, d):
    return sequences(spark, d).where(F.length("seq") > 0).select("doc_id", *(S.run_label(F.col("seq"), v).alias(k) for k, v in S.TRACKS.items()))


@query(f"WITH {SEQUENCES_SQL} SELECT doc_id, round({cooc_sql()}, 6) AS cooc FROM p")
def cooccurrence(spark, d):
    return sequences(spark, d).select("doc_id", six(S.cooccurrence(F.col("seq"))).alias("cooc"))


@query(f"WITH {SEQUENCES_SQL} SELECT round(quantile_cont({cooc_sql()}, 0.75), 6) AS cutoff FROM p")
def cooc_cutoff(spark, d):
    return sequences(spark, d).agg(six(F.percentile(S.cooccurrence(F.col("seq")), 0.75)).alias("cutoff"))


_FEATURES_SQL = ", ".join([*(f"{frac_sql(a)} AS frac_{a}" for a in "RSQGP"), *(f"{v} AS {k}" for k, v in _PROPS.items()), f"{cluster_sql(S.RG_MOTIF)} AS rg", f"{cluster_sql(S.RS_MOTIF)} AS sr", f"{cluster_sql(S.GS_MOTIF)} AS gs", *(f"{label_sql(S.TRACKS[t])} AS {t}_label" for t in ("charged", "polar", "hydrophobic", "aromatic")), f"{cooc_sql()} AS cooc"])
_SIGNATURES_SQL = """[CASE WHEN rg >= 3 THEN 'rg_rgg_repeat_region' END, CASE WHEN sr >= 3 THEN 'sr_rs_repeat_region' END,
CASE WHEN gs >= 3 OR (frac_GS >= 0.4 AND least(frac_G, frac_S) >= 0.1) THEN 'gs_rich_neutral_region' END,
CASE WHEN frac_positive >= 0.25 AND ncpr >= 0.1 AND frac_R >= 0.12 THEN 'arginine_rich_rna_contact_region' END,
CASE WHEN frac_positive >= 0.25 AND ncpr >= 0.1 AND frac_R < 0.12 THEN 'basic_enriched_region' END,
CASE WHEN frac_negative >= 0.25 AND ncpr <= -0.1 THEN 'acidic_region' END,
CASE WHEN fcr >= 0.3 AND abs(ncpr) <= 0.05 AND charged_label = 'dispersed' THEN 'mixed_charge_polyampholyte' END,
CASE WHEN frac_polar >= 0.5 AND frac_hydrophobic <= 0.2 AND fcr <= 0.3 AND polar_label = 'dispersed' THEN 'polar_linker' END,
CASE WHEN frac_strong_hydro >= 0.3 AND hydrophobic_label = 'compact' THEN 'hydrophobic_region' END,
CASE WHEN frac_aromatic >= 0.08 AND aromatic_label = 'dispersed' THEN 'aromatic_sticker_region' END,
CASE WHEN frac_aromatic >= 0.08 AND aromatic_label = 'compact' THEN 'aromatic_aggregation_prone_region' END,
CASE WHEN cooc >= cutoff THEN 'cation_pi_rich_neighborhood' END, CASE WHEN frac_disorder >= 0.6 THEN 'disorder_rich_spacer_region' END,
CASE WHEN frac_S >= 0.3 THEN 'serine_rich_region' END, CASE WHEN frac_Q >= 0.2 THEN 'glutamine_rich_region' END,
CASE WHEN frac_G >= 0.25 THEN 'glycine_rich_region' END, CASE WHEN frac_P >= 0.15 THEN 'proline_rich_disordered_region' END]"""
_SIG_SQL = f"WITH {SEQUENCES_SQL}, f AS (SELECT doc_id, {_FEATURES_SQL} FROM p WHERE length(seq) > 0), c AS (SELECT quantile_cont({cooc_sql()}, 0.75) AS cutoff FROM p), l AS (SELECT doc_id, list_filter({_SIGNATURES_SQL}, lambda x: x IS NOT NULL) AS l FROM f, c)"


def _signed(spark, d):
    """Features first, rules next: an expression is then planned once."""
    s = sequences(spark, d)
    cutoff = s.agg(F.percentile(S.cooccurrence(F.col("seq")), 0.75).alias("cutoff"))
    f = S.with_features(s.where(F.length("seq") > 0))
    return f.join(F.broadcast(cutoff), how="cross").withColumn("hits", R.signature_hits(cutoff=F.col("cutoff"))).select("doc_id", "source", *(v.alias(k) for k, v in R.labels_of(F.col("hits"), R.UNMAPPED).items()))


@query(_SIG_SQL + " SELECT coalesce(l[1], 'unmapped_physicochemical_properties') AS signature, count(*) AS n FROM l GROUP BY 1")
def signature_primary(spark, d):
    return _signed(spark, d).groupBy(F.col("primary").alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query(_SIG_SQL + " SELECT doc_id, coalesce(l[1], 'unmapped_physicochemical_properties') AS primary_label, array_to_string(l[2:], '; ') AS secondary_labels, len(l)::INTEGER AS n_evidence FROM l")
def signature_all(spark, d):
    return _signed(spark, d).select("doc_id", F.col("primary").alias("primary_label"), F.array_join("secondary", "; ").alias("secondary_labels"), F.size("evidence").alias("n_evidence"))


# Name tiers, in the order in which they are tried.
TIERS = [(None, "small|plated"), ("direct_RNA_binding", "brass|anodized.*steel"), ("RNA_metabolism", "steel|burnished"), ("RNP_component_RNA_pathway", "tin|copper")]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)small|plated') THEN NULL WHEN regexp_matches(p_type, '(?i)brass|anodized.*steel') THEN 'direct_RNA_binding' WHEN regexp_matches(p_type, '(?i)steel|burnished') THEN 'RNA_metabolism' WHEN regexp_matches(p_type, '(?i)tin|copper') THEN 'RNP_component_RNA_pathway' END AS tier, CASE WHEN regexp_matches(p_type, '(?i)small|plated') THEN 'excluded' WHEN regexp_matches(p_type, '(?i)brass|anodized.*steel|steel|burnished|tin|copper') THEN 'kept' ELSE 'review' END AS audit FROM part")
def tier_regex(spark, d):
    name = F.col("p_type")
    tier = R.first_match(name, TIERS)
    audit = F.when(name.rlike("(?i)" + TIERS[0][1]), "excluded").when(tier.isNotNull(), "kept").otherwise("review")
    return read(spark, d, "part").select("p_partkey", tier.alias("tier"), audit.alias("audit"))


TERMS = {"article": ["<nav", "<article"], "script": ["<script", "track"], "style": ["<style", "margin"], "table": ["<table", "<td", "<tr"]}


def _evidence_sql() -> str:
    per = []
    for name, terms in sorted(TERMS.items()):
        hit = lambda f, p: f"regexp_matches(coalesce({f}, ''), '(?i){p}')::INTEGER"
        hits = " + ".join(hit(f, p) for f in ("url", "html") for p in terms)
        fields = " + ".join("greatest(" + ", ".join(hit(f, p) for p in terms) + ")" for f in ("url", "html"))
        per.append(f"{{'f': -({fields}), 'h': -({hits}), 'n': '{name}'}}")
    return f"WITH r AS (SELECT page_id, list_sort(list_filter([{', '.join(per)}], lambda x: x.h < 0)) AS r FROM pages) SELECT page_id, coalesce(r[1].n, 'unknown') AS primary_class, array_to_string(list_transform(r[2:], lambda x: x.n), '; ') AS secondary_class, coalesce(-r[1].f, 0)::INTEGER AS n_fields, coalesce(-r[1].h, 0)::INTEGER AS n_hits FROM r"


@query(_evidence_sql())
def evidence_classifier(spark, d):
    return R.evidence_classes(read(spark, d, "pages"), TERMS, ["url", "html"]).select("page_id", "primary_class", "secondary_class", "n_fields", "n_hits")


@query("SELECT s_suppkey, regexp_replace(trim(s_name || '.' || s_nationkey), '\\.[0-9]+$', '') AS stripped, regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '', 'g') AS alnum, s_name || CASE WHEN s_acctbal > 0 THEN '|pos' ELSE '' END AS header, left(replace(s_name, '#', ':'), 10) AS sheet, sha256(s_name) AS digest, regexp_matches(upper(s_name), '^(?:[OPQ][0-9][A-Z0-9]{3}[0-9])$') AS is_acc FROM supplier")
def identifiers(spark, d):
    s = read(spark, d, "supplier")
    n = F.col("s_name")
    return s.select("s_suppkey", X.strip_version(F.concat(n, F.lit("."), F.col("s_nationkey"))).alias("stripped"), X.alnum_key(n).alias("alnum"), F.concat(n, F.when(F.col("s_acctbal") > 0, "|pos").otherwise("")).alias("header"), F.left(F.replace(n, F.lit("#"), F.lit(":")), F.lit(10)).alias("sheet"), F.sha2(n, 256).alias("digest"), X.is_accession(n).alias("is_acc"))


@query("SELECT event_type, f AS field, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS f FROM events) GROUP BY ALL")
def json_fields(spark, d):
    """The keys of each event's properties, by event type."""
    e = read(spark, d, "events")
    return e.select("event_type", F.explode(F.json_object_keys("props")).alias("field")).groupBy("event_type", "field").agg(F.count(F.lit(1)).alias("n"))
