"""Ordered rules: the first that holds gives the primary label, all that hold the full list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.vocabulary import RNA_CLASS_TERMS, TARGET_WORDS
from strandmill.operators.select import fallback_lookup

Rules = list[tuple[str, Column, Column | None]]


UNMAPPED = "unmapped_physicochemical_properties"


def hits_of(rules: Rules) -> Column:
    """array<struct<label, why>> of the (label, condition, evidence) rules that hold."""
    return F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("label"), F.coalesce(e if e is not None else F.lit(n), F.lit(n)).alias("why"))) for n, c, e in rules)), lambda x: x.isNotNull())


def labels_of(hits: Column, fallback: str) -> dict[str, Column]:
    """primary, secondary (array) and evidence (array) of such hits, a column named in a step of its own."""
    return {
        "primary": F.coalesce(F.get(hits, F.lit(0))["label"], F.lit(fallback)),
        "secondary": F.transform(F.filter(hits, lambda x, i: i > 0), lambda x: x["label"]),
        "evidence": F.transform(hits, lambda x: x["why"]),
    }


def first_match(name: Column, tiers: list[tuple[str | None, str]]) -> Column:
    """The label of the first regular expression found in a name, in any case; a label of None rejects."""
    out = None
    for label, pattern in tiers:
        cond, value = name.rlike(f"(?i){pattern}"), F.lit(label).cast("string")
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def signature_hits(cutoff: Column | float | None = None) -> Column:
    """The behaviour signatures that hold, from the columns of ``sequence.with_features``."""
    c = F.col
    two = lambda text, *cols: F.format_string(text, *cols)
    basic = (c("frac_positive") >= 0.25) & (c("ncpr") >= 0.10)
    arg = c("frac_R") >= 0.12
    aromatic = c("frac_aromatic") >= 0.08
    cooc = c("cooc_positive_aromatic")
    top = F.lit(False) if cutoff is None else cooc >= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff))
    # The labels, in their order, with their thresholds.
    rules: Rules = [
        ("rg_rgg_repeat_region", c("RG_repeat_cluster") >= 3, two("RG motif cluster of %d", c("RG_repeat_cluster"))),
        ("sr_rs_repeat_region", c("SR_repeat_cluster") >= 3, two("SR motif cluster of %d", c("SR_repeat_cluster"))),
        ("gs_rich_neutral_region", (c("GS_repeat_cluster") >= 3) | ((c("frac_GS") >= 0.40) & (F.least(c("frac_G"), c("frac_S")) >= 0.10)), two("GS share %.2f, cluster of %d", c("frac_GS"), c("GS_repeat_cluster"))),
        ("arginine_rich_rna_contact_region", basic & arg, two("R share %.2f, positive %.2f, NCPR %.2f", c("frac_R"), c("frac_positive"), c("ncpr"))),
        ("basic_enriched_region", basic & ~arg, two("positive %.2f, NCPR %.2f", c("frac_positive"), c("ncpr"))),
        ("acidic_region", (c("frac_negative") >= 0.25) & (c("ncpr") <= -0.10), two("negative %.2f, NCPR %.2f", c("frac_negative"), c("ncpr"))),
        ("mixed_charge_polyampholyte", (c("fcr") >= 0.30) & (F.abs(c("ncpr")) <= 0.05) & (c("charged_label") == "dispersed"), two("FCR %.2f, NCPR %.2f", c("fcr"), c("ncpr"))),
        ("polar_linker", (c("frac_polar") >= 0.50) & (c("frac_hydrophobic") <= 0.20) & (c("fcr") <= 0.30) & (c("polar_label") == "dispersed"), two("polar %.2f, FCR %.2f", c("frac_polar"), c("fcr"))),
        ("hydrophobic_region", (c("frac_strong_hydro") >= 0.30) & (c("hydrophobic_label") == "compact"), two("strongly hydrophobic %.2f", c("frac_strong_hydro"))),
        ("aromatic_sticker_region", aromatic & (c("aromatic_label") == "dispersed"), two("aromatic %.2f, dispersed", c("frac_aromatic"))),
        ("aromatic_aggregation_prone_region", aromatic & (c("aromatic_label") == "compact"), two("aromatic %.2f, compact", c("frac_aromatic"))),
        ("cation_pi_rich_neighborhood", top, two("co-occurrence %.2f", cooc)),
        ("disorder_rich_spacer_region", c("frac_disorder") >= 0.60, two("disorder %.2f", c("frac_disorder"))),
        ("serine_rich_region", c("frac_S") >= 0.30, two("S %.2f", c("frac_S"))),
        ("glutamine_rich_region", c("frac_Q") >= 0.20, two("Q %.2f", c("frac_Q"))),
        ("glycine_rich_region", c("frac_G") >= 0.25, two("G %.2f", c("frac_G"))),
        ("proline_rich_disordered_region", c("frac_P") >= 0.15, two("P %.2f", c("frac_P"))),
    ]
    return hits_of(rules)


def evidence_classes(df: DataFrame, terms: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """``df`` with primary_class, secondary_class, n_fields, n_hits, evidence_fields and evidence.

    A class is supported by each of its terms in each field. Classes rank by the number of
    different fields, then of hits, then by name."""
    per = []
    for name, patterns in sorted(terms.items()):
        found = [F.when(F.coalesce(F.col(f), F.lit("")).rlike(f"(?i){p}"), F.struct(F.lit(f).alias("field"), F.lit(p).alias("term"))) for f in fields for p in patterns]
        per.append(F.struct(F.lit(name).alias("name"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("hits")))
    some = F.filter(F.array(*per), lambda x: F.size(x["hits"]) > 0)
    n_fields = lambda x: F.size(F.array_distinct(F.transform(x["hits"], lambda h: h["field"])))
    ranked = F.array_sort(F.transform(some, lambda x: F.struct((-n_fields(x)).alias("f"), (-F.size(x["hits"])).alias("h"), x["name"].alias("name"), x["hits"].alias("hits"))))
    out = df.withColumn("__r", ranked).withColumn("__t", F.get("__r", F.lit(0)))
    return out.withColumns(
        {
            "primary_class": F.coalesce(F.col("__t.name"), F.lit("unknown")),
            "secondary_class": F.array_join(F.transform(F.filter("__r", lambda x, i: i > 0), lambda x: x["name"]), "; "),
            "n_fields": F.coalesce(-F.col("__t.f"), F.lit(0)),
            "n_hits": F.coalesce(-F.col("__t.h"), F.lit(0)),
            "evidence_fields": F.coalesce(F.array_distinct(F.transform("__t.hits", lambda h: h["field"])), F.array().cast("array<string>")),
            "evidence": F.coalesce(F.array_join(F.transform("__t.hits", lambda h: F.concat_ws(": ", h["field"], h["term"])), "; "), F.lit("")),
        }
    ).drop("__r", "__t")


def rna_classes(df: DataFrame, direct: list[tuple[str, DataFrame, str]], name: str, go: list[str], others: list[str]) -> DataFrame:
    """``df`` with rna_primary_class, rna_secondary_class, confidence, evidence_source and evidence_matched.

    ``direct`` are lookups in the literature, tried in order (as in ``select.fallback_lookup``,
    the value column being ``rna_primary_class``); what none of them knows is classified by
    terms in the name, the GO fields and other annotation."""
    known = fallback_lookup(df, direct, "rna_primary_class", "__by")
    c = evidence_classes(known, RNA_CLASS_TERMS, [name, *go, *others])
    told = F.col("rna_primary_class").isNotNull()
    fields, some = F.col("evidence_fields"), F.size("evidence_fields") > 0
    only_name = F.forall("evidence_fields", lambda f: f == name)
    certain = F.lower(F.coalesce(F.col(name), F.lit(""))).rlike("|".join(TARGET_WORDS))
    confidence = (
        F.when(told, "very high")
        .when(~some, "unknown")
        .when(F.size(fields) >= 2, "high")
        .when(only_name & certain, "high")
        .when(only_name, "low")
        .otherwise("medium")
    )
    sources = F.concat_ws("; ", F.when(F.arrays_overlap(fields, F.array(*map(F.lit, go))), "GO based"), F.when(F.arrays_overlap(fields, F.array(*map(F.lit, [name, *others]))), "UniProt annotation/metadata"))
    return c.select(
        *df.columns,
        F.coalesce("rna_primary_class", "primary_class").alias("rna_primary_class"),
        F.when(told, "").otherwise(F.col("secondary_class")).alias("rna_secondary_class"),
        confidence.alias("confidence"),
        F.when(told, "literature based").otherwise(sources).alias("evidence_source"),
        F.when(told, F.concat(F.lit("matched by "), F.col("__by"))).otherwise(F.regexp_replace("evidence", r"\\b|\\(?=[.()])", "")).alias("evidence_matched"),
    )


def validation_verdict(internal_fdr: Column, internal: Column, external_fdr: Column, external: Column, carriers: Column, alpha: float = 0.05, least: int = 5) -> Column:
    """How a contrast inside a set compares with the same one against a background."""
    yes = lambda p: F.coalesce(p < alpha, F.lit(False))
    up = lambda x: F.coalesce(x > 0, F.lit(False))
    down = lambda x: F.coalesce(x < 0, F.lit(False))
    enriched, ext = yes(internal_fdr) & up(internal), yes(external_fdr)
    return (
        F.when(external_fdr.isNull() | (carriers < least), "external_underpowered")
        .when(enriched & ext & up(external), "externally_validated")
        .when(enriched & ~ext, "rbp_generic")
        .when(enriched & ext & down(external), "internal_only_artifact")
        .when(~enriched & ext & up(external), "new_external_signal")
        .when(yes(internal_fdr) & down(internal) & ext & down(external), "validated_depletion")
        .otherwise("concordant_null")
    )
