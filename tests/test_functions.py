"""Sequence functions, rules and scalar helpers against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.functions import rules as R
from strandmill.functions import scalar as X
from strandmill.functions import sequence as S


def sequences():
    r = random.Random(5)
    some = ["".join(r.choices(S.RESIDUES, k=r.randint(1, 80))) for _ in range(60)]
    return [*some, "", "A", "RGRGRG", "RGAAAAAAAARGAAAAAAAARG", "RGAAAAAAAAARGAAAAAAAAARG", "SRSRSR", "GSGSGS", "KKKKKAAAAAWWWWW", "WWWWWWAAAA", "AWAWAWA", "HHHH", "EEEEKKKK", "S" * 20, "X" * 6, None]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(sequences())), "i int, seq string")


def values(df, **cols):
    rows = df.select("i", *(c.alias(n) for n, c in cols.items())).orderBy("i").collect()
    return {n: [r[n] for r in rows] for n in cols}


def test_composition_and_entropy(table):
    p = S.properties(F.col("seq"))
    got = values(table, entropy=S.entropy(F.col("seq")), **p, **S.composition(F.col("seq")))
    for k, seq in enumerate(sequences()):
        if seq is None:
            continue
        n = len(seq)
        share = lambda letters: sum(c in letters for c in seq) / n if n else 0  # noqa: E731, B023
        assert got["frac_aromatic"][k] == pytest.approx(share("HFWY"))
        assert got["ncpr"][k] == pytest.approx(share("RK") - share("DE"))
        assert got["fcr"][k] == pytest.approx(share("RKDE"))
        known = [c for c in seq if c in S.RESIDUES]
        bits = -sum(known.count(c) / len(known) * math.log2(known.count(c) / len(known)) for c in set(known)) if known else 0
        assert got["entropy"][k] == pytest.approx(bits, abs=1e-9)


def slow_cluster(seq, motif):
    at = [m.start() for m in re.finditer(motif, seq)]
    best = run = 1
    for a, b in zip(at, at[1:]):
        run = run + 1 if b - a <= 10 else 1
        best = max(best, run)
    return best if len(at) >= 3 and best >= 3 else 0


def test_motifs_runs_and_windows(table):
    df = table.withColumn("r", S.run_stats(F.col("seq"), S.AROMATIC))
    got = values(df, rg=S.repeat_cluster(F.col("seq"), S.RG_MOTIF), rs=S.repeat_cluster(F.col("seq"), S.RS_MOTIF), cooc=S.cooccurrence(F.col("seq")), r=F.col("r"))
    for k, seq in enumerate(sequences()):
        if seq is None:
            continue
        assert got["rg"][k] == slow_cluster(seq, S.RG_MOTIF) and got["rs"][k] == slow_cluster(seq, S.RS_MOTIF)
        w = max(5, len(seq) // 4)
        windows = [seq[i : i + w] for i in range(len(seq) - w + 1)]
        both = sum(any(c in "RK" for c in x) and any(c in "HFWY" for c in x) for x in windows)
        assert got["cooc"][k] == pytest.approx(both / len(windows) if windows else 0)
        runs = [m.span() for m in re.finditer("[HFWY]+", seq)]
        gaps = [b[0] - a[1] for a, b in zip(runs, runs[1:])]
        r = got["r"][k]
        assert r.n_runs == len(runs) and r.max_run_length == max((b - a for a, b in runs), default=0)
        if gaps:
            mean = sum(gaps) / len(gaps)
            assert r.mean_gap == pytest.approx(mean)
            assert r.cv_gap == pytest.approx(math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean)
        label = "insufficient" if not runs else "compact" if (len(runs) == 1 and r.max_run_length / len(seq) > 0.4) or (2 <= len(runs) <= 3 and r.max_run_length / len(seq) > 0.35) else "dispersed"
        assert r.label == label


def test_signatures_keep_their_order(spark):
    rows = ["RGRGRGRGRG", "SSSSSSSSSSSSSSSSSSSS", "DDDDEEEEDDDD", "KKKKKKAAAAAA", "VVVVVVVVVVVV", "CCCCCCCCCC", "QQQQQTTTTT"]
    df = S.with_features(spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, seq string")).withColumn("h", R.signature_hits())
    got = values(df, **R.labels_of(F.col("h"), R.UNMAPPED))
    assert got["primary"] == ["rg_rgg_repeat_region", "disorder_rich_spacer_region", "acidic_region", "basic_enriched_region", "hydrophobic_region", "unmapped_physicochemical_properties", "glutamine_rich_region"]
    assert got["secondary"][1] == ["serine_rich_region"] and got["evidence"][1][1] == "S 1.00" and got["evidence"][5] == []


def test_identifiers(spark):
    rows = ["sp|P12345|X_HUMAN desc", "tr|A0A024R214|Y", "P12345|k=v", ">plain text", "ENSP0001.3"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, h string")
    got = values(df, acc=X.header_accession(F.col("h")), bare=X.strip_version(F.col("h")))
    assert got["acc"] == ["P12345", "A0A024R214", "P12345", "plain", "ENSP0001.3"] and got["bare"][4] == "ENSP0001"
    ok = spark.createDataFrame([(0, "P12345"), (1, "A0A024R214"), (2, "A123456789"), (3, "P1234"), (4, None)], "i int, a string")
    got = values(ok, strict=X.is_accession(F.col("a")), lenient=X.is_accession(F.col("a"), strict=False))
    assert got["strict"] == [True, True, False, False, None] and got["lenient"] == [True, True, True, False, None]


def test_bins_and_verdicts(spark):
    df = spark.createDataFrame([(0, 0.3), (1, 0.31), (2, 0.7), (3, 0.71), (4, None)], "i int, x double")
    assert values(df, b=X.right_closed(F.col("x"), [0.3, 0.7], ["a", "b", "c"]))["b"] == ["a", "b", "b", "c", None]
    cases = [(0.01, 1.0, None, 1.0, 9), (0.01, 1.0, 0.01, 1.0, 9), (0.01, 1.0, 0.5, 1.0, 9), (0.01, 1.0, 0.01, -1.0, 9), (0.5, 1.0, 0.01, 1.0, 9), (0.01, -1.0, 0.01, -1.0, 9), (0.5, 1.0, 0.5, None, 9), (0.01, 1.0, 0.01, 1.0, 4)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f1 double, l1 double, f2 double, l2 double, n int")
    got = values(df, v=R.validation_verdict(*(F.col(c) for c in ("f1", "l1", "f2", "l2", "n"))))["v"]
    assert got == ["external_underpowered", "externally_validated", "rbp_generic", "internal_only_artifact", "new_external_signal", "validated_depletion", "concordant_null", "external_underpowered"]


def test_evidence_ranks_by_fields_then_hits_then_name(spark):
    df = spark.createDataFrame([(0, "alpha", "alpha beta"), (1, "beta", None), (2, None, None)], "i int, a string, b string")
    got = {r.i: r for r in R.evidence_classes(df, {"one": ["beta"], "two": ["alpha"]}, ["a", "b"]).collect()}
    assert (got[0].primary_class, got[0].secondary_class, got[0].n_fields) == ("two", "one", 2)
    assert got[1].primary_class == "one" and got[1].evidence == "a: beta" and got[2].primary_class == "unknown"


def test_rna_classes_and_tiers(spark):
    from strandmill.functions.vocabulary import DOMAIN_NAME_TIERS, METHOD_ALIASES

    rows = [("P1", "G1", "anything", None, None), ("P2", "G2", None, "mRNA splicing, via spliceosome", "nucleus"), ("P3", "G3", "tRNA methyltransferase 1", None, None), ("P4", "G4", "PIWI like", None, None), ("P5", "G5", None, None, "SMN complex"), ("P6", "G6", "plain", None, None)]
    df = spark.createDataFrame(rows, "acc string, gene string, name string, go_bp string, location string")
    by_id = spark.createDataFrame([("P1", "old", 1), ("P1", "snRNA", 2)], "k string, rna_primary_class string, ord int")
    got = {r.acc: (r.rna_primary_class, r.confidence, r.evidence_source) for r in R.rna_classes(df, [("acc", by_id, "k")], "name", ["go_bp"], ["location"]).collect()}
    assert got == {"P1": ("snRNA", "very high", "literature based"), "P2": ("mRNA", "medium", "GO based"), "P3": ("tRNA", "high", "UniProt annotation/metadata"), "P4": ("ncRNA", "low", "UniProt annotation/metadata"), "P5": ("snRNA", "medium", "UniProt annotation/metadata"), "P6": ("unknown", "unknown", "")}
    names = ["KH domain", "RNA-dependent polymerase RdRP", "RNase_T", "Ribosomal_L1", "Actin"]
    tier = values(spark.createDataFrame(list(enumerate(names)), "i int, n string"), t=R.first_match(F.col("n"), DOMAIN_NAME_TIERS), m=X.alias(F.lit("SEG (strict)"), METHOD_ALIASES))
    assert tier["t"] == ["direct_RNA_binding", None, "RNA_metabolism", "RNP_component_RNA_pathway", None] and tier["m"][0] == "SEG"
