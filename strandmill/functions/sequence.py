"""Column functions over residue sequences: composition, entropy, motifs, runs and co-occurrence.

All are closed Spark expressions: no UDF, linear in the sequence's length. A null sequence
gives null unless said otherwise; an empty one gives 0 or, for means, null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 20 residues and the classes they belong to.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
POLAR = "RNDQEHKSTWY"
HYDROPHOBIC = "ACGHIKLMFTWYV"
AROMATIC = "HFWY"
DISORDER = "ARQEGKPS"
POSITIVE = "RK"
NEGATIVE = "DE"
STRONG_HYDROPHOBIC = "VILMFWY"
# Motifs of repeat regions and of presence flags.
RG_MOTIF = "RG{1,2}|RPR"
RS_MOTIF = "RS|SR"
GS_MOTIF = "GS|SG"
PRESENCE_MOTIFS = {"RGG_RGGbox": "RGG", "RG": "RG", "SR_RS": "SR|RS", "YR": "YR", "FG": "FG", "PXXP": "P..P"}

TRACKS = {"polar": POLAR, "hydrophobic": HYDROPHOBIC, "aromatic": AROMATIC, "disorder": DISORDER, "charged": POSITIVE + NEGATIVE}


def clean(text: Column) -> Column:
    """A text's residue letters, upper case; everything else is dropped."""
    return F.upper(F.regexp_replace(text, f"[^{RESIDUES}{RESIDUES.lower()}]+", ""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(seq: Column, letters: str) -> Column:
    """How many of a sequence's residues are among ``letters``.

    A sum over single letters, so that a step that asks for many classes counts each letter once."""
    each = [F.octet_length(seq) - F.octet_length(F.replace(seq, F.lit(a), F.lit(""))) for a in letters]
    return sum(each[1:], each[0])


def per_residue(n: Column, seq: Column) -> Column:
    """A count over the whole length, unknown residues included; 0 for an empty sequence.

    No count stands in a branch: Spark then computes what several columns share once."""
    return F.coalesce(F.try_divide(n, F.length(seq)), F.when(seq.isNotNull(), 0.0))


def fraction(seq: Column, letters: str) -> Column:
    """The share of a sequence's residues that are among ``letters``."""
    return per_residue(count_of(seq, letters), seq)


def composition(seq: Column) -> dict[str, Column]:
    """The 20 residue fractions."""
    return {f"frac_{a}": fraction(seq, a) for a in RESIDUES}


def properties(seq: Column) -> dict[str, Column]:
    """The ten physicochemical fractions; FCR and NCPR are the sum and difference of the charged ones."""
    positive, negative = count_of(seq, POSITIVE), count_of(seq, NEGATIVE)
    return {
        "frac_polar": fraction(seq, POLAR),
        "frac_hydrophobic": fraction(seq, HYDROPHOBIC),
        "frac_strong_hydro": fraction(seq, STRONG_HYDROPHOBIC),
        "frac_aromatic": fraction(seq, AROMATIC),
        "frac_disorder": fraction(seq, DISORDER),
        "frac_positive": fraction(seq, POSITIVE),
        "frac_negative": fraction(seq, NEGATIVE),
        "fcr": per_residue(positive + negative, seq),
        "ncpr": per_residue(positive - negative, seq),
        "frac_GS": fraction(seq, "GS"),
    }


def entropy(seq: Column) -> Column:
    """Shannon entropy in bits over the 20 residues."""
    counts = F.array(*(count_of(seq, a) for a in RESIDUES))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    bits = lambda c, n: F.aggregate(c, F.lit(0.0), lambda a, v: F.when(v > 0, a - (v / n) * F.log2(v / n)).otherwise(a))
    return let(counts, lambda c: let(total(c), lambda n: F.when(n > 0, bits(c, n)).otherwise(0.0)))


def entropy_observed(text: Column) -> Column:
    """Shannon entropy in bits over whatever characters occur."""
    bits = lambda x: F.aggregate(
        F.array_distinct(x["letters"]),
        F.lit(0.0),
        lambda a, c: let((F.octet_length(text) - F.octet_length(F.replace(text, c, F.lit("")))) / F.octet_length(c) / x["n"], lambda p: a - p * F.log2(p)),
    )
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return let(letters, lambda x: let(F.struct(x.alias("letters"), F.size(x).alias("n")), bits))


def dominant(seq: Column) -> Column:
    """struct(letter, share): the commonest residue, ties to the later letter."""
    counts = F.array(*(F.struct(count_of(seq, a).alias("n"), F.lit(a).alias("letter")) for a in RESIDUES))
    return let(F.array_max(counts), lambda t: F.struct(F.when(t["n"] > 0, t["letter"]).alias("letter"), F.try_divide(t["n"], F.length(seq)).alias("share")))


def motif_count(seq: Column, motif: str) -> Column:
    """Matches that do not overlap."""
    return F.regexp_count(seq, F.lit(motif))


def _longest(bits: Column, of: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(bits, F.lit(f"({of}+)"), F.lit(1)), F.length)), F.lit(0))


def repeat_cluster(seq: Column, motif: str, min_repeats: int = 3, max_spacing: int = 10) -> Column:
    """The longest chain of matches whose starts lie at most ``max_spacing`` apart, 0 below ``min_repeats``."""
    size = lambda x: F.transform(x, F.length)
    both = F.struct(size(F.regexp_extract_all(seq, F.lit(motif), F.lit(0))).alias("found"), size(F.split(seq, motif)).alias("gaps"))

    def chain(x: Column) -> Column:
        # the next start is a match and the text after it away
        steps = F.zip_with(x["found"], F.slice(x["gaps"], 2, F.greatest(F.size(x["gaps"]) - 2, F.lit(0))), lambda f, g: f + g)
        bits = F.array_join(F.transform(steps, lambda d: F.when(d <= max_spacing, "1").otherwise("0")), "")
        return let(_longest(bits, "1") + 1, lambda best: F.when((F.size(x["found"]) >= F.greatest(F.lit(min_repeats), F.lit(2))) & (best >= min_repeats), best).otherwise(0))

    return F.when(seq.isNotNull(), let(both, chain))


def _lengths(seq: Column, letters: str, least: int = 1) -> Column:
    """The lengths of the runs, of at least so many, of ``letters``, a regular expression's class without brackets."""
    return F.transform(F.regexp_extract_all(seq, F.lit(f"[{letters}]{{{least},}}"), F.lit(0)), F.length)


def run_stats(seq: Column, letters: str) -> Column:
    """struct(n_runs, mean_run_length, max_run_length, mean_gap, cv_gap, label) of the residues among ``letters``.

    Gaps lie between runs; their variation is that of a population. A caller that reads several
    fields names the struct in a step of its own."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    between = F.split(seq, f"[{letters}]+")
    both = F.struct(_lengths(seq, letters).alias("runs"), F.transform(F.slice(between, 2, F.greatest(F.size(between) - 2, F.lit(0))), F.length).alias("gaps"), F.length(seq).alias("length"))
    sums = let(both, lambda x: F.struct(F.size(x["runs"]).alias("n"), total(x["runs"]).alias("inside"), F.coalesce(F.array_max(x["runs"]), F.lit(0)).alias("longest"), x["gaps"].alias("gaps"), x["length"].alias("length"), F.when(F.size(x["runs"]) >= 2, total(x["gaps"]) / F.size(x["gaps"])).alias("mean_gap")))

    def fields(x: Column) -> Column:
        spread = F.sqrt(F.aggregate(x["gaps"], F.lit(0.0), lambda a, v: a + (v - x["mean_gap"]) * (v - x["mean_gap"])) / F.size(x["gaps"]))
        return F.struct(
            x["n"].alias("n_runs"),
            F.when(x["n"] > 0, x["inside"] / x["n"]).alias("mean_run_length"),
            x["longest"].alias("max_run_length"),
            x["mean_gap"].alias("mean_gap"),
            F.when(x["n"] >= 2, spread / x["mean_gap"]).alias("cv_gap"),
            _label(x["n"], x["longest"] / x["length"]).alias("label"),
        )

    return let(sums, fields)


def _label(n: Column, share: Column) -> Column:
    """How runs lie, by their number and the longest one's share of the sequence."""
    return (
        F.when(n == 0, "insufficient")
        .when((n == 1) & (share > 0.4), "compact")
        .when((n >= 2) & (n <= 3) & (share > 0.35), "compact")
        .when(n >= 1, "dispersed")
    )


def run_label(seq: Column, letters: str) -> Column:
    """The label of ``run_stats`` alone. Four runs or more are dispersed, which the start of a long sequence shows."""
    many = seq.rlike(f"^[^{letters}]*+(?:[{letters}]++[^{letters}]++){{3}}[{letters}]")
    few = let(F.struct(_lengths(seq, letters).alias("runs"), F.length(seq).alias("length")), lambda x: _label(F.size(x["runs"]), F.array_max(x["runs"]) / x["length"]))
    return F.when(many, "dispersed").when(seq.isNotNull(), few)


def cooccurrence(seq: Column, first: str = POSITIVE, second: str = AROMATIC) -> Column:
    """The share of windows (a quarter of the length, 5 at least) that hold a residue of either kind.

    Windows without a kind lie in its absence's runs, so that lengths of runs give all counts."""
    least = 5
    without = lambda letters: _lengths(seq, f"^{letters}", least)
    sizes = F.struct(F.length(seq).alias("length"), F.greatest(F.lit(least), F.floor(F.length(seq) / 4).cast("int")).alias("w"), without(first).alias("a"), without(second).alias("b"), without(first + second).alias("c"))

    def share(x: Column) -> Column:
        inside = lambda runs: F.aggregate(runs, F.lit(0), lambda a, r: a + F.greatest(r - x["w"] + 1, F.lit(0)))
        n = x["length"] - x["w"] + 1
        return F.when(n >= 1, (n - inside(x["a"]) - inside(x["b"]) + inside(x["c"])) / n).otherwise(0.0)

    return F.when(seq.isNotNull(), let(sizes, share))


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of so many letters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def with_features(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` with every feature that the signature rules read."""
    c = F.col(seq)
    out = df.withColumns({"length": F.length(c), **composition(c), **properties(c), "cooc_positive_aromatic": cooccurrence(c)})
    for name, motif in (("RG", RG_MOTIF), ("SR", RS_MOTIF), ("GS", GS_MOTIF)):
        out = out.withColumns({f"n_{name}_motifs": motif_count(c, motif), f"{name}_repeat_cluster": repeat_cluster(c, motif)})
    out = out.withColumns({f"__{name}": run_stats(c, letters) for name, letters in TRACKS.items()})
    fields = ("n_runs", "mean_run_length", "max_run_length", "mean_gap", "cv_gap")
    stats = {f"{name}_{f}": F.col(f"__{name}.{f}") for name in TRACKS for f in fields}
    labels = {f"{name}_label": run_label(c, letters) for name, letters in TRACKS.items()}
    return out.withColumns(stats | labels).drop(*(f"__{name}" for name in TRACKS))
