"""Small column functions: identifiers, accessions, bins, interval arithmetic and text normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What accessions look like, strictly and leniently.
ACCESSION_STRICT = "^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9]|[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9][A-Z][A-Z0-9]{2}[0-9])$"
ACCESSION_LENIENT = "^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z0-9]{3}[0-9]|[A-Z0-9]{10})$"


def strip_version(identifier: Column) -> Column:
    """Without a number after the last point."""
    return F.regexp_replace(F.trim(identifier), r"\.[0-9]+$", "")


def is_accession(value: Column, strict: bool = True) -> Column:
    return F.upper(F.trim(value)).rlike(ACCESSION_STRICT if strict else ACCESSION_LENIENT)


def header_accession(header: Column) -> Column:
    """The accession of a FASTA header: the second of ``sp|A|N`` and ``tr|A|N``, else what stands before a bar or space."""
    token = F.split_part(F.regexp_replace(F.trim(header), "^>", ""), F.lit(" "), F.lit(1))
    parts = F.split(token, r"\|")
    return F.trim(F.when(F.get(parts, F.lit(0)).isin("sp", "tr") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))


def gene_of_entry(entry: Column) -> Column:
    return F.split_part(F.upper(F.trim(entry)), F.lit("_"), F.lit(1))


def without_isoform(accession: Column) -> Column:
    return F.split_part(F.upper(F.trim(accession)), F.lit("-"), F.lit(1))


def alnum_key(name: Column) -> Column:
    """Lower case, letters and digits only: for looking up aliases."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "")


def alias(name: Column, aliases: dict[str, str]) -> Column:
    """A name's canonical form, itself where it has none."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(table, alnum_key(name)), F.trim(name))


def cleaned(value: Column) -> Column:
    """Without white space at its ends; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def gene_symbol(value: Column) -> Column:
    return F.upper(cleaned(value))


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of some words as they are written, in any case; false for a null text or no words."""
    if not words:
        return F.lit(False)
    quoted = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words)
    return F.coalesce(text.rlike(f"(?i){quoted}"), F.lit(False))


def provenance(**flags: Column) -> Column:
    """The names of the flags that hold, joined by semicolons."""
    return F.concat_ws(";", *(F.when(c, F.lit(n)) for n, c in flags.items()))


def fill_empty(target: Column, source: Column) -> Column:
    """``source`` where ``target`` is null, blank or the word nan or None."""
    return F.coalesce(F.when(~F.trim(target).isin("", "nan", "None"), target), source)


def right_closed(x: Column, bounds: list[float], labels: list[str]) -> Column:
    """The label of the first bound that is not below x; the last label beyond all."""
    out = F.when(x <= bounds[0], labels[0])
    for b, label in zip(bounds[1:], labels[1:]):
        out = out.when(x <= b, label)
    return out.when(x.isNotNull(), labels[-1])


def sheet_name(name: Column, most: int = 31) -> Column:
    """A name that workbooks allow."""
    return F.left(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), F.lit(most))


# 1-based inclusive intervals


def overlap_length(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Places strictly between two intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), b1 - a2 - 1, a1 - b2 - 1)


def overlap_of_shorter(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return overlap_length(a1, a2, b1, b2) / F.least(a2 - a1 + 1, b2 - b1 + 1)


def at_edge(a1: Column, a2: Column, b1: Column, b2: Column, margin: int = 10) -> Column:
    """Whether an interval overlaps another and crosses one of its ends or comes close to it."""
    crosses = ((a1 < b1) & (b1 <= a2)) | ((a1 <= b2) & (b2 < a2))
    return (overlap_length(a1, a2, b1, b2) > 0) & (crosses | (F.abs(a1 - b1) <= margin) | (F.abs(a2 - b2) <= margin))


def is_sane(start: Column, end: Column, length: Column) -> Column:
    return (start >= 1) & (start <= end) & (end <= length)


def third(start: Column, end: Column, length: Column) -> Column:
    """The third of the whole that the middle of an interval lies in."""
    return right_closed((start + end) / 2 / length, [1 / 3, 2 / 3], ["N-terminal", "middle", "C-terminal"])


def haldane_log2_or(a: Column, b: Column, c: Column, d: Column, null_without_carriers: bool = True) -> Column:
    """log2 odds ratio of (a, b) against (c, d), each cell plus a half."""
    value = F.log2(((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)))
    return F.when((a > 0) & (c > 0), value) if null_without_carriers else value
