"""Source divergence audit: how the sources of a language differ in what they say, in exact integers.

A language keeps the terms that at least ``least_docs`` of its documents hold. A group (language,
source), and a language as a whole, gives a kept term of count c the probability
``1 + floor(SCALE * (c + 1) / (N + V))``: N is the count of all kept terms there, V their number.
The divergence of p from q at a term is ``floor((p - q)^2 / q)``.

A pair of sources sums that over all kept terms of the language, of which most are absent from
one side or both. By inclusion and exclusion over the two supports only the terms of both are
ever met: the terms of either side are priced against a zero count on the other by the group's
histogram of counts; postings of equal terms, joined, replace the two wrong prices of a term
that both sides hold by the right one; and the terms that neither holds are a constant times
their number.

Null texts, languages and sources are empty strings. A group without terms, or in a language
that keeps none, has its pairs all the same. Repeated rows are documents of their own. The sums
fit in 64 bits: probabilities add up to SCALE + V at most, so that the sum of p^2 / q is below
(SCALE + V)^2; Spark raises an error on overflow."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm._common import cut, keep, prepare, raw, small

#: A term: a longest run of ASCII letters and of characters beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
SCALE = 1_000_000_000
#: Terms that a task counts before it hands the counts on.
HELD = 400_000
#: Bytes of a text whose terms are listed at once.
PIECE = 4 << 20
#: Groups at most for which their totals are broadcast; with more they are joined.
BROADCAST_ROWS = 20_000


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, in lists of bounded size (or of one longer term)."""
    text, at = text.lower(), 0  # bytes: A to Z only
    while len(text) - at > PIECE:
        end = BREAK.search(text, at + PIECE)
        if end is None:
            break
        yield TERM.findall(text, at, end.start())
        at = end.end()
    yield TERM.findall(text, at)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Partial counts: lang, source, term, n (occurrences), docs (documents with it); several rows may be of one term.

    Every group has rows of an empty term with counts of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        among: dict[tuple, Counter] = {}
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                terms, m = [b"", *counts], len(counts) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * m, pa.string()),
                        pa.array([source] * m, pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array([0, *counts.values()], pa.int64()),
                        pa.array([0, *map(among[lang, source].__getitem__, counts)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in small(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts, own = n.setdefault((lang, source), Counter()), among.setdefault((lang, source), Counter())
                before, met = len(counts), set()
                for some in _terms(text):
                    counts.update(some)
                    met.update(some)
                own.update(met)
                size += len(counts) - before
                if size > HELD:
                    yield from handed()
                    n.clear()
                    among.clear()
                    size = 0
        yield from handed()

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), raw(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); null where there are no terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = F.nullif(wide(total) + wide(terms), F.lit(0).cast("decimal(20,0)"))
    return F.floor(F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), over)).cast("long") + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: by ``pair`` every other source of the language, by ``term`` the group's
    ``top`` terms that it has more often than the language; by value, descending, then item."""
    prepare(docs.sparkSession)
    of_term = W.partitionBy("lang", "term")
    counted = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    totals = counted.select("*", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("of_lang"), (F.min("source").over(of_term) == F.col("source")).alias("once"))
    counts = keep(totals.where((F.col("in_docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "source", "n", "of_lang", "once"), "terms")

    real, own = F.col("term") != "", W.partitionBy("lang")
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real).alias("support"), F.count_if(real & F.col("once")).alias("first_of"), F.coalesce(F.sum(F.when(F.col("once"), F.col("of_lang"))), F.lit(0)).alias("lang_part"))
    by_lang = by_group.groupBy("lang").agg(F.sum("first_of").alias("terms"), F.sum("lang_part").alias("lang_total"))
    groups = by_group.join(by_lang, "lang").withColumn("zero", probability(F.lit(0), F.col("total"), F.col("terms")))
    groups = cut(groups.select("lang", "source", "total", "support", "terms", "lang_total", "zero"))
    known = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    priced = counts.where(real).join(known, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))

    # terms
    q = probability(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    above = priced.where(F.col("n") > 0).withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = above.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    # pairs: each side against zero counts, by histogram
    pairs = groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    pairs = pairs.select("a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.zero").alias("zero"), F.col("b.zero").alias("item_zero"), "a.terms", (F.col("a.terms") - F.col("a.support") - F.col("b.support")).alias("neither"))
    histogram = priced.where(F.col("n") > 0).groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    side = histogram.join(pairs.select("lang", "source", "item", "item_zero"), ["lang", "source"])
    side = side.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * divergence(F.col("p"), F.col("item_zero"))).alias("forth"), F.sum(F.col("m") * divergence(F.col("item_zero"), F.col("p"))).alias("back"))
    swapped = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))

    # terms of both sides: the right price for the two wrong ones, and one absent term fewer
    posted = priced.where(F.col("n") > 0).select("lang", "term", "source", "p", "zero")
    met = posted.join(posted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("zero").alias("item_zero")), ["lang", "term"]).where(F.col("source") < F.col("item"))
    p, r, p0, r0 = (F.col(c) for c in ("p", "r", "zero", "item_zero"))
    mend = lambda p, r, p0, r0: divergence(p, r) - divergence(p, r0) - divergence(p0, r) + divergence(p0, r0)
    both = met.groupBy("lang", "source", "item").agg(F.sum(mend(p, r, p0, r0)).alias("forth"), F.sum(mend(r, p, r0, p0)).alias("back"))

    neither = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("neither") * divergence(F.col("zero"), F.col("item_zero"))).otherwise(F.lit(0)).alias("value"))
    parts = neither
    for df in (side, both):
        parts = parts.unionByName(df.select("lang", "source", "item", F.col("forth").alias("value"))).unionByName(swapped(df))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = summed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))
