"""Mixing sources to target weights: Sainte-Laguë quotas of words and equal blocks, then seeded blocks.

A source's target is its share of all words, stopped at ``max_epochs`` times the source and
the excess shared anew. Each source's documents lie end to end, in a seeded order, in shards
of bounded size; a shard is cut into blocks of equal numbers of words, at least a thousand to
a shard of full size and one word each in small sources. Words go to sources by the highest
quotients target / (2 * taken + 1); a source's words are a number of its blocks, by the mean
of their real words, and these go to its shards likewise. A shard then takes its quota: whole
rounds of all its blocks and, of a further round, the blocks that a seeded permutation puts first.

The driver plans over totals only: a row per source and shard, at most ``max_shards`` shards
besides one per source. A null text has size 0; null is a source of its own, after the others.
Repeated rows are documents of their own. Sources without words have the target 0."""

from __future__ import annotations

import hashlib
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm._common import GAP, WORD, cut, numbered, prepare

#: Sources at most for which the plan is broadcast; with more it is joined.
BROADCAST_ROWS = 10_000
#: Blocks at least to a shard of full size.
BLOCKS = 1000


def n_words(text: Column) -> Column:
    """The number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[int], max_epochs: int = 3) -> list[Fraction]:
    """Targets that share the sum of ``sizes`` by weight, none above ``max_epochs`` times its size."""
    total, target = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        each = left / sum(weights[i] for i in free)
        over = [i for i in free if each * weights[i] > max_epochs * sizes[i]]
        if not over:
            for i in free:
                target[i] = each * weights[i]
            break
        for i in over:
            target[i] = Fraction(max_epochs * sizes[i])
            free.discard(i)
    return target


def sainte_lague(claims: list[Fraction], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients claim / (2 * held + 1), ties to the first; ``most`` bounds a party's seats."""
    total = sum(claims)
    most = most if most is not None else [seats] * len(claims)
    held = [0] * len(claims)
    seats = min(seats, sum(m for m, c in zip(most, claims) if c))
    if not total or seats <= 0:
        return held
    # with a divisor a little too large every seat given is one that the highest quotients give as well
    divisor = float(total / seats)
    while sum(held := [min(m, int(c / Fraction(divisor) + Fraction(1, 2))) for c, m in zip(claims, most)]) > seats:
        divisor *= 1 + max(1e-9, min(0.001, len(claims) / seats)) if len(claims) < seats else 2.0
    heap = [(-c / (2 * h + 1), i) for i, (c, h, m) in enumerate(zip(claims, held, most)) if c and h < m]
    heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heappush(heap, (-claims[i] / (2 * held[i] + 1), i))
    return held


def _permutation(blocks: int, seed: str) -> tuple[int, int]:
    """A seeded step without a common divisor with the number of blocks, and a seeded start."""
    h = hashlib.sha256(seed.encode()).digest()
    step, start = int.from_bytes(h[:8], "big") % max(1, blocks), int.from_bytes(h[8:16], "big") % max(1, blocks)
    while gcd(step, max(1, blocks)) != 1:
        step += 1
    return step % max(1, blocks), start


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix", source_col: str = "source", text_col: str = "text", order_col: str = "doc_id", **shards) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``mix_blocks`` in place of the text and of columns of these names.

    ``mix_blocks`` lists the document's pieces in order: words (from, to) and how often the mix takes them."""
    prepare(docs.sparkSession)
    own = ["size", "source_size", "target", "taken", "mix_blocks"]
    rest = [c for c in docs.columns if c not in (*own, text_col)]
    # words are counted once; the input's columns go along in one, whatever their names
    sized = cut(docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in rest)).alias("__mix_doc"), *_asked(source_col, order_col, text_col)))
    planned = _planned(sized, weights, max_epochs, seed, **shards)
    return planned.select(*(F.col("__mix_doc").getField(c).alias(c) for c in rest), *(F.col(f"__mix_{c.removeprefix('mix_')}").alias(c) for c in own))


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix", source_col: str = "source", text_col: str = "text", order_col: str = "doc_id", n_chars_col: str = "n_chars", **shards) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and round that takes words of it.

    A round that takes the whole document leaves its text unchanged; one that takes some of its
    blocks gives their words, joined by single spaces. Texts take no part in laying out shards:
    they meet the plan by the numbers of their rows."""
    prepare(docs.sparkSession)
    stored, row = numbered(docs, "docs")
    sized = cut(stored.select(row, *_asked(source_col, order_col, text_col)))
    plan = _planned(sized, weights, max_epochs, seed, **shards).where("__mix_taken > 0").select(row, "__mix_blocks")
    whole = stored.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__mix_doc"), F.col(f"`{text_col}`").alias("__mix_text"), row)
    rounds = whole.join(plan, row).withColumn("__mix_round", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("__mix_blocks", lambda b: b["times"])).cast("int"))))
    words = F.filter(F.split("__mix_text", GAP), lambda w: w != "")
    here = F.filter("__mix_blocks", lambda b: b["times"] >= F.col("__mix_round"))
    some = F.array_join(F.flatten(F.transform(here, lambda b: F.slice(words, b["from"].cast("int") + 1, (b["to"] - b["from"]).cast("int")))), " ")
    out = rounds.withColumn("__mix_text", F.when(F.size(here) == F.size("__mix_blocks"), F.col("__mix_text")).otherwise(some))
    new = {text_col: F.col("__mix_text")}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.length("__mix_text").cast(docs.schema[n_chars_col].dataType)
    return out.select(*((new[c] if c in new else F.col("__mix_doc").getField(c)).alias(c) for c in docs.columns))


def _asked(source_col: str, order_col: str, text_col: str) -> list[Column]:
    return [F.col(source_col).alias("__mix_source"), F.col(order_col).alias("__mix_order"), n_words(F.col(text_col)).alias("__mix_size")]


def _planned(sized: DataFrame, weights, max_epochs: int, seed: str, words_per_shard: int = 100_000, max_shards: int = 20_000, blocks_per_source: int = 4096) -> DataFrame:
    """A stored table of ``__mix_source``, ``__mix_order`` and ``__mix_size`` with ``__mix_source_size``, ``__mix_target``, ``__mix_taken`` and ``__mix_blocks``."""
    spark = sized.sparkSession
    totals = sorted(((r[0], int(r[1])) for r in sized.groupBy("__mix_source").agg(F.sum("__mix_size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(n for _, n in totals)
    target = water_fill([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], max_epochs)
    per_shard = max(words_per_shard, total // max_shards)
    # a block is a small part both of its source and of a shard
    block = [max(1, min(n // blocks_per_source, per_shard // BLOCKS)) for _, n in totals]
    plan = spark.createDataFrame([(s, i, n, float(t), max(1, n // per_shard), block[i]) for i, ((s, n), t) in enumerate(zip(totals, target))], "__named string, __s int, __mix_source_size long, __mix_target double, __shards int, __block long")
    plan = F.broadcast(plan) if len(totals) <= BROADCAST_ROWS else plan
    key = F.xxhash64(F.lit(seed), F.col("__mix_order"))
    placed = sized.join(plan, F.col("__mix_source").eqNullSafe(F.col("__named"))).withColumn("__key", key).withColumn("__shard", F.pmod("__key", "__shards").cast("int"))
    shards: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("__s", "__shard").agg(F.sum("__mix_size").alias("n")).orderBy("__s", "__shard").collect():
        shards.setdefault(r["__s"], []).append((r["__shard"], int(r["n"])))
    # words to sources, then their blocks to shards
    n_blocks = {(s, k): -(-n // block[s]) for s, own_ in shards.items() for k, n in own_}
    words = sainte_lague(target, total, [max_epochs * n for _, n in totals])
    quotas = []
    for s, own_ in shards.items():
        own_blocks = [n_blocks[s, k] for k, _ in own_]
        # short last blocks count by the words that they have
        seats = round(Fraction(words[s] * sum(own_blocks), max(1, totals[s][1])))
        for (k, _), m, q in zip(own_, own_blocks, sainte_lague([Fraction(m) for m in own_blocks], seats, [max_epochs * m for m in own_blocks])):
            step, start = _permutation(m, f"{seed}:{s}:{k}")
            quotas.append((s, k, m, q // m if m else 0, q % m if m else 0, step, start))
    quota = spark.createDataFrame(quotas, "__s int, __shard int, __m long, __rounds long, __more long, __step long, __start long")
    in_order = W.partitionBy("__s", "__shard").orderBy("__key", "__mix_order", "__mix_size").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("__end", F.sum("__mix_size").over(in_order)).join(quota, ["__s", "__shard"])
    first, block_ = F.col("__end") - F.col("__mix_size"), F.col("__block")
    times = lambda b: F.col("__rounds") + F.when(F.pmod(b * F.col("__step") + F.col("__start"), F.col("__m")) < F.col("__more"), F.lit(1)).otherwise(F.lit(0))
    of = F.sequence(F.floor(first / block_), F.floor((F.col("__end") - 1) / block_))
    pieces = F.transform(of, lambda b: F.struct((F.greatest(b * block_, first) - first).alias("from"), (F.least((b + 1) * block_, F.col("__end")) - first).alias("to"), times(b).alias("times")))
    none = F.array().cast("array<struct<from:bigint,to:bigint,times:bigint>>")
    out = laid.withColumn("__mix_blocks", F.when(F.col("__mix_size") > 0, pieces).otherwise(none))
    return out.withColumn("__mix_taken", F.aggregate("__mix_blocks", F.lit(0).cast("long"), lambda a, p: a + (p["to"] - p["from"]) * p["times"]))
