"""Joins and merges of 1-based inclusive intervals within a key.

Hot keys: overlaps are matched by bins of positions, neighbours by a sorted pass, and merging
is cut at places that no interval covers; no step pairs all intervals of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scalar as X
from strandmill.operators.scan import hot, within


def merge(calls: DataFrame, keys: list[str], share: float = 0.7, start: str = "start", end: str = "end", raw_id: str = "raw_id") -> DataFrame:
    """Merges calls in order of (start, end) into the last merged one: equal (T0), contained (T1), or overlapping by ``share`` of the shorter (T2).

    Gives keys, start, end, length, n_members, members, merge_tier and the representative's
    raw id: the first member that spans the whole, else the first of the longest. A call that
    starts beyond every end before it never merges, so each such stretch is folded alone."""
    apart = _stretches(calls, keys, [start, end, raw_id], start, end)
    call = F.struct(F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"), F.col(raw_id).cast("long").alias("raw_id"))
    grouped = apart.groupBy(*keys, "__stretch").agg(F.array_sort(F.collect_list(call)).alias("__calls"))
    one = "struct<start:int,end:int,t0:boolean,t1:boolean,t2:boolean,members:array<struct<start:int,end:int,raw_id:bigint>>>"
    none = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("cur"))

    def opened(c: Column) -> Column:
        no = F.lit(False)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), no.alias("t0"), no.alias("t1"), no.alias("t2"), F.array(c).alias("members"))

    def step(acc: Column, c: Column) -> Column:
        cur = acc["cur"]
        same = (c["start"] == cur["start"]) & (c["end"] == cur["end"])
        inside = (c["start"] >= cur["start"]) & (c["end"] <= cur["end"])
        near = X.overlap_of_shorter(cur["start"], cur["end"], c["start"], c["end"]) >= share
        joined = F.struct(
            F.least(cur["start"], c["start"]).alias("start"),
            F.greatest(cur["end"], c["end"]).alias("end"),
            (cur["t0"] | same).alias("t0"),
            (cur["t1"] | (inside & ~same)).alias("t1"),
            (cur["t2"] | ~inside).alias("t2"),
            F.concat(cur["members"], F.array(c)).alias("members"),
        )
        merges = inside | near
        return F.when(cur.isNull(), F.struct(acc["done"].alias("done"), opened(c).alias("cur"))).when(merges, F.struct(acc["done"].alias("done"), joined.alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), opened(c).alias("cur")))

    folded = grouped.withColumn("m", F.explode(F.aggregate("__calls", none, step, lambda a: F.concat(a["done"], F.array(a["cur"])))))
    tiers = F.concat(*(F.when(F.col(f"m.{t}"), t.upper()).otherwise("") for t in ("t0", "t1", "t2")))
    spanning = F.filter("m.members", lambda x: (x["start"] == F.col("m.start")) & (x["end"] == F.col("m.end")))
    longest = F.array_max(F.transform("m.members", lambda x: x["end"] - x["start"]))
    rep = F.coalesce(F.when(F.size("m.members") > 1, F.get(spanning, F.lit(0))), F.get(F.filter("m.members", lambda x: x["end"] - x["start"] == longest), F.lit(0)))
    return folded.select(
        *keys,
        F.col("m.start").alias("start"),
        F.col("m.end").alias("end"),
        (F.col("m.end") - F.col("m.start") + 1).alias("length"),
        F.size("m.members").alias("n_members"),
        F.array_join(F.transform("m.members", lambda x: F.concat_ws("-", x["start"], x["end"])), ";").alias("member_intervals"),
        F.when(tiers == "", "none").otherwise(tiers).alias("merge_tier"),
        rep["raw_id"].alias("representative"),
    )


def bridge(calls: DataFrame, keys: list[str], gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Joins intervals whose gaps are at most ``gap``: keys, start, end, n."""
    # equal calls are one row: two passes may order them differently, and part them where a stretch opens
    each = calls.groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("__n"))
    apart = _stretches(each, keys, [start, end], start, end, gap + 1)
    return apart.groupBy(*keys, "__stretch").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum("__n").alias("n")).drop("__stretch")


def _stretches(calls: DataFrame, keys: list[str], order: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """``calls`` with ``__stretch``: a number that grows wherever a call starts more than ``gap`` beyond every end before it."""
    many = hot(calls, keys)
    reached = within(calls, keys, order, before=True, many=many, __reach=("max", F.col(end)))
    opens = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap), 1).otherwise(0)
    return within(reached, keys, order, many=many, __stretch=("sum", opens)).drop("__reach")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 128, how: str = "inner", left_cols=("start", "end"), right_cols=("domain_start", "domain_end")) -> DataFrame:
    """Pairs whose intervals overlap, by equal keys and bins: a pair is made in the first bin that both reach."""
    (a1, a2), (b1, b2) = left_cols, right_cols
    spread = lambda df, s, e: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    met = spread(left, a1, a2).join(spread(right, b1, b2), [*keys, "__bin"])
    kept = met.where((F.col(a1) <= F.col(b2)) & (F.col(b1) <= F.col(a2)) & (F.col("__bin") == F.floor(F.greatest(a1, b1) / width)))
    out = kept.drop("__bin").withColumns({"overlap_start": F.greatest(a1, b1), "overlap_end": F.least(a2, b2), "overlap_length": X.overlap_length(F.col(a1), F.col(a2), F.col(b1), F.col(b2))})
    return out if how == "inner" else left.join(out, left.columns, how)


def neighbours(calls: DataFrame, domains: DataFrame, key: str, call_id: list[str], start: str = "start", end: str = "end", label: str = "domain_id", d1: str = "domain_start", d2: str = "domain_end", score: str = "i_evalue") -> DataFrame:
    """Each call with the last domain that ends before it (``left``) and the first that starts after it (``right``), ties to the lowest score.

    One sorted pass over calls and domains per side, in ranges where a key is hot; structs of (label, start, end, score)."""
    d = F.struct(F.col(label).alias("label"), F.col(d1).alias("start"), F.col(d2).alias("end"), F.col(score).alias("score"))
    kind = d.alias("d")
    columns = [key, *call_id, start, end]

    def events(rows: DataFrame, at: Column, call_at: Column) -> DataFrame:
        ds = domains.select(F.col(key), at.alias("__at"), F.lit(1).alias("__kind"), F.col(score).alias("__s"), F.col(label).alias("__l"), kind)
        cs = rows.withColumns({"__at": call_at, "__kind": F.lit(0)})
        return cs.unionByName(ds, allowMissingColumns=True)

    many = hot(calls.select(key).unionAll(domains.select(key)), [key])
    ties = ["__kind", ("__s", "desc_nulls_first"), ("__l", "desc_nulls_first")]
    # a call stands before domains at its own place: only strictly smaller ends are to its left
    left = within(events(calls.select(*columns), F.col(d2), F.col(start)), [key], ["__at", *ties], many=many, left=("last", F.col("d"))).where("__kind = 0").select(*columns, "left")
    return within(events(left, F.col(d1), F.col(end)), [key], [("__at", "desc"), *ties], many=many, right=("last", F.col("d"))).where("__kind = 0").select(*columns, "left", "right")


def position_classes(calls: DataFrame, domains: DataFrame, key: str, call_id: list[str]) -> DataFrame:
    """Each call's place among the domains: primary_class, class_labels, max_fraction, nearest domain and its distance, flanks."""
    ov = overlap_join(calls, domains, [key])
    length = F.col("end") - F.col("start") + 1
    edge = X.at_edge(F.col("start"), F.col("end"), F.col("domain_start"), F.col("domain_end"))
    one = [key, *call_id, "start", "end"]
    over = ov.groupBy(*one).agg(F.max(F.col("overlap_length") / length).alias("max_fraction"), F.bool_or(edge).alias("edge"), F.min(F.struct("i_evalue", "domain_id")).alias("inside"))
    extent = domains.groupBy(key).agg(F.min("domain_start").alias("first"), F.max("domain_end").alias("last"))
    j = neighbours(calls, domains, key, call_id).join(over, one, "left").join(extent, key, "left")
    near = lambda side, dist: F.when(F.col(side).isNotNull(), F.struct(dist.alias("distance"), F.col(f"{side}.score").alias("score"), F.col(f"{side}.label").alias("label")))
    inside = F.when(F.col("inside").isNotNull(), F.struct(F.lit(0).alias("distance"), F.col("inside.i_evalue").alias("score"), F.col("inside.domain_id").alias("label")))
    nearest = F.array_min(F.filter(F.array(inside, near("left", F.col("start") - F.col("left.end") - 1), near("right", F.col("right.start") - F.col("end") - 1)), lambda x: x.isNotNull()))
    j = j.withColumn("max_fraction", F.coalesce("max_fraction", F.lit(0.0))).withColumn("nearest", nearest)
    # The classes, the order in which they are listed, and the order in which one is primary.
    listed = [
        ("domain_intrinsic", F.col("max_fraction") >= 0.70),
        ("domain_edge", F.coalesce("edge", F.lit(False))),
        ("interdomain_linker", (F.col("max_fraction") <= 0.30) & F.col("left").isNotNull() & F.col("right").isNotNull()),
        ("domain_adjacent", (F.col("max_fraction") == 0) & (F.col("nearest.distance") <= 50)),
        ("distal_terminal", (F.col("max_fraction") == 0) & (F.col("nearest.distance") > 50) & ((F.col("end") < F.col("first")) | (F.col("start") > F.col("last")))),
    ]
    first = ["domain_edge", "domain_intrinsic", "interdomain_linker", "domain_adjacent", "distal_terminal"]
    holds = dict(listed)
    labels = F.concat_ws(";", *(F.when(c, n) for n, c in listed))
    no = F.col("first").isNull()
    primary = F.coalesce(*(F.when(holds[n], n) for n in first), F.lit("unclassified_partial_overlap"))
    return j.select(
        key,
        *call_id,
        "start",
        "end",
        F.when(no, "unclassified_no_pfam").otherwise(primary).alias("primary_class"),
        F.when(no, "unclassified_no_pfam").when(labels == "", "unclassified_partial_overlap").otherwise(labels).alias("class_labels"),
        F.round("max_fraction", 4).alias("max_fraction"),
        F.col("nearest.distance").cast("int").alias("nearest_distance"),
        F.col("nearest.label").alias("nearest_domain"),
        F.col("left.label").alias("left_domain"),
        F.col("right.label").alias("right_domain"),
    )


def reslice(merged: DataFrame, sequences: DataFrame, key: str, seq: str = "sequence") -> DataFrame:
    """``merged`` with the stretch of its sequence and a status: ok, missing_accession or end_beyond_sequence."""
    joined = merged.join(sequences.select(key, F.col(seq).alias("__seq")), key, "left")
    status = F.when(F.col("__seq").isNull(), "missing_accession").when(F.col("end") > F.length("__seq"), "end_beyond_sequence").otherwise("ok")
    return joined.withColumn("status", status).withColumn(seq, F.when(F.col("status") == "ok", F.substring(F.col("__seq"), F.col("start"), F.col("end") - F.col("start") + 1))).drop("__seq")
