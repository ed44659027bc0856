"""Running numbers, sums and extremes over sorted ranges, against a loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import scan


def slow(rows):
    """(id, place, sum, max, min) of rows (id, key, order, value), by key and order."""
    out, held = [], {}
    for i, k, _, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0])):
        n, total, top, low = held.get(k, (0, None, None, None))
        if x is not None:
            total, top, low = (x, x, x) if total is None else (total + x, max(top, x), min(low, x))
        held[k] = (n + 1, total, top, low)
        out.append((i, *held[k]))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running(spark, ranges):
    r = random.Random(ranges)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", None, f"k{i}"]), r.choice([None, *range(40)]), r.choice([None, *range(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, at int, x int").repartition(5)
    got = scan.running(df, ["key"], ["at", "id"], "place", ranges, total=("sum", F.col("x")), top=("max", F.col("x")), low=("min", F.col("x")))
    assert got.columns == ["id", "key", "at", "x", "place", "total", "top", "low"]
    assert sorted((g.id, g.place, g.total, g.top, g.low) for g in got.collect()) == slow(rows)


def test_directions_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "__scan_k int, place string")
    got = scan.numbered(df, [], [(F.col("__scan_k"), "desc")])
    assert sorted((r["place"], r["__scan_k"]) for r in got.collect()) == [(1, 2), (2, 1), (3, None)]
    assert scan.numbered(df.limit(0), ["place"], ["__scan_k"], "n").count() == 0
    with pytest.raises(ValueError, match="median"):
        scan.running(df, [], ["__scan_k"], m=("median", F.col("__scan_k")))


def test_one_key_fills_all_ranges(spark):
    df = spark.range(20_000).select("id", F.lit("one").alias("key"))
    got = scan.numbered(df, ["key"], ["id"], ranges=16)
    assert got.where("place <> id + 1").count() == 0 and got.count() == 20_000
    assert got.select(F.max("place")).first()[0] == 20_000


def test_before_and_last(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["hot"] * 5 + ["a", None]), r.choice([None, *range(30)]), r.choice([None, None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, at int, x int").repartition(5)
    order = [("at", "desc_nulls_first"), "id"]
    columns = {"last": ("last", F.col("x")), "top": ("max", F.col("x"))}
    want, held = [], {}
    for i, k, a, x in sorted(rows, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0])):
        seen = held.setdefault(k, [])
        want.append((i, seen[-1] if seen else None, max(seen, default=None)))
        if x is not None:
            seen.append(x)
    got = [scan.running(df, ["key"], order, ranges=9, before=True, **columns), scan.within(df, ["key"], order, before=True, **columns), scan.within(df, ["key"], order, before=True, many=True, **columns)]
    for g in got:
        assert sorted((r.id, r["last"], r.top) for r in g.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["interval_merge", "gap_bridge_merge", "position_class", "positional_pairs", "cliffs_delta", "kruskal_p"])
def test_hot_keys_give_the_same_rows(spark, monkeypatch, name):
    from strandmill.plans import catalog

    folder = "/root/testdata/sf0.001"
    want = sorted(map(str, catalog.QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(scan, "KEY_ROWS", 0)
    assert sorted(map(str, catalog.QUERIES[name](spark, folder).collect())) == want


def test_no_range_of_one_hot_key_is_large(spark):
    from strandmill.operators import storage
    from strandmill.operators.intervals import _stretches

    seen = []
    real = storage.stored
    scan.stored, held = (lambda df, what: seen.append(real(df, what)) or seen[-1]), scan.stored
    try:
        calls = spark.range(40_000).select(F.lit("p").alias("k"), (F.col("id") % 10_000 * 3 + 1).cast("int").alias("start"), (F.col("id") % 10_000 * 3 + 2).cast("int").alias("end"))
        scan.KEY_ROWS, rows = 1000, scan.KEY_ROWS
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        assert _stretches(calls, ["k"], ["start", "end"], "start", "end").select("__stretch").distinct().count() == 10_000
    finally:
        scan.stored, scan.KEY_ROWS = held, rows
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for df in seen:
        part = next(c for c in df.columns if c.endswith("_part"))
        assert df.groupBy(part).count().agg(F.max("count")).first()[0] < 40_000 / 8


@pytest.mark.parametrize("rows_a_key", [0, 10**6])
def test_quantiles(spark, monkeypatch, rows_a_key):
    import numpy as np

    monkeypatch.setattr(scan, "KEY_ROWS", rows_a_key)
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(20)]), r.random(), None) for _ in range(150)] + [("one", 5, None, None)]
    df = spark.createDataFrame(rows, "k string, x int, y double, z double")
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {(q.k, q.column): q.quantiles for q in scan.quantiles(df, ["k"], ["x", "y", "z"], shares).collect()}
    assert {k for k, c in got if c == "x"} == {"a", "b", None, "one"} and ("one", "y") not in got and not any(c == "z" for _, c in got)
    for (k, c), q in got.items():
        own = [x["xyz".index(c) + 1] for x in rows if x[0] == k and x["xyz".index(c) + 1] is not None]
        assert np.allclose(q, np.quantile(own, shares))
    whole = {q.column: q.quantiles for q in scan.quantiles(df, [], ["x"], shares).collect()}
    assert np.allclose(whole["x"], np.quantile([x[1] for x in rows if x[1] is not None], shares))


def test_equal_calls_that_open_a_stretch_stay_together(spark, monkeypatch):
    from strandmill.operators.intervals import bridge

    # 50 stretches of 400 equal calls: ranges of the sorted passes end among them
    calls = spark.range(20_000).repartition(7).select(F.lit("p").alias("k"), (F.col("id") % 50 * 100 + 1).cast("int").alias("start"), (F.col("id") % 50 * 100 + 9).cast("int").alias("end"))
    monkeypatch.setattr(scan, "KEY_ROWS", 0)
    got = [tuple(r) for r in bridge(calls, ["k"], 3).orderBy("start").collect()]
    assert got == [("p", i * 100 + 1, i * 100 + 9, 400) for i in range(50)]
