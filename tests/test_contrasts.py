"""Contrasts by counts of equal values against pairwise comparisons."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandmill.operators import contrasts as K
from strandmill.operators import scan
from strandmill.operators import stats as T


def rows_of(seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["m", "m", "n", None]), r.choice(["hot"] * 6 + ["b", "c", None]), r.random() < 0.4, r.choice([None, *range(12)])) for _ in range(500)]
    rows = [(b, g, f, None if x is None else x / 4) for b, g, f, x in rows]
    return rows + [("no reference", "b", False, 1.0), ("no reference", "c", None, 2.0), ("only reference", None, True, 3.0), ("one", "b", True, 5.0), ("few", "b", False, 1.5), ("few", "b", False, 2.5), ("few", "c", True, 0.5), ("few", "c", True, 9.5), ("few", "c", True, 8.0)]


SCHEMA = "block string, g string, ref boolean, x double"


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def summary(xs):
    return (len(xs), statistics.median(xs) if xs else None, statistics.mean(xs) if xs else None, statistics.stdev(xs) if len(xs) > 1 else None)


def delta(xs, ys):
    return sum((x > y) - (x < y) for x in xs for y in ys) / (len(xs) * len(ys)) if len(xs) > 1 and len(ys) > 1 else None


@pytest.mark.parametrize("rows_a_key", [0, 10**6])
def test_with_reference(spark, monkeypatch, rows_a_key):
    monkeypatch.setattr(scan, "KEY_ROWS", rows_a_key)
    rows = rows_of()
    got = {(r.block, r.g): r for r in K.with_reference(spark.createDataFrame(rows, SCHEMA).repartition(3), ["block"], "g", "x", F.col("ref")).collect()}
    keys = {(b, g) for b, g, _, x in rows if g is not None and x is not None}
    assert set(got) == keys
    for b, g in keys:
        xs, ys = [x for k, h, _, x in rows if (k, h) == (b, g) and x is not None], [x for k, _, f, x in rows if k == b and f and x is not None]
        r = got[b, g]
        for a, b_ in zip((r.n_group, r.median_group, r.mean_group, r.sd_group, r.n_ref, r.median_ref, r.mean_ref, r.sd_ref), (*summary(xs), *summary(ys))):
            assert close(a, b_)
        assert close(r.cliffs_delta, delta(xs, ys)) and r.descriptive_only == (min(len(xs), len(ys)) < T.LEAST)
        pair = spark.createDataFrame([(1, True, x) for x in xs] + [(1, False, y) for y in ys], "one int, own boolean, x double")
        if b in ("m", "few"):
            want = T.compare_continuous(pair, ["one"], "x", F.col("own"), ~F.col("own")).first()
            assert close(r.p_value, want.p_value) and close(r.u, want.u)
    assert got["no reference", "b"].n_ref == 0 and got["no reference", "b"].p_value is None
    assert K.with_reference(spark.createDataFrame([], SCHEMA), ["block"], "g", "x", F.col("ref")).count() == 0


@pytest.mark.parametrize("rows_a_key", [0, 10**6])
def test_with_rest(spark, monkeypatch, rows_a_key):
    monkeypatch.setattr(scan, "KEY_ROWS", rows_a_key)
    rows = rows_of(2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.block, r.g): r for r in K.with_rest(df, ["block"], "g", "x").collect()}
    known = [(b, g, x) for b, g, _, x in rows if g is not None and x is not None]
    assert set(got) == {(b, g) for b, g, _ in known}
    for (b, g), r in got.items():
        xs, ys = [x for k, h, x in known if (k, h) == (b, g)], [x for k, h, x in known if k == b and h != g]
        assert all(map(close, (r.n, r.median, r["mean"], r.sd), summary(xs)))
        assert close(r.delta_vs_rest, delta(xs, ys))
        large = {h for k, h, _ in known if k == b and sum(1 for c, e, _ in known if (c, e) == (b, h)) >= 2}
        if len(large) < 2:
            assert r.omnibus_p is None
        else:
            some = spark.createDataFrame([(1, h, x) for k, h, x in known if k == b and h in large], "one int, g string, x double")
            assert close(r.omnibus_h, T.kruskal(some, ["one"], "x", "g").first().h)
    assert K.with_rest(df.limit(0), ["block"], "g", "x").count() == 0


def test_labels(spark):
    entities = spark.createDataFrame([(1, "a", False, 10), (2, "a", False, 0), (3, "b", True, 20), (4, None, True, 5), (5, "c", None, 8)], "k int, g string, ref boolean, size int")
    items = spark.createDataFrame([(1, "x", 4), (1, "x", 2), (1, "y", 1), (2, "x", 3), (3, "y", 5), (4, "x", 5), (9, "z", 1), (5, None, 2)], "k int, label string, n int")
    got = K.label_block(entities, items, "k", "g", "label", "n", "size", F.col("ref")).collect()
    rates = {(r.label, r.g): (r.n_pos_group, r.n_tot_group, r.n_pos_ref, r.n_tot_ref) for r in got if r.measure == "carrier_rate"}
    assert rates == {("x", "a"): (2, 2, 1, 2), ("x", "b"): (0, 1, 1, 2), ("x", "c"): (0, 1, 1, 2), ("y", "a"): (1, 2, 1, 2), ("y", "b"): (1, 1, 1, 2), ("y", "c"): (0, 1, 1, 2)}
    shares = {(r.label, r.g): (r.n_group, r.median_group, r.n_ref, r.median_ref) for r in got if r.measure != "carrier_rate"}
    # an entity without size has no share
    assert shares == {("x", "a"): (1, 0.6, 1, 1.0), ("y", "a"): (1, 0.1, 1, 0.25), ("y", "b"): (1, 0.25, 1, 0.25)}
    rest = {(r.label, r.g): (r.n_pos_group, r.n_tot_group, r.n_pos_ref, r.n_tot_ref) for r in K.presence_vs_rest(entities, items, "k", "g", "label").collect()}
    assert rest["x", "a"] == (2, 2, 0, 2) and rest["x", "b"] == (0, 1, 2, 3) and rest["y", "b"] == (1, 1, 1, 3) and len(rest) == 6
    parts = {(r.k, r.label): r.fraction for r in K.label_fractions(items.join(entities, "k"), ["k"], "label", "n", "size", top=1).collect()}
    assert parts == {(1, "x"): 0.6, (1, "other"): 0.1, (2, "x"): None, (3, "other"): 0.25, (4, "x"): 1.0, (5, "other"): 0.25}


def test_reported_values(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("b", "y", 4), (None, "x", 5), ("b", None, 6)], "g string, v string, n int")
    got = {tuple(r) for r in T.one_vs_rest(df, "g", "v", F.col("n"), ["x", "never"]).collect()}
    assert got == {("a", "x", 2, 5, 0, 4), ("b", "x", 0, 4, 2, 5), ("a", "never", 0, 5, 0, 4), ("b", "never", 0, 4, 0, 5)}


def test_a_text_is_split_once_and_not_for_every_sentence(spark):
    from strandmill.plans.block_queries import sentences

    plan = sentences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode")
    assert "split(text" not in above and "split(text" in below


def test_sizes_are_read_and_not_computed_beside_their_items(spark):
    from strandmill.plans import catalog

    plan = catalog.QUERIES["position_block"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
