"""Reconciliation, matching, regression, permutation, sums of distances and stability against direct versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import distances as D
from strandmill.operators import models as M
from strandmill.operators import reconcile as N
from strandmill.operators import scan
from strandmill.operators import sweep as P
from tests.test_sweep import SCHEMA, features, slow_gower


def test_cascade_and_genes(spark):
    master = spark.createDataFrame([(1, "P1", "s1", "g1"), (2, "P9", "s2", "g1"), (3, None, "s9", "g2"), (4, None, None, "g3"), (5, None, None, None), (6, "P8", "s8", "g9"), (6, "P8", "s8", "g9")], "i int, acc string, seq string, gene string")
    background = spark.createDataFrame([("P1", "s0", "g0"), ("P2", "s2", "g2"), ("P3", None, "g2"), ("P4", "s4", None), (None, None, "g1")], "b_acc string, b_seq string, b_gene string")
    got = N.cascade(master, background, {"accession": (F.col("acc"), F.col("b_acc")), "sequence": (F.col("seq"), F.col("b_seq")), "gene": (F.col("gene"), F.col("b_gene"))})
    assert got.columns == [*master.columns, "bucket"]
    assert sorted((r.i, r.bucket) for r in got.collect()) == [(1, "accession"), (2, "sequence"), (3, "gene"), (4, "absent"), (5, "absent"), (6, "absent"), (6, "absent")]
    b = background.select(F.col("b_acc").alias("acc"), F.col("b_gene").alias("gene"))
    rest = N.gene_buckets(got.where("i > 2"), "gene", got.where("i < 3"), b)
    assert sorted((r.i, r.gene_bucket) for r in rest.collect()) == [(3, N.UNLABELED), (4, N.NOT_THERE), (5, N.NO_GENE), (6, N.NOT_THERE), (6, N.NOT_THERE)]
    assert [r.gene_bucket for r in N.gene_buckets(master.where("i = 2"), "gene", got.where("i < 3"), b).collect()] == [N.ALREADY]
    patch = N.label_patch(rest, "gene", b, "acc")
    assert {tuple(r) for r in patch.collect()} == {("P2", "g2"), ("P3", "g2")}
    labels = N.assembled(master.where("acc = 'P1'"), patch, master.where("i = 6").unionAll(master.where("i = 1")), "acc")
    assert {tuple(r) for r in labels.collect()} == {("P1", "master_direct"), ("P2", "gene_patch"), ("P3", "gene_patch"), ("P8", "master_appended")}
    assert N.cascade(master.limit(0), background, {"a": (F.col("acc"), F.col("b_acc"))}).count() == 0


@pytest.mark.parametrize("rows_a_key", [0, 10**6])
def test_matched_subset(spark, monkeypatch, rows_a_key):
    monkeypatch.setattr(scan, "KEY_ROWS", rows_a_key)
    r = random.Random(1)
    rows = [(i, r.randint(1, 100), r.random() < 0.15) for i in range(600)] + [(900, 1000, False), (901, None, False), (902, 50, None)]
    df = spark.createDataFrame(rows, "id int, n int, case boolean")
    got = M.matched_subset(df, "id", F.col("case"), "n", ratio=2).collect()
    cases = sorted(x[1] for x in rows if x[2])
    assert len({x.id for x in got}) == len(got) and sum(x.is_case for x in got) == len(cases)
    assert all(cases[0] <= x.n <= cases[-1] for x in got)
    for b in {x.length_bin for x in got}:
        own = [x for x in got if x.length_bin == b]
        assert sum(not x.is_case for x in own) == 2 * sum(x.is_case for x in own)
    assert sorted(x.id for x in M.matched_subset(df, "id", F.col("case"), "n", ratio=2).collect()) == sorted(x.id for x in got)
    assert {x.id for x in M.matched_subset(df, "id", F.col("case"), "n", ratio=2, seed="other").collect()} != {x.id for x in got}


def slow_logistic(x, y):
    x, beta = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logistic_and_importance(spark):
    g = np.random.default_rng(4)
    x = np.c_[g.normal(5000, 900, 400), g.normal(0, 1, 400), g.integers(0, 2, 400)]
    y = (g.random(400) < 1 / (1 + np.exp(-(0.002 * (x[:, 0] - 5000) + 0.1 * x[:, 1] - 1.2 * x[:, 2])))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0, 1)], "id int, a double, b double, c double, y int")
    terms = M.logistic(df, "y", ["a", "b", "c"])
    beta, error = slow_logistic(x, y)
    assert [t["term"] for t in terms] == ["intercept", "a", "b", "c"]
    assert np.allclose([t["coefficient"] for t in terms], beta, rtol=1e-6) and np.allclose([t["standard_error"] for t in terms], error, rtol=1e-6)
    rows = M.permuted(df, "id", "a").collect()
    assert sorted(str(r.a) for r in rows) == sorted(str(r.a) for r in df.collect()) and sum(r.a == s.a for r, s in zip(sorted(rows), sorted(df.collect()))) < 40
    found = M.permutation_importance(df, "id", "y", terms)
    assert found["a"] > found["c"] > abs(found["b"]) and found["a"] > 0.3
    for bad, why in ((df.withColumn("b", F.lit(1.0)), "do not vary"), (df.withColumn("y", F.lit(1)), "does not vary"), (df.withColumn("y", (F.col("a") > 5000).cast("int")), "separable|convergence|Singular")):
        with pytest.raises((ValueError, np.linalg.LinAlgError), match=why):
            M.logistic(bad, "y", ["a", "b", "c"])


@pytest.mark.parametrize("rows_a_key", [0, 10**6])
def test_sums_of_distances(spark, monkeypatch, rows_a_key):
    monkeypatch.setattr(scan, "KEY_ROWS", rows_a_key)
    rows = features()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", (F.col("id") % 3).cast("int")).withColumn("k", F.coalesce("cls", F.lit("-")))
    scaled, weights = D.gower_scaled(df, ["g"], ["f0", "f1", "f2"], ["c0", "c1", "c2"])
    summed = D.sums(scaled, ["g"], "id", "c", ["f0", "f1", "f2", "c0", "c1", "c2"], weights)
    got = {(r.g, r.id, r.other): r.total for r in summed.collect()}
    scores = {(r.g, r.id): r.silhouette for r in D.silhouettes(summed, ["g"], "id", "c").collect()}
    centres = {(r.g, r.c): r for r in D.medoids(summed, ["g"], "id", "c").collect()}
    for g in ("a", "b", "small"):
        own = sorted(r for r in rows if r[0] == g)
        d, label = slow_gower([r[2:5] for r in own], [r[5:8] for r in own]), np.array([r[1] % 3 for r in own])
        for i, r in enumerate(own):
            mean = {c: d[i][label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in set(label)}
            for c in mean:
                assert np.isclose(got[g, r[1], c], d[i][label == c].sum(), atol=1e-9)
            a, b = mean.pop(label[i]), min(mean.values())
            assert np.isclose(scores[g, r[1]], 0 if (label == label[i]).sum() == 1 else (b - a) / max(a, b))
        for c in set(label):
            at = np.flatnonzero(label == c)
            within = d[np.ix_(at, at)].sum(1)
            assert centres[g, c].medoid == own[at[np.lexsort((at, np.round(within, 9)))[0]]][1] and centres[g, c]["size"] == len(at)
    mixed, weights = D.gower_scaled(df.where("g = 'a'"), [], ["f0"], [], ["k"])
    own = [r for r in rows if r[0] == "a"]
    for r in D.sums(mixed, [], "id", "c", ["f0"], weights).collect():
        me = next(x for x in own if x[1] == r.id)
        assert np.isclose(r.total, sum(((x[2] != me[2]) + ((x[8] or "-") != (me[8] or "-"))) / 2 for x in own if x[1] % 3 == r.other))
    alone = D.silhouettes(D.sums(df, ["g"], "id", "f1", ["c0"]), ["g"], "id", "f1").collect()
    assert len(alone) == len(rows) and all(r.silhouette is None for r in alone)


def test_stability(spark):
    g = np.random.default_rng(0)
    rows = [("two", i, int(i % 2), float(100 * (i % 2) + g.random())) for i in range(30)] + [("none", i, int(g.integers(2)), float(g.random())) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, id int, f int, x double")
    got = {(r.g, r.algorithm, r.k): r for r in P.stability(df, "g", "id", ["f"], ["x"], [2, 4], resamples=5).collect()}
    assert len(got) == 8 and got["two", "pam", 2].min_ari == 1.0 and got["two", "hierarchical", 2].mean_ari == 1.0
    assert all(r.min_ari <= r.mean_ari <= r.max_ari <= 1 for r in got.values())
    assert got == {(r.g, r.algorithm, r.k): r for r in P.stability(df, "g", "id", ["f"], ["x"], [2, 4], resamples=5).collect()}
    a, b = np.array([0, 0, 1, 1, 2]), np.array([1, 1, 0, 0, 0])
    n = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    from strandmill.operators.stats import adjusted_rand

    assert np.isclose(P._rand(a, b), adjusted_rand(n, "a", "b").first().ari) and P._rand(a, a) == 1.0
