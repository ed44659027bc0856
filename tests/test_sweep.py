"""Clusterings for a range of k, overlaps and cards against direct versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import cluster as C
from strandmill.operators import sweep as P


def points(n=40, seed=1):
    r = np.random.default_rng(seed)
    centre = r.integers(0, 4, n)
    return centre, np.abs(r.normal(centre[:, None] * 3, 1, (n, 3)))


def cost(d, label):
    return sum(min(d[m][label == c].sum() for m in np.flatnonzero(label == c)) for c in set(label))


def test_pam_sweep_matches_one_k_at_a_time():
    for seed in range(4):
        d = C.manhattan(points(seed=seed)[1])
        for k, label in P.pam_sweep(d, [2, 3, 4, 7]).items():
            assert len(set(label)) == k
            assert np.isclose(cost(d, label), cost(d, C.pam(d, k)))
    d = C.manhattan(points(9)[1])
    best = min(np.min(d[list(m)], axis=0).sum() for m in itertools.combinations(range(9), 2))
    assert cost(d, P.pam_sweep(d, [2])[2]) <= best * 1.05


def test_dendrogram_is_cut_at_each_k():
    for seed in range(4):
        d = C.manhattan(points(seed=seed)[1])
        tree = P.dendrogram(d)
        for k in (1, 2, 3, 5, 9, 40):
            a, b = P.cut_tree(tree, k), C.average_linkage(d, k)
            assert np.array_equal(a[:, None] == a[None, :], b[:, None] == b[None, :])


def slow_gower(binary, continuous):
    kinds = []
    b = [c for c in zip(*binary) if len(set(c)) > 1]
    if b:
        kinds.append(lambda i, j: sum(c[i] != c[j] for c in b) / len(b))
    x = [c for c in zip(*continuous) if len(set(c)) > 1]
    if x:
        kinds.append(lambda i, j: sum(abs(c[i] - c[j]) / (max(c) - min(c)) for c in x) / len(x))
    return np.array([[sum(f(i, j) for f in kinds) / len(kinds) for j in range(len(binary))] for i in range(len(binary))])


def features():
    r = random.Random(3)
    return [(g, i + 100 * k, r.randint(0, 1), 1, r.choice([0, 1, 1]), r.random() * 3, float(r.randint(1, 9)), 2.0, r.choice(["x", "y", None])) for k, (g, n) in enumerate([("a", 25), ("b", 12), ("small", 3)]) for i in range(n)]


SCHEMA = "g string, id long, f0 int, f1 int, f2 int, c0 double, c1 double, c2 double, cls string"


def test_sweep(spark):
    df = spark.createDataFrame(features(), SCHEMA)
    got = P.sweep(df, "g", "id", ["f0", "f1", "f2"], ["c0", "c1", "c2"], [2, 4], 3, 3)
    rows = {(r.g, r.id): r for r in got.collect()}
    assert {g for g, _ in rows} == {"a", "b"}  # a group of fewer rows than the largest k is left out
    assert P.cluster_columns(got) == ["cluster_pam_k2", "cluster_pam_k4", "cluster_hierarchical_k2", "cluster_hierarchical_k4", "cluster_hdbscan"]
    assert P.cluster_columns(got, ks={4}) == ["cluster_pam_k4", "cluster_hierarchical_k4", "cluster_hdbscan"]
    for g in ("a", "b"):
        own = sorted(r for r in features() if r[0] == g)
        d = slow_gower([r[2:5] for r in own], [r[5:8] for r in own])
        assert np.allclose(d, P.gower_matrix(np.array([r[2:5] for r in own], float), np.array([r[5:8] for r in own])))
        for c in P.cluster_columns(got):
            label = np.array([rows[g, r[1]][c] for r in own])
            assert np.allclose([rows[g, r[1]][f"within_{c}"] for r in own], (d * (label[:, None] == label[None, :])).sum(1))
            if "pam" in c:
                assert np.isclose(cost(d, label), cost(d, C.pam(d, int(c[-1]))))
    with pytest.raises(ValueError, match="25 rows"):
        P.sweep(df, "g", "id", ["f0"], ["c0"], max_rows=20)
    with pytest.raises(Exception, match="missing values"):
        P.sweep(df.withColumn("c0", F.when(F.col("id") > 0, F.col("c0"))), "g", "id", ["f0"], ["c0"], [2]).collect()
    with pytest.raises(ValueError, match="varies"):
        P.gower_matrix(np.ones((4, 1)), np.ones((4, 2)))


def test_overlap(spark):
    df = P.sweep(spark.createDataFrame(features(), SCHEMA), "g", "id", ["f0"], ["c0", "c1"], [2, 4], 3, 3).join(spark.createDataFrame(features(), SCHEMA).select("id", "cls"), "id")
    data = df.collect()
    got = P.overlap(df, ["g"], "cls").collect()
    for r in got:
        rows = [x for x in data if x.g == r.g and x.cls is not None]
        a, size, total = sum(x[r.clustering] == r.cluster and x.cls == r["class"] for x in rows), sum(x[r.clustering] == r.cluster for x in rows), sum(x.cls == r["class"] for x in rows)
        assert (r.observed, r.cluster_size, r.class_total) == (a, size, total)
        assert np.isclose(r.expected, size * total / len(rows)) and np.isclose(r.cluster_composition, a / size)
    cells = {(r.g, r.clustering, r.cluster, r["class"]) for r in got}
    assert len(cells) == len(got) == sum(2 * len({x[c] for x in data if x.g == g and x.cls is not None}) for g in ("a", "b") for c in P.cluster_columns(df))


def test_cards_and_summaries(spark):
    f = spark.createDataFrame(features(), SCHEMA)
    labels = P.sweep(f, "g", "id", ["f0", "f2"], ["c0", "c1"], [3, 4], 3, 3)
    at = {(r.g, r.id): r for r in labels.collect()}
    rows = [r for r in features() if (r[0], r[1]) in at]
    got = P.cards(f, labels, ["g"], "id", "cluster_pam_k3", ["c0"], {"flag": ["f0", "f1", "f2"], "none": []}).collect()
    assert len(got) == 6
    for r in got:
        own = [x for x in rows if x[0] == r.g and at[x[0], x[1]].cluster_pam_k3 == r.cluster]
        best = min(own, key=lambda x: (round(at[x[0], x[1]].within_cluster_pam_k3, 9), x[1]))
        assert (r.cluster_n, r.medoid) == (len(own), best[1]) and np.isclose(r.c0_median, np.median([x[5] for x in own]))
        counts = sorted(((-sum(x[i] for x in own), name) for i, name in ((2, "f0"), (3, "f1"), (4, "f2")) if sum(x[i] for x in own)))[:2]
        counts += [(0, "none detected")] * (2 - len(counts))
        assert [(r.top_flag_1, r.top_flag_1_count), (r.top_flag_2, r.top_flag_2_count)] == [(n, -c) for c, n in counts]
        assert r.top_none_1 == "none detected" and np.isclose(r.top_flag_1_fraction, -counts[0][0] / len(own))
        assert np.isclose(r.medoid_mean_distance, r.medoid_total_distance / max(1, len(own) - 1))
    for r in P.summaries(f, labels, ["g"], "id", ["c1"], ["f0"], F.col("cls")).collect():
        own = [x for x in rows if x[0] == r.g and at[x[0], x[1]][r.clustering] == r.cluster]
        assert r.cluster != -1 and r["size"] == len(own) and np.isclose(r.prop_f0, np.mean([x[2] for x in own]))
        assert (r.classes or {}) == {c: sum(x[8] == c for x in own) for c in ("x", "y") if any(x[8] == c for x in own)}


def test_gower_pairs_of_more_rows_than_a_block(spark, monkeypatch):
    from strandmill.plans import catalog

    folder = "/root/testdata/sf0.01"
    want = {(r.i, r.j): r.distance for r in catalog.QUERIES["gower_distance"](spark, folder).collect()}
    monkeypatch.setattr(C, "MAX_ROWS", 30)
    monkeypatch.setattr(C, "BLOCK_ROWS", 13, raising=False)
    got = [tuple(r) for r in catalog.QUERIES["gower_distance"](spark, folder).collect()]
    assert len(got) == len(want) == 4950 and {(i, j): x for i, j, x in got} == want


def mixed(copies):
    r = np.random.default_rng(5)
    out = []
    for g, n in (("a", 400), (None, 150), ("c", 40)):
        c = r.integers(0, 4, n)
        x, f = r.normal(c[:, None] * 2.0, 1, (n, 2)), (r.random((n, 3)) < 0.2 + 0.2 * c[:, None]).astype(int)
        for i in range(n):
            j = r.integers(0, i + 1) if g is None and copies and i % 5 == 0 else i
            out.append((g, i, *map(int, f[j]), *map(float, x[j])))
    return out, "g string, id long, f0 int, f1 int, f2 int, c0 double, c1 double"


@pytest.fixture
def small_blocks(monkeypatch):
    from strandmill.operators import blocked

    for name, value in {"BLOCK": 70, "SLAB": 32, "BIG": 8, "LEFT": 30}.items():
        monkeypatch.setattr(blocked, name, value)


def test_sweep_of_large_groups_goes_by_blocks(spark, small_blocks):
    df = spark.createDataFrame(*mixed(copies=True))
    args = ("g", "id", ["f0", "f1", "f2"], ["c0", "c1"], [2, 4], 10, 8)
    whole, blocks = ({(r.g, r.id): r for r in t.collect()} for t in (P.sweep(df, *args), P.sweep(df, *args, dense_rows=100)))
    assert whole.keys() == blocks.keys() and len(whole) == 590
    for at, w in whole.items():
        if at[0] is None:  # copies leave the density tree open
            assert all(w[c] == blocks[at][c] for c in w.asDict() if c.startswith("cluster") and "hdbscan" not in c)
        else:
            assert np.allclose(w[2:], blocks[at][2:], atol=1e-9)
    with pytest.raises(ValueError, match="missing values"):
        P.sweep(df.withColumn("c0", F.when(F.col("id") > 0, F.col("c0"))), *args, dense_rows=100)


def test_stability_of_large_groups_goes_by_blocks(spark, small_blocks):
    df = spark.createDataFrame(*mixed(copies=True))
    args = ("g", "id", ["f0", "f1", "f2"], ["c0", "c1"], [2, 4], 2)
    whole, blocks = ({(r.g, r.algorithm, r.k): r[3:] for r in t.collect()} for t in (P.stability(df, *args), P.stability(df, *args, dense_rows=100)))
    assert whole.keys() == blocks.keys() and len(whole) == 12
    assert all(np.allclose(whole[at], blocks[at], atol=1e-9) for at in whole)


def test_clusterings_of_large_groups_go_by_blocks(spark, small_blocks):
    df = spark.createDataFrame(*mixed(copies=True)).fillna({"g": "b"})
    args = ("g", "id", ["f0", "c0", "c1"], 3, 10, 8)
    whole, blocks = ({(r.g, r.id): r for r in t.collect()} for t in (C.cluster_groups(df, *args), C.cluster_groups(df, *args, dense_rows=100)))
    assert whole.keys() == blocks.keys() and len(whole) == 590
    for at, w in whole.items():
        some = ["pam", "hierarchical", "axis1", "axis2"] + ([] if at[0] == "b" else ["hdbscan", "hdbscan_confidence"])  # copies leave the density tree open
        assert np.allclose([w[c] for c in some], [blocks[at][c] for c in some], atol=1e-6)


def test_clusterings_of_many_columns_are_planned(spark, small_blocks):
    """Plans of large groups with 64 columns, which filled the driver's memory."""
    r = np.random.default_rng(7)
    names = [f"x{i}" for i in range(64)]
    df = spark.createDataFrame([("a", i, [float(v) for v in r.normal(i % 3, 0.3, 64)]) for i in range(60)], "g string, id long, v array<double>")
    df = df.select("g", "id", *(F.get("v", F.lit(i)).alias(x) for i, x in enumerate(names)))
    whole, blocks = ({r.id: r for r in t.collect()} for t in (C.cluster_groups(df, "g", "id", names), C.cluster_groups(df, "g", "id", names, dense_rows=10)))
    assert whole.keys() == blocks.keys() and len(whole) == 60
    assert all((w.pam, w.hierarchical) == (blocks[i].pam, blocks[i].hierarchical) for i, w in whole.items())
    assert all(np.allclose((w.axis1, w.axis2), (blocks[i].axis1, blocks[i].axis2), atol=1e-6) for i, w in whole.items())


def test_greedy_start_and_sums_take_one_pass_over_pairs(spark, small_blocks, monkeypatch):
    """The greedy start by bounds, and sums of distances within labels by running sums, against the whole matrix."""
    from strandmill.operators import blocked

    monkeypatch.setattr(blocked, "LOOKS", 7)
    monkeypatch.setattr(blocked, "SHARE", 1000)
    rows = [(0, *r[1:]) for r in mixed(copies=False)[0] if r[0] == "a"]
    names = ["f0", "f1", "f2", "c0", "c1"]
    df = spark.createDataFrame(rows, "g long, id long, f0 int, f1 int, f2 int, c0 double, c1 double")
    p = blocked.deal(blocked.fold(df, "g", "id", names), "g", names[:3], names[3:]).scaled({0: np.array([0.1, 0.2, 0.3, 1.0, 0.5])})
    d = C.manhattan(np.array([r[2:] for r in rows], float) * p.scales[0])
    passes, over = [], blocked.over
    monkeypatch.setattr(blocked, "over", lambda s, tasks, run, schema: passes.append(run.__name__) or over(s, tasks, run, schema))
    blocked.by_column(spark, p)
    got = [i for i, _ in blocked.start(spark, p, 6)[0]]
    want = [int(d.sum(1).argmin())]
    while len(want) < 6:
        gains = np.maximum(d[want].min(0)[None, :] - d, 0).sum(1)
        gains[want] = -1
        want.append(int(gains.argmax()))
    assert got == want and passes.count("every") == 1 and passes.count("ask") >= 4
    of = np.arange(len(rows)) % 5 - 1
    assert np.allclose(blocked.own_sums(p, 0, of), (d * (of[:, None] == of[None, :])).sum(1), atol=1e-9)
