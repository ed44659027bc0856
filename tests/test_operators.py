"""Interval, selection, statistics and clustering operators against plain Python and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import cluster as C
from strandmill.operators import intervals as I
from strandmill.operators import select as P
from strandmill.operators import stats as T


def slow_merge(calls):
    out = []
    for s, e, i in sorted(calls):
        if out:
            m = out[-1]
            share = (min(e, m["e"]) - max(s, m["s"]) + 1) / min(e - s + 1, m["e"] - m["s"] + 1)
            if s >= m["s"] and e <= m["e"] or share >= 0.7:
                m["tier"].add("T0" if (s, e) == (m["s"], m["e"]) else "T1" if s >= m["s"] and e <= m["e"] else "T2")
                m["s"], m["e"], m["n"] = min(s, m["s"]), max(e, m["e"]), m["n"] + 1
                continue
        out.append({"s": s, "e": e, "n": 1, "tier": set()})
    return [(m["s"], m["e"], m["n"], "".join(sorted(m["tier"])) or "none") for m in out]


def test_merge(spark):
    r = random.Random(3)
    groups = {g: [(s, s + r.randint(0, 30), i) for i, s in enumerate(r.choices(range(1, 300), k=n))] for g, n in (("a", 60), ("b", 5), ("c", 120))}
    groups["d"] = [(1, 10, 0), (1, 10, 1), (4, 13, 2), (5, 14, 3), (40, 50, 4)]
    df = spark.createDataFrame([(g, *c) for g, cs in groups.items() for c in cs], "g string, start int, end int, raw_id long")
    got = I.merge(df, ["g"])
    for g, cs in groups.items():
        assert sorted((x.start, x.end, x.n_members, x.merge_tier) for x in got.where(F.col("g") == g).collect()) == sorted(slow_merge(cs))
    assert {x.representative for x in got.where("g = 'd'").collect()} == {0, 4}
    assert I.merge(df.limit(0), ["g"]).count() == 0


def test_overlaps_and_neighbours(spark):
    r = random.Random(8)
    a = [(r.randint(0, 3), s, s + r.randint(0, 300), i) for i, s in enumerate(r.choices(range(1, 2000), k=80))]
    b = [(r.randint(0, 2), f"D{i}", s, s + r.randint(0, 200), r.randint(0, 5) / 10) for i, s in enumerate(r.choices(range(1, 2000), k=60))]
    calls = spark.createDataFrame(a, "protein int, start int, end int, raw_id long")
    domains = spark.createDataFrame(b, "protein int, domain_id string, domain_start int, domain_end int, i_evalue double")
    got = {(x.raw_id, x.domain_id): x.overlap_length for x in I.overlap_join(calls, domains, ["protein"], width=64).collect()}
    assert got == {(i, d): min(e, de) - max(s, ds) + 1 for p, s, e, i in a for q, d, ds, de, _ in b if p == q and s <= de and ds <= e}
    near = {x.raw_id: x for x in I.neighbours(calls, domains, "protein", ["raw_id"]).collect()}
    for p, s, e, i in a:
        left = min(((-de, v, d) for q, d, ds, de, v in b if q == p and de < s), default=(0, 0, None))[2]
        right = min(((ds, v, d) for q, d, ds, de, v in b if q == p and ds > e), default=(0, 0, None))[2]
        assert ((near[i].left or [None])[0], (near[i].right or [None])[0]) == (left, right)
    classes = {x.raw_id: x for x in I.position_classes(calls, domains, "protein", ["raw_id"]).collect()}
    assert all(classes[i].primary_class == "unclassified_no_pfam" for p, _, _, i in a if p == 3)
    for p, s, e, i in a:
        if p < 3:
            d = min((max(0, ds - e - 1, s - de - 1), v, n) for q, n, ds, de, v in b if q == p)
            assert (classes[i].nearest_distance, classes[i].nearest_domain) == (d[0], d[2])


def test_selection(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, None, 1), (1, "b", 3)], "k int, v string, n int")
    assert {tuple(r) for r in P.pick(df, ["k"], [-F.col("n"), F.col("v")], "v", "n").collect()} == {(1, "b", 3), (2, None, 1)}
    assert {tuple(r) for r in df.groupBy("k").agg(P.join_ordered(F.col("v"), F.col("n")).alias("o"), P.join_sorted(F.col("v")).alias("s")).collect()} == {(1, "a; b", "a; b"), (2, "", "")}
    with pytest.raises(Exception, match="not unique"):
        P.left_join_one(df, df.select("k", F.col("v").alias("w")), ["k"]).collect()
    assert P.varying_columns(df, ["k", "n"]) == ["k", "n"]
    assert [r.v for r in P.top_or_other(df, "v", 1).orderBy("n", "v").collect()] == [None, "b", "other", "b"]


@pytest.mark.parametrize(("cells", "odds", "p"), [((930, 1669, 8137, 18758), 0.716, 3.76e-22), ((264, 1669, 1600, 18758), 1.013, 5.72e-20), ((1490, 1669, 16413, 18758), 0.247, 0.0360), ((729, 1669, 8146, 18758), 0.015, 0.857)])
def test_contrasts_have_known_values(spark, cells, odds, p):
    got = T.compare_binary(spark.createDataFrame([cells], "a long, n long, c long, m long"), "a", "n", "c", "m").first()
    assert got.log2_or == pytest.approx(odds, abs=6e-4) and got.p_value == pytest.approx(p, rel=6e-3)


def test_small_tables(spark):
    rows = [(0, 5, 3, 5), (3, 3, 0, 3), (1, 9, 11, 14), (0, 0, 0, 0)]
    got = [(r.log2_or, r.p_value, r.descriptive_only) for r in T.compare_binary(spark.createDataFrame(rows, "a int, n int, c int, m int").coalesce(1), "a", "n", "c", "m").collect()]
    assert got[0][0] is None and got[0][2]
    assert got[0][1] == pytest.approx(1 / 6) and got[1][1] == pytest.approx(0.1) and got[3][1] == 1.0


def test_ranks(spark):
    rows = [("x", True, v) for v in (1.0, 2.0, 3.0)] + [("x", False, v) for v in (4.0, 5.0, 6.0)] + [("t", True, 1.0), ("t", True, 1.0), ("t", False, 1.0), ("t", False, 1.0), ("one", True, 1.0), ("one", False, 2.0), ("x", True, None)]
    df = spark.createDataFrame(rows, "b string, g boolean, v double")
    got = {r.b: r for r in T.compare_continuous(df, ["b"], "v", F.col("g"), ~F.col("g")).collect()}
    assert got["x"].cliffs_delta == -1 and got["x"].p_value == pytest.approx(0.1) and got["x"].n_group == 3
    assert got["t"].cliffs_delta == 0 and got["t"].p_value == 1 and got["one"].p_value is None
    k = T.kruskal(df.where("b = 'x'"), ["b"], "v", "g").first()
    assert k.h == pytest.approx(27 / 7)
    assert T._chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9) and T._chi2_sf(30.0, 3) == pytest.approx(1.3800570312932e-06, rel=1e-6)


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.04, 0.03, None, 0.5)] + [("b", 0.2)], "b string, p_value double")
    got = {(r.b, r.p_value): r.p_fdr for r in T.benjamini_hochberg(df, ["b"]).collect()}
    assert got["a", 0.01] == pytest.approx(0.04) and got["a", 0.03] == pytest.approx(0.16 / 3) and got["a", 0.04] == pytest.approx(0.16 / 3) and got["a", 0.5] == 0.5 and got["a", None] is None and got["b", 0.2] == 0.2


def test_clusterings(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.1, (30, 3)) for c in (0, 5, 10)])
    d = C.manhattan(x)
    truth = np.repeat([0, 1, 2], 30)
    same = lambda a: len({*zip(a.tolist(), truth.tolist())}) == 3 == len(set(a.tolist()))
    assert same(C.pam(d, 3)) and same(C.average_linkage(d, 3))
    labels, strength = C.hdbscan(d, 10, 5)
    assert same(labels) and strength.max() == 1
    flat = np.array([[0.0, 0.0], [3.0, 0.0], [0.0, 4.0]])
    e = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(-1))
    xy, share = C.pcoa(e)
    assert np.allclose(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), e) and share.sum() == pytest.approx(1)
    df = spark.createDataFrame([("g", i, *map(float, v)) for i, v in enumerate(x)], "g string, i int, a double, b double, c double")
    out = C.cluster_groups(df, "g", "i", ["a", "b", "c"], 3, 10, 5).orderBy("i").toPandas()
    assert same(out["pam"].to_numpy()) and same(out["hierarchical"].to_numpy())
    ids = spark.createDataFrame([(i, "p" if i < 2 else "q", float(i), 1.0) for i in range(4)], "i int, kind string, v double, constant double")
    g = {(t.i, t.j): t.distance for t in C.gower(ids, "i", categorical=["kind"], continuous=["v", "constant"]).collect()}
    assert g[0, 1] == pytest.approx(1 / 6) and g[0, 3] == pytest.approx(1.0)
    m = {t.kind: t.medoid for t in C.medoids(C.gower(ids, "i", continuous=["v"]), ids, "i", "kind").collect()}
    assert m == {"p": 0, "q": 2}
    assert math.isclose(T.adjusted_rand(ids, "kind", "kind").first().ari, 1.0)


def test_clusterings_read_whole_vectors(spark, tmp_path):
    """Vectors that are equal in the first components and form three groups in the last one."""
    from strandmill.plans import stat_queries

    rows = [(i, [0.0] * 11 + [100.0 * (i % 3) + i / 100], 0) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = stat_queries.clusterings(spark, str(tmp_path)).toPandas()
    assert (out.groupby(out.vec_id % 3)["pam"].nunique() == 1).all() and out["pam"].nunique() == 3
