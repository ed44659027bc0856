"""The manifest against a tree built in memory."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandmill.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, columns=merkle.COLUMNS):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))


def slow_tree(nodes, arity):
    """The top, and per node its (left, right) siblings from below."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity : i // arity * arity + arity]
            paths[k].append((run[: i % arity], run[i % arity + 1 :]))
            at[k] = i // arity
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def slow_audit(rows, arity=2):
    def lang(r):
        return (r["lang"] is not None, (r["lang"] or "").encode())

    rows = sorted(rows, key=lambda r: (lang(r), r["doc_id"] is not None, r["doc_id"] or 0, slow_leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lang)]
    trees = [slow_tree([slow_leaf(r) for r in g], arity) for g in groups]
    root, tops = slow_tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(g, paths):
            now = dict(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                now["n_chars"] += 1
            h = slow_leaf(now)
            for a, b in (*path, *top):
                h = digest(*a, h, *b)
            proof = digest(*(x for a, b in (*path, *top) for x in (*a, *b)))
            out.append((r["doc_id"], slow_leaf(r), subroot, root, proof, h, h == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, leaf string, path string"


def rows_of():
    texts = ["", None, "é|漢 :-", "x" * 3_000_000, "a b"]
    rows = [(i, texts[i % 5] if i < 10 else f"text {i}", "hot", f"s{i % 3}" if i % 4 else None, i if i % 6 else None, 1, "l", "p") for i in range(300)]
    rows += [(1000 + i, "t", lang, "s", 7, 1, "l", "p") for i, lang in enumerate([None, None, "", "-", "ä", "z", "Z", "b", "b", "b"])]
    return rows + rows[:2] + [(None, "n", "b", "s", 1, 1, "l", "p"), (None, "m", "b", None, None, 1, "l", "p"), (5, "other text of the same id", "hot", "s", 3, 1, "l", "p")]


@pytest.mark.parametrize("arity", [2, 3])
def test_audit(spark, arity, monkeypatch):
    if arity == 3:
        monkeypatch.setattr(merkle, "LEVELS", 2)
    df = spark.createDataFrame(rows_of(), SCHEMA)
    got = merkle.audit(df, merkle.tampered(), arity=arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == slow_audit([r.asDict() for r in df.collect()], arity)
    assert {v for *_, v in got} == {True, False}


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame(rows_of()[1:2], SCHEMA)
    row = merkle.audit(df, {}).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == digest()
    assert merkle.audit(df.limit(0), merkle.tampered()).count() == 0
    assert merkle.build(df.limit(0)).root is None


def test_order_of_rows_does_not_matter(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    assert merkle.build(df).root == merkle.build(df.repartition(7).orderBy(F.rand(1))).root
    assert merkle.build(df).root != merkle.build(df.where("doc_id <> 299")).root
