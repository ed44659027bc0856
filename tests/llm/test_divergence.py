"""The audit against dense sums over every term, in Python's integers."""

import random
from collections import Counter

from strandmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, value int, rank string"


def rows_of():
    r = random.Random(2)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "don't", "漢字", "q" * 5000, "gamma", "rare"]
    rows = []
    for i in range(240):
        lang, source = r.choice(["en", "en", "en", "fr", None]), r.choice(["hot"] * 8 + ["b", "c", None, f"s{i % 5}"])
        words = r.choices(vocabulary, [2 ** (len(vocabulary) - k) for k in range(len(vocabulary))], k=r.choice([0, 1, 6, 40]))
        rows.append((i, r.choice([" ", "\n", "-"]).join(words), lang, source, "t", 1, 2, "r"))
    rows += [(None, None, "en", "silent", "t", 1, 2, "r"), (1, "only once here", "xx", "a", "t", 1, 2, "r"), (1, "", "xx", "b", "t", 1, 2, "r"), (2, "ab " * 700_000, "fr", "hot", "t", 1, 2, "r")]
    return rows + rows[:3]


def slow_terms(text):
    word, out = "", []
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def slow_audit(rows, least=3, top=200):
    among, of, groups = {}, {}, set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        counts = Counter(slow_terms(text))
        groups.add((lang, source))
        of.setdefault((lang, source), Counter()).update(counts)
        among.setdefault(lang, Counter()).update(set(counts))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in among[lang].items() if d >= least]
        sources = [s for k, s in groups if k == lang]
        whole = Counter()
        for s in sources:
            whole.update(of[lang, s])

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        by, q = {s: p(of[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(by[s][t], by[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(by[s][t], q[t]), t) for t in kept if of[lang, s][t] and by[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_audit(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, got.collect()))
    assert got == slow_audit(rows_of())
    assert {r[4] for r in got if r[0] == "xx"} == {0}
    assert sorted(map(tuple, divergence.audit(df, least_docs=1, top=2).collect())) == slow_audit(rows_of(), 1, 2)


def test_joined_groups_and_no_rows(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, divergence.audit(df).collect())) == slow_audit(rows_of())
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    for text in ["", "a", "Ab1cd ef" * 9, "w" * 50 + " x", "é" * 20 + "-" + "Z" * 3, "1234567890" * 3]:
        assert [t.decode() for some in divergence._terms(text.encode()) for t in some] == slow_terms(text)
