"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from strandmill.llm import bpe, mixing, ngram_lm, packed, pii, quality, simhash, substring, topk, warc

WORDS = [f"w{i}" for i in range(40)]


def texts(seed=1, n=60):
    r = random.Random(seed)
    some = [" ".join(r.choices(WORDS, k=r.choice([3, 20, 70, 150]))) for _ in range(n)]
    near = [t + " tail" for t in some[:6]]
    return [*some, *some[:5], *near, "", None, "a", "A b", "x" * 5000, " \t\n ", "línea única\x0bé", *([" ".join(WORDS)] * 4)]


def documents(spark, rows=None, extra=True):
    rows = texts() if rows is None else rows
    data = [(None if i % 31 == 30 else i, t, f"s{i % 3}" if i % 7 else None, 1.5) for i, t in enumerate(rows)]
    data += data[:2]
    return spark.createDataFrame(data, "doc_id long, text string, source string, size double" if extra else "doc_id long, text string, source string, other double")


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


# 1


def slow_fingerprint(t, shingle=3):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words_of(t)]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, max_bits=2):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= max_bits:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    of = slow_components(prints)
    least = {c: min((rows[i][0] for i in range(len(rows)) if of[i] == c and rows[i][0] is not None), default=None) for c in of}
    want = sorted(((d, p, least[c]) for (d, _), p, c in zip(rows, prints, of)), key=str)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_dense_groups_are_descended(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 16)
    r = random.Random(4)
    prints = {0, 2**64 - 1}
    for centre in (r.getrandbits(64) for _ in range(3)):
        for _ in range(150):
            x = centre
            for b in r.choices(range(64), k=r.randrange(5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {x.a: x.root for x in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    of = slow_components(prints)
    groups = lambda key: {frozenset(s for s, k in zip(signed, key) if k == x) for x in key}
    assert groups(of) == groups([got.get(s, s) for s in signed])


def test_one_of_each(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(slow_components([slow_fingerprint(t) for _, t in rows])))


# 2


def slow_removal(rows, window):
    seen = Counter()
    for _, t in rows:
        w = words_of(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 256])
def test_substring(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(45))
    shared = [" ".join(r.choices(WORDS, k=30)) + " " + passage + " " + " ".join(r.choices(WORDS, k=30)) for _ in range(20)]
    df = documents(spark, [*texts(), *shared, "ab " * 90])
    rows = [(x.doc_id, x.text) for x in df.collect()]
    assert sorted(map(tuple, substring.removal_digests(df).collect()), key=str) == slow_removal(rows, 35)
    assert substring.removal_digests(df.limit(0)).count() == 0
    kept = substring.remove_repeats(df, 8)
    assert kept.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted((r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept.collect()) == sorted(x[1:] for x in slow_removal(rows, 8))


def test_index_counts_windows():
    r = np.random.default_rng(3)
    for _ in range(40):
        window = int(r.integers(2, 8))
        some = [r.integers(1, int(r.integers(2, 5)) + 1, int(r.integers(window, 22))) for _ in range(int(r.integers(1, 12)))]
        seen = Counter(tuple(t[i : i + window].tolist()) for t in some for i in range(len(t) - window + 1))
        for t, got in zip(some, substring.repeated_windows(substring.FMIndex(some), some, window)):
            assert got.tolist() == [seen[tuple(t[i : i + window].tolist())] > 1 for i in range(len(t) - window + 1)]


def test_substring_tells_rows_of_one_id_apart(spark):
    # texts under a null id and under one repeated id, so many that 16 bits of hashes agree for some
    passage = " ".join(f"p{j}" for j in range(40))
    own = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    rows = [(None if i % 4 < 2 else -1, own(i, 40) + " " + passage if i % 2 else own(i, 80)) for i in range(3000)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out)
    assert got == sorted((str(d), 80, 40 * (i % 2), own(i, 40 if i % 2 else 80)) for i, (d, _) in enumerate(rows))


# 3


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(60)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (450, [1.0, 2.0]), (451, [3.0, 1.0]), (None, [1.0] * 6), (7, [9.0] * 6), (50, [2.0] * 6), (50, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for row, (q, v) in enumerate(clean):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, x)), i) for other, (i, x) in enumerate(clean) if other != row and len(x) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(map(tuple, topk.top_k(df, 5, F.col("vec_id") % 50 == 0, query_block=3, candidate_block=37).collect()))
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), 5, F.col("vec_id") % 50 == 0).count() == 0


# 4


def test_apportionment_gives_highest_quotients():
    r = random.Random(1)
    for _ in range(200):
        claims = [Fraction(r.randint(0, 200)) for _ in range(r.randint(1, 12))]
        seats, most = r.randint(0, 80), ([r.randint(0, 30) for _ in claims] if r.random() < 0.5 else None)
        held = [0] * len(claims)
        for _ in range(seats):
            left = [(-c / (2 * held[i] + 1), i) for i, c in enumerate(claims) if c and held[i] < (most or [seats] * len(claims))[i]]
            if left:
                held[min(left)[1]] += 1
        assert mixing.sainte_lague(claims, seats, most) == held


def test_mixing(spark):
    df = documents(spark)
    rows = mixing.mix(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert len(rows) == df.count()
    totals = Counter()
    for r in df.collect():
        totals[r.source] += len(words_of(r.text))
    named = sorted(totals, key=lambda s: (s is None, s or ""))
    target = dict(zip(named, mixing.water_fill([totals[s] for s in named], [1, 2, 3, 1][: len(named)])))
    taken = Counter()
    for r in rows:
        assert r["size"] * 3 >= r.taken >= 0 and r.source_size == totals[r.source] and r.target == pytest.approx(float(target[r.source]))
        taken[r.source] += r.taken
    for s in named:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * totals[s])
    assert mixing.mix(df.limit(0)).count() == 0
    # columns with the names of the mix's own stay as they were
    clash = documents(spark).withColumns({"target": F.lit("t"), "taken": F.lit(7), "mix_blocks": F.lit("b"), "source_size": F.lit(0.5), "__row": F.lit("r")})
    whole = mixing.mixed_documents(clash)
    assert whole.columns == clash.columns
    assert {(r["size"], r.target, r.taken, r.mix_blocks, r.source_size, r["__row"]) for r in whole.collect()} == {(1.5, "t", 7, "b", 0.5, "r")}
    assert sum(len(words_of(r.text)) for r in whole.collect()) == sum(taken.values())


def test_mixing_meets_targets_in_small_shards(spark):
    # many shards of few words, and a source of seven words, beside large ones
    rows = [(i, " ".join(["w"] * (8 + i % 5)), f"s{i % 3}") for i in range(6000)] + [(9000, "a b c d e f g", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, words_per_shard=15, max_shards=100_000).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= max(1, 0.005 * r.target)


# 5


def test_warc(spark, tmp_path):
    long_, longer = "é" * 600, "<p>" + "y" * 2000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/ b", long_), (5, "u", long_), (3, None, long_), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", longer), (8, "u", longer), (None, "u", longer)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string")
    records = warc.read_records(spark, warc.write_captures(pages))
    assert records.count() == 3 * len(rows)
    assert {r.content.decode() for r in records.where("type = 'response'").collect()} == {x or "" for _, _, x in rows}
    caps = warc.assemble(records).collect()
    assert len(caps) == len(rows) and all(c.request and c.metadata for c in caps)
    kinds = Counter((c.metadata.fields.get("page-id"), c.response.type) for c in caps)
    assert kinds == Counter({("1", "revisit"): 1, ("5", "response"): 1, ("3", "revisit"): 1, ("2", "response"): 1, ("4", "response"): 1, ("6", "response"): 1, ("7", "response"): 1, ("8", "response"): 1, ("8", "revisit"): 1, (None, "revisit"): 1})
    assert {c.response.payload_digest for c in caps} == {hashlib.sha1((x or "").encode()).hexdigest() for _, _, x in rows}
    assert warc.assemble(warc.read_records(spark, warc.write_captures(pages.limit(0)))).count() == 0
    # rows of files are known by their place in the file, in whatever order a scan gives them
    pages.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    assert warc._identified(stored, ["page_id"])[1] == "__place" and warc._identified(pages, ["page_id"])[1] != "__place"
    shuffled = warc.assemble(warc.read_records(spark, warc.write_captures(stored.orderBy(F.rand())))).collect()
    assert Counter((c.metadata.fields.get("page-id"), c.response.type) for c in shuffled) == kinds
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# 6


def slow_base(t):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, t or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PII = ["a@b.c_d@e.f x@y a@b@c.d.", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 1.2.3.", "é\U0001f600 4111 1111 1111 1111 +1 (234) 567-8901.", "1" * 20000 + " " + "1 " * 9000 + "a" * 20000 + "@" + "x." * 9000, "", None, "+12 +123-", "a..@x.y.z- 12", "4111-1111-1111-1112", "+1 (968) 555-9369 +4 9"]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "i int, t string")
    got = {r.i: [(s.kind, s.start, s.end) for s in r.b] for r in df.select("i", pii.base_spans(F.coalesce(F.col("t"), F.lit(""))).alias("b")).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(PII)}


def test_context_finds_unseen_identifiers_only_after_telling_words(spark):
    rows = [f"lorem ipsum account: AC-{1000 + 7 * i} dolor sit" for i in range(30)]
    rows += [f"see account: user{i}@mail.example.com now the {i} end" for i in range(150)]
    rows += [f"the quick brown the fox {i}" for i in range(50)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*rows, None, ""])], "doc_id long, text string, base string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert all(len(found[i].context) == 1 for i in range(30))
    assert not any(found[i].context for i in range(30, len(rows) + 2))
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[3] == "lorem ipsum account: <CONTEXT> dolor sit" and out[31] == "see account: <EMAIL> now the 1 end" and out[len(rows)] is None
    assert pii.find(df.limit(0)).count() == 0


def test_right_context_and_shape_find_what_no_left_word_can(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    rows = [f"{word()} user{i}@mail.example.com replied {word()}" for i in range(200)]
    rows += [f"{word()} ID{i}x replied {word()}" for i in range(20)]
    # by a common word, which only instances of one shape follow as seeds
    rows += [f"{word()} of 10.0.{i}.1 {word()}" for i in range(200)] + [f"of 999.0.{i}.1 {word()}" for i in range(9)] + [f"of {word()} of {i} {word()}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {x.doc_id: [s.found for s in x.context] for x in pii.find(df).collect()}
    assert all(found[200 + i] == [f"ID{i}x"] for i in range(20))
    assert all(found[420 + i] == [f"999.0.{i}.1"] for i in range(9))
    assert not any(found[i] for i in (*range(200), *range(220, 420), *range(429, len(rows))))


def test_many_identifiers_in_one_text(spark):
    text = " ".join(f"x{i} é u{i}@m.example.org" for i in range(10_000))
    df = spark.createDataFrame([(1, text), (2, "w" * 300_000 + " a b c 12 " + "y " * 100_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.find(df).where("doc_id = 1").select("base", F.size("context").alias("n")).first()
    spans = [(s.start, s.end) for s in got.base]
    assert spans == [m.span() for m in re.finditer(r"u\d+@m\.example\.org", text)]
    assert pii.redact(df).where("doc_id = 1").first().text.startswith("x0 é <EMAIL> x1 é <EMAIL>")
    assert time.perf_counter() - began < 60


def test_pii_query(spark, tmp_path):
    from strandmill.llm.queries import op6_pii

    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for r in op6_pii(spark, str(tmp_path)).collect():
        base = slow_base(PII[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)


# 7


def test_quality(spark):
    rows = [*texts(), "one two three\n" * 40, "a$ b# " * 40, "same line here\nsame line here\n\n \n", "ab " * 60, "12 34 " * 50, "é " * 70]
    df = documents(spark, rows)
    got = sorted((tuple(r) for r in quality.judge(df.select("doc_id", "text")).drop("rejected_by").collect()), key=str)
    want = []
    for r in df.collect():
        t = r.text or ""
        w = [x.decode() for x in words_of(t)]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        again = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                again.update((i, i + 1, i + 2))
        symbols = sum(c in "#*$%&|<>" for c in t)
        chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        letters = sum(any(c.isalpha() or ord(c) > 127 for c in x) for x in w)
        kept = not (failed or 10 * symbols > len(w) or not 2 * len(w) <= chars <= 15 * len(w) or dup > 3 and 10 * dup > 3 * len(lines) or 10 * letters < 7 * len(w))
        want.append((r.doc_id, len(w), chars, symbols, dup, len(again), failed, kept))
    assert got == sorted(want, key=str)
    assert quality.good_only(df).columns == df.columns
    assert quality.good_only(df).count() == sum(x[-1] for x in want)
    assert quality.judge(df.limit(0)).count() == 0


def test_order_follows_rejections_per_cost():
    def slow(t):
        return sum(range(20000)) < 0

    assert quality.ranked([b"a"] * 50, {"slow": slow, "sharp": lambda t: True})[0] == "sharp"


# 8 and 9

ODD = ["", "a", "  a  b", "a\n b", "a \nb", "  x", "x  y", "  ", "\x1c a b\x1cc d", "aaaaaaa" * 50, "12 34  5", "don't  we'll", "é \U0001f600 x", "a\t b\t\tc", "<|endoftext|> a", "x y z w", "Word, word. Word,.", None]


def test_bpe(spark):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = documents(spark, [*texts(), *ODD])
    for r in bpe.encode_decode(df.select("doc_id", F.col("text").alias("was"), "text"), ranks, public_tokenizers.PATTERN).collect():
        assert r.ids == known.encode_ordinary(r.was or "") and r.decoded.decode() == (r.was or "")
    d = bpe.token_digests(df, ranks, public_tokenizers.PATTERN)
    assert d.columns == ["doc_id", "source", "size", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.token_digests(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_overlapping_pairs_merge_from_the_left():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aaa": 3, b"ab": 4}
    got = bpe.replay([b"aaaaa", b"aab", b"b"], bpe.Merges(ranks))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[2, 3], [2, 1], [1]]


def test_packed_blocks():
    r = np.random.default_rng(0)
    for ids in ([5], [7] * 100, r.integers(0, 2**32, 500), np.append(r.integers(0, 9, 300), 2**32 - 1)):
        ids = np.asarray(ids, np.int64)
        assert packed.unpack_block(packed.pack_block(ids), len(ids)).tolist() == ids.tolist()


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json = f.read()
    whole = Tokenizer.from_str(json)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>. y", "one\n<|endoftext|>\n<|endoftext|> two", "z <|endoftext|><|endoftext|>,"]
    df = documents(spark, [*texts(), *ODD, *special])
    got = sorted(packed.read_ids(packed.write_ids(df, json, 2)).collect(), key=lambda r: r.start)
    want = Counter((r.doc_id, tuple([*whole.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in df.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    digests = {(r.start, r.ids_crc32) for r in packed.read_ids(packed.write_ids(df, json, 2), digests=True).collect()}
    assert digests == {(r.start, zlib.crc32(np.asarray(r.ids, "<u4").tobytes())) for r in got}
    assert packed.read_ids(packed.write_ids(df.limit(0), json, 2)).count() == 0


def test_rows_of_one_id_fill_several_files(spark, monkeypatch):
    monkeypatch.setattr(packed, "TOGETHER", 3)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json = f.read()
    rows = [(7, f"text {i % 50}") for i in range(5000)] + [(None, "same")] * 5000
    files = packed.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), json, 2, files=8)
    assert files.count() == 8 and files.agg(F.max("n_docs")).first()[0] < 3000
    got = packed.read_ids(files, digests=True).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == [None] * 5000 + [7] * 5000


# 10


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1000, 10**7), (3000, 400), (300, 2**50)):
        v = np.sort(r.integers(0, top + 1, n))
        code = ngram_lm.EliasFano(ngram_lm.EliasFano.encode(v))
        assert (code[np.arange(n)] == v).all()
        if n:
            x = r.integers(0, top + 2, 200)
            at, equal = code.successor(x, np.zeros(200, int), np.full(200, n))
            assert (at == np.searchsorted(v, x)).all() and (equal == np.isin(x, v)).all()


@pytest.mark.parametrize("shard_tokens, table_words", [(ngram_lm.SHARD_TOKENS, ngram_lm.TABLE_WORDS), (120, ngram_lm.TABLE_WORDS), (120, 20), (ngram_lm.SHARD_TOKENS, 0)])
def test_language_model(spark, shard_tokens, table_words):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    tokens = lambda t: [*(bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words_of(t)), b"\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count, two, three = Counter(), Counter(), Counter()
    for d, t in rows:
        if not held(d):
            w = tokens(t)
            count.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(count.values()), len(count)
    two, three = ({k: x for k, x in c.items() if x >= 2} for c in (two, three))
    three = {k: x for k, x in three.items() if k[:2] in two}
    one = lambda w: (count[w] + 1) / (n + v + 1)
    after = lambda c, k: sum(max(x - 0.75, 0) for g, x in c.items() if g[:-1] == k)

    def p(a, b, w):
        out = one(w)
        if b is not None and b in count:
            out = max(two.get((b, w), 0) - 0.75, 0) / count[b] + (1 - after(two, (b,)) / count[b]) * out
        if a is not None and (a, b) in two:
            out = max(three.get((a, b, w), 0) - 0.75, 0) / two[a, b] + (1 - after(three, (a, b)) / two[a, b]) * out
        return out

    got = sorted((tuple(r) for r in ngram_lm.score(df, shard_tokens=shard_tokens, table_words=table_words).collect()), key=str)
    want = []
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10(one(x)) for x in w)
        full = sum(math.log10(p(w[i - 2] if i > 1 else None, w[i - 1] if i else None, x)) for i, x in enumerate(w))
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, base, full))
    for g, x in zip(got, sorted(want, key=str)):
        assert g[:5] == x[:5] and g[5] == pytest.approx(x[5], rel=1e-9) and g[6] == pytest.approx(x[6], rel=1e-3, abs=0.02)
    assert ngram_lm.score(df.limit(0)).count() == 0
    assert all(r.score == 0 for r in ngram_lm.score(df.where("doc_id = 1")).collect() if r.held_out and not r.train_tokens)


@pytest.mark.parametrize("chunk", [ngram_lm.CHUNK, 40])
def test_packets_give_each_ngram_once(monkeypatch, chunk):
    # packets of one shard repeat each other's n-grams, of which only the different ones are to be looked up
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    r = np.random.default_rng(1)
    codes = np.array([0, 1, 2, 7, ngram_lm.HASHED + 5, ngram_lm.HASHED + 2**60, ngram_lm.SELDOM])
    packets, given, count = ngram_lm.Packets(), {}, Counter()
    for k in range(50):
        b, a, w = r.choice(codes[:-1], 30), r.choice(np.append(codes[:-1], -1), 30), r.choice(codes, 30)
        n = r.integers(0, 3, 30)
        asked = bytes([k])
        given[asked] = list(zip(b.tolist(), a.tolist(), w.tolist()))
        for g, x in zip(given[asked], n.tolist()):
            count[g] += x
        packets.add(ngram_lm._pack(b, a, w, np.where(w >= ngram_lm.HASHED, w % 1000, 0), n), asked)
    packets.fold()
    assert len(packets.folds) > 1 or chunk > 40
    found = packets.different
    grams = list(zip(*(x.tolist() for x in found.codes())))
    assert grams == sorted(set(count)) and found.n.tolist() == [count[g] for g in grams]
    pairs = list(zip(found.words[found.pair_b].tolist(), found.words[found.pair_w].tolist()))
    assert pairs == sorted({(b, w) for b, _, w in grams}) and [pairs[i] for i in found.pair] == [(b, w) for b, _, w in grams]
    two = Counter()
    for (b, _, w), x in count.items():
        two[b, w] += x
    assert found.pair_n.tolist() == [two[g] for g in pairs]
    assert [packets.of_word[found.w[i]] for i in range(len(grams))] == [w % 1000 if w >= ngram_lm.HASHED else 0 for _, _, w in grams]
    assert {asked: [grams[i] for i in at] for asked, at in packets.spread(np.arange(len(grams)))} == given


def test_language_model_holds_by_count(spark):
    # 8.4 million tokens, of which one is 1 / 2**23, and a pair and a triple of words that occur twice
    filler = " ".join(["f"] * 20_000)
    rows = [(i, filler) for i in range(500)] + [(1001 + i, "rare pair here") for i in range(2)]
    rows = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(i >= 1000 for i, _ in rows) == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = ngram_lm.score(df).where("doc_id = 1001").first()
    assert r.train_tokens > 1 << 23
    # each of the three tokens after the first has a share of at least 1.25 / 2
    assert r.score > math.log10(3 / (r.train_tokens + 6)) + 3 * math.log10(1.25 / 2) - 0.02


# columns of the operators' own names


def test_columns_of_the_operators_own_names_are_kept(spark):
    names = ["doc_id", "text", "source", "kept", "rejected_by", "__kept", "seeds", "others", "__row", "__doc", "__mix_source", "__mix_doc", "__shard", "__m", "n_words"]
    text = " ".join(WORDS + [f"u{i}@m.example.org" for i in range(30)])
    rows = [(i, text, "s", "yes", 3, 1.5, "a", "b", i, "d", "x", "y", "z", "m", "w") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, rejected_by int, __kept double, seeds string, others string, __row int, __doc string, __mix_source string, __mix_doc string, __shard string, __m string, n_words string")
    assert df.columns == names
    assert sorted(map(tuple, quality.good_only(df).collect())) == rows
    found = pii.find(df)
    assert found.columns == [c for c in names if c != "text"] + ["base", "context"]
    assert {(r.seeds, r.others, r["__row"]) for r in found.collect()} == {("a", "b", i) for i in range(4)}
    mixed = mixing.mix(df)
    assert mixed.columns == [c for c in names if c != "text"] + ["size", "source_size", "target", "taken", "mix_blocks"]
    assert {(r["__mix_source"], r["__mix_doc"], r["__m"]) for r in mixed.collect()} == {("x", "y", "m")}
    assert mixing.mixed_documents(df).columns == names and {tuple(r)[2:8] for r in mixing.mixed_documents(df).collect()} == {r[2:8] for r in rows}
    assert pii.redact(df).columns == names
    judged = quality.judge(df)
    assert judged.columns.count("kept") == 1 and {r.kept for r in judged.collect()} == {True}


def test_bpe_of_another_pattern(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"a.": 256, b"a. ": 257}
    df = spark.createDataFrame([(1, "xa. ba."), (2, None), (3, "a. a.")], "doc_id long, text string")
    for pattern in (r"\S+|\s+", r"[\s\S]+"):
        known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        got = {r.doc_id: r.ids for r in bpe.encode_decode(df, ranks, pattern).collect()}
        assert got == {i: known.encode_ordinary(t or "") for i, t in ((1, "xa. ba."), (2, ""), (3, "a. a."))}


def test_bpe_remembers_a_bounded_size(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 100)
    ranks = {bytes([i]): i for i in range(256)}
    held = bpe.Memory(bpe.merge_encoder(bpe.Merges(ranks), bpe.CUTTABLE))
    for k in range(20):
        text = f"{'long' * 50}{k} b{k}."
        assert [list(ids) for ids in held.of(pa.array([text]))] == [list(text.encode())]
        assert len(held.known) < 10


def test_marks_at_the_end_are_learnt_once():
    """Words with other marks after them are their stems and the marks, for the library's encoder and the merges alike."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from strandmill.llm import bpe, packed

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    merges = bpe.merge_encoder(bpe.Merges(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN)
    texts = ["Grün grün$$$ grün.%%% grün&&& grün!! grün... 12 12%% 12.", "$$$ ,. -a- a's' it's. don't'! \n.", "é. é. ½. ²! x . _ __a__ #a# `", "a\nb.\nb,,\n\n c!", "".join(map(chr, range(33, 127)))]
    texts += [f"w{m}" for m in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"] + ["\n".join(f"u{i}v w{i}!" for i in range(250))]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for encode in (packed.library_encoder(tokenizer), merges):
        asked = []
        held = bpe.Memory(lambda parts, encode=encode: asked.extend(parts) or encode(parts), packed.marks(tokenizer))
        assert [x.tolist() for x in held.of(pa.array(texts))] == want
        assert [p for p in asked if "grün" in p] == [" grün"]
    odd = ["a b", " ", "c", " d", "e\u00a0"]
    assert packed.library_encoder(tokenizer)(odd) == [np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in odd]
