"""Whole queries against brute-force versions, and texts of over a million words."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandmill.llm import bpe, mixing, packed, quality, queries, simhash, substring
from tests.llm.test_operators import slow_components, slow_fingerprint, texts, words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, ["de", "en"][i % 2], f"s{i % 5}" if i % 6 else None, len(t or "")) for i, t in enumerate(texts(n=90))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def known_ids():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_op1(spark, folder):
    path, rows = folder
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    of = slow_components(prints)
    want = {(i, f"{p:016x}", rows[min(k for k, c in enumerate(of) if c == of[i])][0]) for i, p in enumerate(prints)}
    got = queries.op1_simhash(spark, path)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and {tuple(r) for r in got.collect()} == want


def test_op4(spark, folder):
    path, rows = folder
    got = {r.doc_id: r for r in queries.op4_mixing(spark, path).collect()}
    size = {i: len(words_of(t)) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size[r[0]] for r in rows if r[3] == s) for s in sources]
    # targets: shares by weight, stopped at three times the size, what is over shared anew
    free, target = set(range(len(sources))), [Fraction(0)] * len(sources)
    while free:
        left = sum(totals) - sum(target[i] for i in range(len(sources)) if i not in free)
        each = Fraction(left) / sum(i % 3 + 1 for i in free)
        over = [i for i in free if each * (i % 3 + 1) > 3 * totals[i]]
        for i in over or list(free):
            target[i] = Fraction(3 * totals[i]) if over else each * (i % 3 + 1)
            free.discard(i)
    for i, r in got.items():
        s = sources.index(rows[i][3])
        assert (r["size"], r.source_size) == (size[i], totals[s]) and abs(r.target - float(target[s])) < 1e-6 and 0 <= r.taken <= 3 * size[i]
    for s, source in enumerate(sources):
        assert abs(sum(r.taken for i, r in got.items() if rows[i][3] == source) - target[s]) <= 0.02 * target[s] + 2
    mixed = Counter()
    for r in mixing.mixed_documents(spark.read.parquet(f"{path}/documents.parquet")).collect():
        mixed[r.doc_id] += len(words_of(r.text))
    assert mixed == Counter({i: r.taken for i, r in got.items() if r.taken})
    assert {(i, r.taken) for i, r in got.items()} == {(r.doc_id, r.taken) for r in queries.op4_mixing(spark, path).collect()}


def test_op8(spark, folder):
    path, rows = folder
    encode, want = known_ids(), set()
    for i, t, *_ in rows:
        ids = encode(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op8_bpe(spark, path).collect()} == want


# texts of over a million words


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(11)
    words = [f"w{r.randrange(5000)}" for _ in range(1_050_000)]
    passage = [f"p{i}" for i in range(60)]
    words[200:260] = words[999_980:1_000_040] = passage  # the second one lies over the border of two parts
    return " ".join(words)


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    return spark.createDataFrame([(1, long_text, "a", "en", len(long_text)), (2, "a short text", "b", "en", 12), (3, " ".join(long_text.split()[220:258]), "b", "en", 9)], "doc_id long, text string, source string, lang string, n_chars long")


def test_long_texts_substring(long_docs, long_text):
    got = {r.doc_id: r for r in substring.removal_digests(long_docs).collect()}
    words = long_text.split()
    kept = words[:200] + words[260:999_980] + words[1_000_040:]
    assert (got[1].n_words, got[1].n_removed) == (len(words), 120) and got[1].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert got[2].n_removed == 0 and got[3].n_removed == 38


def test_long_texts_simhash_mixing_quality(long_docs, long_text):
    prints = {r.doc_id: r.fp % 2**64 for r in simhash.near_duplicates(long_docs).collect()}
    assert prints[1] == slow_fingerprint(long_text)
    mixed = {r.doc_id: r for r in mixing.mix(long_docs).collect()}
    assert mixed[1]["size"] == 1_050_000 and sum(b.times * (b.to - b["from"]) for b in mixed[1].mix_blocks) == mixed[1].taken
    judged = {r.doc_id: r for r in quality.judge(long_docs).collect()}
    assert judged[1].n_words == 1_050_000 and judged[1].kept and judged[2].base_failed


def test_long_texts_tokens(long_docs, long_text):
    ids = known_ids()(long_text)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r.doc_id: r for r in bpe.token_digests(long_docs, ranks, public_tokenizers.PATTERN).collect()}
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    found = {r.doc_id: r.ids for r in packed.read_ids(packed.write_ids(long_docs, tokenizer, 2)).collect()}
    assert np.array_equal(found[1], [*Tokenizer.from_str(tokenizer).encode(long_text, add_special_tokens=False).ids, 2])
