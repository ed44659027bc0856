"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import bpe, quality
from strandmill.llm._common import keep
from tests.llm.test_operators import slow_base, slow_components, slow_fingerprint, texts, words_of


def test_stages(spark, tmp_path):
    rows = texts(n=80) + [" ".join(f"v{(7 * i + j) % 90}" for j in range(80)) + f" mail me{i}@x.example.org or 10.0.0.{i}" for i in range(30)]
    data = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(rows)]
    folder = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    pairs = lambda df: {(r.doc_id, r.text) for r in df.collect()}

    a = keep(stages[names[0]](spark, docs, folder), "t")
    rules = (quality.BASE | quality.FURTHER).values()
    assert a.columns == columns and pairs(a) == {(i, t) for i, t, *_ in data if not any(r(quality.Text((t or "").encode())) for r in rules)}

    b = keep(stages[names[1]](spark, a, folder), "t")
    were = sorted(pairs(a))
    of = slow_components([slow_fingerprint(t, corpus_pipeline.SHINGLE) for _, t in were], corpus_pipeline.MAX_BITS)
    assert b.columns == columns and pairs(b) == {were[i] for i in set(of)}

    c = keep(stages[names[2]](spark, b, folder), "t")
    was = dict(pairs(b))
    assert c.columns == columns and c.count() == len(was)
    for r in c.collect():
        t, at, out = was[r.doc_id], 0, ""
        for start, end, kind in sorted((s, e, k) for k, s, e in slow_base(t)):
            if start >= at:
                out += t[at:start] + f"<{kind.upper()}>"
            at = max(at, end)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)

    d = keep(stages[names[3]](spark, c, folder), "t")
    assert d.columns == columns and not d.select("doc_id").exceptAll(d.select("doc_id")).count()
    size = {r.doc_id: len(words_of(r.text)) for r in c.collect()}
    took: dict = {}
    for r in d.collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + len(words_of(r.text))
    assert all(0 < n <= 3 * size[i] for i, n in took.items())
    assert abs(sum(took.values()) - sum(size.values())) <= 0.02 * sum(size.values()) + 4

    e = stages[names[4]](spark, d, folder)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [known.encode_ordinary(r.text) for r in d.collect()]
    assert sorted(r.ids_sha256 for r in e.collect()) == sorted(hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids)

    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert got == sorted(map(tuple, e.collect()))
    assert corpus_pipeline.STAGES[0][1](spark, docs.where(F.lit(False)), folder).count() == 0
