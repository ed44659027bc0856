"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.topk import top_k

    return top_k(_read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmill.llm.bpe import read_ranks, token_digests

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmill.llm.packed import read_ids, write_ids

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return read_ids(write_ids(_read(spark, sf_dir, "documents"), tokenizer, 2), digests=True)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.simhash import near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.substring import removal_digests

    return removal_digests(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm._common import cut
    from strandmill.llm.warc import assemble, read_records, write_captures

    folder = write_captures(_read(spark, sf_dir, "pages"))
    captures = assemble(read_records(spark, folder, content=False)).select("response.*", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"))
    captures = cut(captures.select("record_id", "type", "refers_to", "payload_bytes", "payload_digest", "page_id"))
    original = captures.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"), F.col("page_id").alias("original_page"))
    met = captures.join(original, "refers_to", "left")
    return met.select("page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("original_page").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.pii import KINDS, find

    found = find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "context")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.quality import judge

    return judge(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("rejected_by")


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.ngram_lm import score

    return score(_read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM twice),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS wordlike FROM d),
q AS (SELECT m.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN again USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * len(lines)) OR 10 * wordlike < 7 * n_words) AS kept
FROM b
"""


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmill.llm.packing import pack

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return pack(_read(spark, sf_dir, "documents"), tokenizer, 2, 1024, digests=True)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.merkle import audit, tampered

    return audit(_read(spark, sf_dir, "documents"), tampered())


OP12_SQL = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 AS hit
  FROM documents
), l AS (
  SELECT r, doc_id, g, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) || z) AS seen FROM f
), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM l),
nodes AS (
  SELECT g, 0 AS k, p, leaf AS h, n FROM o
  UNION ALL SELECT g, any_value(k) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, p // 2
), subs AS (SELECT g, h, k, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS k, p, h, n FROM subs
  UNION ALL SELECT any_value(k) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY p // 2
), beside AS (
  SELECT o.r, s.k, s.p % 2 AS right_, s.h FROM o JOIN nodes s ON s.g = o.g AND s.p = xor(o.p >> s.k, 1)
  UNION ALL SELECT o.r, 1000 + s.k, s.p % 2, s.h FROM o JOIN subs u USING (g) JOIN tops s ON s.p = xor(u.p >> s.k, 1)
), proofs AS (SELECT r, sha256(string_agg(h, '' ORDER BY k)) AS proof FROM beside GROUP BY r),
up AS (
  SELECT o.r, 0 AS k, o.seen AS h, u.k AS own, u.k + (SELECT max(k) FROM tops) AS last FROM o JOIN subs u USING (g)
  UNION ALL
  SELECT up.r, up.k + 1, sha256(CASE WHEN b.right_ = 0 THEN b.h ELSE '' END || up.h || CASE WHEN b.right_ = 1 THEN b.h ELSE '' END), own, last
  FROM up LEFT JOIN beside b ON b.r = up.r AND b.k = CASE WHEN up.k < own THEN up.k ELSE 1000 + up.k - own END WHERE up.k < last
)
SELECT doc_id, leaf, u.h AS subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, up.h AS folded_root, up.h = t.h AS verified
FROM o JOIN subs u USING (g) JOIN up ON up.r = o.r AND up.k = up.last LEFT JOIN proofs q ON q.r = o.r JOIN tops t ON t.n = 1
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm.divergence import audit

    return audit(_read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v)::HUGEINT)::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + v)::HUGEINT)::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {f.__name__: f for f in (op1_simhash, op2_substring, op3_topk, op4_mixing, op5_warc, op6_pii, op7_quality, op8_bpe, op9_packed_ids, op10_ngram_lm, op11_packing, op12_merkle, op13_divergence)}

ORACLES = {"op2_substring": OP2_SQL, "op3_topk": OP3_SQL, "op5_warc": OP5_SQL, "op7_quality": OP7_SQL, "op12_merkle": OP12_SQL, "op13_divergence": OP13_SQL}
