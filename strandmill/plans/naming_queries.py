"""Queries of names, keywords and vocabularies, checked joins, first and last rows; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import rules as R
from strandmill.functions import scalar as X
from strandmill.functions.vocabulary import DOMAIN_NAME_TIERS, METHOD_ALIASES, RNA_CLASS_ALIASES, RNA_CLASS_TERMS, TARGET_WORDS
from strandmill.operators import select as P
from strandmill.plans.registry import query
from strandmill.plans.tables import CALLS_SQL, calls, read

WORDS = ["steel", "TIN", "a.b", "(x", "brushed copper"]


@query("SELECT p_partkey, regexp_matches(lower(p_type), 'steel|tin|a\\.b|\\(x|brushed copper') AS hit FROM part")
def keyword_filter(spark, d):
    """Names that hold one of some keywords, taken literally and in any case."""
    return read(spark, d, "part").select("p_partkey", X.any_keyword(F.col("p_type"), WORDS).alias("hit"))


@query("WITH o AS (SELECT o_custkey AS k, 'A' || o_orderkey AS acc, o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS p FROM orders) SELECT k, coalesce(arg_min(acc, o_orderkey) FILTER (WHERE p), arg_min(acc, o_orderkey)) AS acc, count(*) AS n_rows, bool_or(p) AND NOT arg_min(p, o_orderkey) AS upgraded FROM o GROUP BY 1")
def preferred_upgrade(spark, d):
    """The first accession of a key, or the first of the preferred database where it has one."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("A"), "o_orderkey").alias("acc"), "o_orderkey", "o_orderpriority")
    return P.upgraded(o, ["k"], [F.col("o_orderkey")], F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "acc")


@query("WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations) SELECT conv_id, turn, role, place::INTEGER AS place, from_end::INTEGER AS from_end FROM c WHERE place <= 2 OR from_end <= 2")
def first_and_last(spark, d):
    """The first two and last two turns of every conversation."""
    return P.ends(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 2)


@query("SELECT s_suppkey, trim(' ' || s_name || chr(9), ' ' || chr(9)) AS cleaned, upper(trim(s_name)) AS symbol, CASE WHEN s_acctbal < 0 THEN '' ELSE 'x' END AS empty, upper(trim(s_name)) AS gene, 'P' || s_suppkey AS accession FROM supplier")
def normalised_names(spark, d):
    """Text without blanks at its ends, symbols, genes of entry names and accessions without their isoform."""
    s, n = read(spark, d, "supplier"), F.col("s_name")
    return s.select("s_suppkey", X.cleaned(F.concat(F.lit(" "), n, F.lit("\t"))).alias("cleaned"), X.gene_symbol(n).alias("symbol"), X.cleaned(F.when(F.col("s_acctbal") >= 0, "x ")).alias("empty"), X.gene_of_entry(F.concat(n, F.lit("_human"))).alias("gene"), X.without_isoform(F.concat(F.lit("p"), "s_suppkey", F.lit("-2"))).alias("accession"))


_SPELT = ["SEG strict", "seg-intermediate", "fLPS", "LCR_Finder", "AlcoR", "Cast ", "unknown tool"]
_CLASSES = ["Ribosomal Proteins", "mRNA-binding", "tRNA", "rRNA", "ncRNA-binding proteins", "Diverse targets", "unknown"]


def _spelt_sql(values: list[str], aliases: dict[str, str], key) -> str:
    pairs = [(v, aliases.get(key(v), v.strip())) for v in values]
    return "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{to}'" for i, (_, to) in enumerate(pairs)) + " END"


def _alnum(v: str) -> str:
    return "".join(c for c in v.lower() if c.isalnum())


@query(f"SELECT p_partkey, {_spelt_sql(_SPELT, METHOD_ALIASES, _alnum)} AS method, {_spelt_sql(_CLASSES, {_alnum(k): v for k, v in RNA_CLASS_ALIASES.items()}, _alnum)} AS rna_class FROM part")
def alias_names(spark, d):
    """Spellings of methods and classes in their canonical form; a name without one stays."""
    at = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % 7).cast("int"))
    classes = {_alnum(k): v for k, v in RNA_CLASS_ALIASES.items()}
    return read(spark, d, "part").select("p_partkey", X.alias(at(_SPELT), METHOD_ALIASES).alias("method"), X.alias(at(_CLASSES), classes).alias("rna_class"))


_DOMAINS = ["KH_1", "RRM_1", "Helicase_C", "Ribosomal_L2", "Flavi_capsid", "DEAD", "tRNA-synt_1", "WD40", "HTH_3", "LSM"]


@query("SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in _DOMAINS) + "][p_partkey % 10 + 1] AS name, CASE " + " ".join(f"WHEN regexp_matches([{', '.join(repr(x) for x in _DOMAINS)}][p_partkey % 10 + 1], '(?i){p}') THEN {'NULL' if label is None else repr(label)}" for label, p in DOMAIN_NAME_TIERS) + " END AS tier FROM part")
def domain_tiers(spark, d):
    """Domain names by the fixed tiers; the first tier rejects."""
    name = F.get(F.array(*map(F.lit, _DOMAINS)), (F.col("p_partkey") % 10).cast("int"))
    return read(spark, d, "part").select("p_partkey", name.alias("name"), R.first_match(name, DOMAIN_NAME_TIERS).alias("tier"))


@query(f"WITH {CALLS_SQL} SELECT method, count(*) AS n, count(*) FILTER (WHERE s >= 1 AND s <= e AND e <= 10000) AS sane FROM calls GROUP BY 1")
def interval_sanity(spark, d):
    """Calls that lie within a sequence of ten thousand residues."""
    c = calls(spark, d)
    return c.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_sane(F.col("start"), F.col("end"), F.lit(10000))).alias("sane"))


@query("SELECT unnest(['c_nationkey', 'c_acctbal', 'parity']) AS kept, (SELECT count(*) FROM customer) AS n")
def varying_columns(spark, d):
    """Which columns have more than one value, and the rows that keep them."""
    c = read(spark, d, "customer").select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 2).alias("parity"), F.lit(1).alias("constant"), F.lit(None).cast("int").alias("empty"))
    kept = P.varying_columns(c, c.columns)
    return c.select(*kept).agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, kept))).alias("kept"), "n")


@query("SELECT o_orderkey, c_name, CASE WHEN c_name IS NULL THEN 'left_only' ELSE 'both' END AS match FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def checked_join(spark, d):
    """A left join whose right side must have each key once, with where each row was found."""
    c = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = P.audited_join(P.left_join_one(read(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]), c.select("o_custkey"), ["o_custkey"])
    return found.select("o_orderkey", "c_name", "match")


_NAMES = ["tRNA ligase", "40S ribosomal protein S3", "kinase", "mRNA export factor", "snRNP core", "RNase P subunit", "helicase"]
_GO = ["", "tRNA processing", "structural constituent of ribosome", "rna degradation", "miRNA loading"]
_OTHER = ["nucleus", "spliceosome", "7SK complex"]


def _at(values: list[str], column: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{column} % {len(values)} + 1]"


def _classes_sql() -> str:
    fields = ("name", "go", "other")
    per = []
    for c, terms in sorted(RNA_CLASS_TERMS.items()):
        hit = lambda f, t: f"regexp_matches({f}, '(?i){t}')::INTEGER"
        hits = [" + ".join(hit(f, t) for t in terms) for f in fields]
        per.append(f"{{'f': -({' + '.join(f'(({h}) > 0)::INTEGER' for h in hits)}), 'h': -({' + '.join(hits)}), 'n': '{c}', 'at': list_filter([{', '.join(f'CASE WHEN ({h}) > 0 THEN {f!r} END' for f, h in zip(fields, hits))}], lambda x: x IS NOT NULL)}}")
    words = "|".join(TARGET_WORDS)
    return f"""WITH p AS (SELECT p_partkey, p_partkey % 11 = 0 AS told, {_at(_NAMES, 'p_partkey')} AS name, {_at(_GO, 'p_size')} AS go, {_at(_OTHER, 'p_partkey')} AS other FROM part),
r AS (SELECT *, list_sort(list_filter([{', '.join(per)}], lambda x: x.h < 0)) AS r FROM p)
SELECT p_partkey, CASE WHEN told THEN 'snRNA' ELSE coalesce(r[1].n, 'unknown') END AS rna_primary_class, CASE WHEN told THEN '' ELSE array_to_string(list_transform(r[2:], lambda x: x.n), '; ') END AS rna_secondary_class,
CASE WHEN told THEN 'very high' WHEN len(r) = 0 THEN 'unknown' WHEN len(r[1].at) >= 2 THEN 'high' WHEN r[1].at = ['name'] AND regexp_matches(lower(name), '{words}') THEN 'high' WHEN r[1].at = ['name'] THEN 'low' ELSE 'medium' END AS confidence,
CASE WHEN told THEN 'literature based' ELSE concat_ws('; ', CASE WHEN list_contains(r[1].at, 'go') THEN 'GO based' END, CASE WHEN list_contains(r[1].at, 'name') OR list_contains(r[1].at, 'other') THEN 'UniProt annotation/metadata' END) END AS evidence_source FROM r"""


@query(_classes_sql())
def rna_class_labels(spark, d):
    """Target classes by literature, else by terms in names, ontology and annotation, with how sure they are."""
    at = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    p = read(spark, d, "part").select("p_partkey", at(_NAMES, "p_partkey").alias("name"), at(_GO, "p_size").alias("go"), at(_OTHER, "p_partkey").alias("other"))
    told = read(spark, d, "part").where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("k"), F.lit("snRNA").alias("rna_primary_class"), F.lit(1).alias("ord"))
    found = R.rna_classes(p, [("p_partkey", told, "k")], "name", ["go"], ["other"])
    return found.select("p_partkey", "rna_primary_class", "rna_secondary_class", "confidence", "evidence_source")
