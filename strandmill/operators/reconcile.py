"""Reconciling a table with a background: cascades of keys, what is known of the rest by gene, and labels that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.select import priority_union

ALREADY, UNLABELED, NOT_THERE, NO_GENE = "gene_already_labeled", "gene_in_background_unlabeled", "gene_not_in_background", "no_gene_mapping"


def cascade(master: DataFrame, background: DataFrame, levels: dict[str, tuple[Column, Column]], absent: str = "absent", name: str = "bucket") -> DataFrame:
    """``master`` with the first level at which its key is found in the background.

    A level is a pair of keys, of the master and of the background; each works on what the levels
    before it left. Null keys are found nowhere. Repeated rows are settled each on its own."""
    out = master.drop(name).withColumn("__bucket", F.lit(None).cast("string"))
    for label, (ours, theirs) in levels.items():
        known = background.select(theirs.cast("string").alias("__key")).where("__key IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
        # rows that are settled or have no key get one that nobody has: as nulls they would all meet in one task
        own = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
        asked = F.when(F.col("__bucket").isNull() & ours.isNotNull(), ours.cast("string")).otherwise(own)
        out = out.withColumn("__key", asked).join(known, "__key", "left").withColumn("__bucket", F.coalesce("__bucket", F.when(F.col("__hit"), label))).drop("__key", "__hit")
    return out.withColumn("__bucket", F.coalesce("__bucket", F.lit(absent))).withColumnRenamed("__bucket", name)


def gene_buckets(rows: DataFrame, gene: str, labelled: DataFrame, background: DataFrame, name: str = "gene_bucket") -> DataFrame:
    """``rows`` with what their gene tells: among the genes of ``labelled`` rows, only in the background, in neither, or unknown."""
    key = F.col(gene)
    return cascade(rows, labelled.select(F.lit(ALREADY).alias("s"), key.alias("g")).unionAll(background.select(F.lit(UNLABELED).alias("s"), key.alias("g"))), {ALREADY: (key, F.when(F.col("s") == ALREADY, F.col("g"))), UNLABELED: (key, F.when(F.col("s") == UNLABELED, F.col("g")))}, NOT_THERE, name).withColumn(name, F.when(key.isNull(), NO_GENE).otherwise(F.col(name)))


def label_patch(rows: DataFrame, gene: str, background: DataFrame, accession: str, bucket: str = "gene_bucket") -> DataFrame:
    """(accession, gene): the background's entries of genes that only the background has, which need the rows' label."""
    genes = rows.where(F.col(bucket) == UNLABELED).select(gene).distinct()
    return background.where(F.col(accession).isNotNull()).join(genes, gene, "left_semi").select(accession, gene).distinct()


def assembled(direct: DataFrame, patch: DataFrame, appended: DataFrame, accession: str) -> DataFrame:
    """A row per accession with ``label_source``: direct before gene_patch before master_appended."""
    named = lambda df, label: df.where(F.col(accession).isNotNull()).select(accession, F.lit(label).alias("label_source")).distinct()
    return priority_union([named(direct, "master_direct"), named(patch, "gene_patch"), named(appended, "master_appended")], [accession], ["label_source"]).drop("priority")
