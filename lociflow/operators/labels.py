"""Labels: the true genotype of every candidate allele."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..functions import genotype as G


def truth_labels(truth: DataFrame, span: int = 2) -> DataFrame:
    """contig, pos, cls, key, label (a struct of gt): what the truth says on an allele at a candidate position.

    A truth record at vpos speaks for candidates at vpos and the ``span`` - 1 positions before it.  Of several that match, the
    last counts: the later position, then record, then ALT, then deleted base.  Partial aggregates run before the shuffle.
    """
    spread = truth.withColumn("pos", F.explode(F.sequence(F.col("vpos") - (span - 1), F.col("vpos"))))
    last = F.max_by(F.struct("gt"), F.struct("vpos", "rec_ord", "alt_idx", "i"))
    return spread.groupBy("pos", "cls", F.col("valt").alias("key"), "contig").agg(last.alias("label")).select("contig", "pos", "cls", "key", "label")


def label_alleles(alleles: DataFrame, truth: DataFrame, config: PileupConfig = PileupConfig()) -> DataFrame:
    """``alleles`` with gt: 0 without a matching truth record, else that record's code, null included.

    Candidate insertions have no anchor base, truth insertions do; the reference base is put before the former.
    """
    if config.label_match == "none":
        return alleles.withColumn("gt", F.lit(G.HOM))
    key = F.when(F.col("cls") == G.INSERTION, F.concat("ref_base", "allele")).otherwise(F.col("allele"))
    joined = alleles.withColumn("key", key).join(truth_labels(truth, config.label_span), ["pos", "cls", "key", "contig"], "left")  # rows are sorted by these columns, numbers first
    return joined.select(*alleles.columns, "label").withColumn("gt", F.when(F.col("label").isNull(), G.HOM).otherwise(F.col("label.gt")).cast("int")).drop("label")


def labelled_rows(labelled: DataFrame) -> DataFrame:
    """contig, start, stop, ref, allele, gt: the six output columns, one row per allele."""
    return labelled.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), F.col("ref_base").alias("ref"), "allele", "gt")


def supported_positions(labelled: DataFrame) -> DataFrame:
    """contig, pos, supported, in_supported, snp_supported, n_genotypes: whether any allele has a genotype other than 0."""
    other = ~F.col("gt").eqNullSafe(F.lit(G.HOM))
    has = lambda cls: F.coalesce(F.bool_or(other & (F.col("cls") == cls)), F.lit(False))
    return labelled.groupBy("contig", "pos").agg(
        F.bool_or(other).alias("supported"), has(G.INSERTION).alias("in_supported"), has(G.SNP_OR_DELETION).alias("snp_supported"), F.count_distinct("gt").alias("n_genotypes")
    )
