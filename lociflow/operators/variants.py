"""Truth variants: records, their decomposition to single positions, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..functions import genotype as G


def parse_records(raw: DataFrame) -> DataFrame:
    """rec_ord, contig, pos (1-based), ref, alts, gt, filter, qual from text columns alt, gt, filter and qual.

    Of several filters the first counts.  No ALT gives ['.'], no or zero quality gives 10.
    """
    alts = F.split(F.coalesce(F.nullif("alt", F.lit("")), F.lit(".")), ",")
    qual = F.coalesce(F.nullif(F.col("qual"), F.lit(0.0)), F.lit(10.0)) if "qual" in raw.columns else F.lit(10.0)
    return raw.select("rec_ord", "contig", "pos", "ref", alts.alias("alts"), G.parse_genotype("gt").alias("gt"), F.get(F.split("filter", ";"), F.lit(0)).alias("filter"), qual.alias("qual"))


def passing(records: DataFrame, hom_filter: bool = True) -> DataFrame:
    """Records whose filter is PASS, and with ``hom_filter`` only those that have a variant genotype."""
    kept = records.where(F.col("filter") == G.PASS)
    return kept.where(G.is_called(F.col("gt"), F.col("filter"))) if hom_filter else kept


def _classified(records: DataFrame, config: PileupConfig) -> DataFrame:
    """A row per ALT allele with vref, kind and code."""
    rows = records.select("rec_ord", "contig", "pos", "ref", "alts", "gt", "filter", F.posexplode("alts").alias("alt_idx", "alt"))
    if config.ref_mutation:
        inserted = F.exists(F.slice("alts", F.lit(1), F.col("alt_idx")), lambda a: F.length(a) > F.length("ref"))
        rows = rows.withColumn("vref", F.when((F.col("alt_idx") > 0) & (F.length("ref") > 1) & inserted, F.left("ref", F.lit(1))).otherwise(F.col("ref")))
    else:
        rows = rows.withColumn("vref", F.col("ref"))
    return rows.withColumn("kind", G.variant_class(F.col("vref"), F.col("alt"))).withColumn("code", G.genotype_code(F.col("gt")))


def alleles(records: DataFrame, config: PileupConfig = PileupConfig()) -> DataFrame:
    """One row per ALT allele: the record's key, alt_idx, vref, alt, kind (SNP, IN, DEL) and code.

    With ``ref_mutation`` an insertion on several reference bases leaves only the first for the ALT alleles after it.
    Equal lengths over 1 and genotypes of three alleles or more have no meaning and are quarantined or raise.
    """
    rows = _classified(records, config)
    valid = F.col("kind").isNotNull() & F.size("gt").isin(1, 2)
    if config.invalid == "raise":
        valid = F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("record has no class: "), F.col("rec_ord").cast("string"))))
    return rows.where(valid).select("rec_ord", "contig", "pos", "alt_idx", "vref", "alt", "kind", "code")


#: Why an ALT allele gives no truth row, the first that holds.
RECORD_REASONS = ("filter", "not called", "genotype of many alleles", "no class")


def record_reasons(records: DataFrame, hom_filter: bool = True, config: PileupConfig = PileupConfig()) -> DataFrame:
    """rec_ord, contig, pos, alt_idx, alt, reason: every ALT allele, and which of RECORD_REASONS keeps it out of decompose(); null if none does."""
    called = G.is_called(F.col("gt"), F.col("filter")) if hom_filter else F.lit(True)
    reason = (
        F.when(F.coalesce(F.col("filter") != G.PASS, F.lit(True)), RECORD_REASONS[0])
        .when(~F.coalesce(called, F.lit(False)), RECORD_REASONS[1])
        .when(~F.coalesce(F.size("gt").isin(1, 2), F.lit(False)), RECORD_REASONS[2])
        .when(F.col("kind").isNull(), RECORD_REASONS[3])
    )
    return _classified(records, config).select("rec_ord", "contig", "pos", "alt_idx", "alt", reason.alias("reason"))


def decompose(records: DataFrame, hom_filter: bool = True, config: PileupConfig = PileupConfig()) -> DataFrame:
    """contig, vpos (0-based), cls, vref, valt, gt, rec_ord, alt_idx, i: one row per position that a variant changes.

    A deletion gives a row for each deleted base; an insertion is trimmed to the base before it.
    """
    rows = alleles(passing(records, hom_filter), config)
    one = lambda at, vref, valt, i: F.struct(at.cast("int").alias("vpos"), vref.alias("vref"), valt.alias("valt"), i.cast("int").alias("i"))
    here, none = F.col("pos") - 1, F.lit(0)
    extra = F.length("alt") - F.length("vref")
    deleted = F.transform(F.sequence(F.length("alt"), F.greatest(F.length("vref") - 1, F.length("alt"))), lambda i: one(F.col("pos") + i - 1, F.substring("vref", i + 1, F.lit(1)), F.lit(G.DELETED), i))
    parts = (
        F.when(F.col("kind") == "DEL", deleted)
        .when((F.col("kind") == "IN") & (F.length("vref") > 1), F.array(one(here, F.left("vref", F.lit(1)), F.left("alt", extra + 1), none)))
        .otherwise(F.array(one(here, F.col("vref"), F.col("alt"), none)))
    )
    cls = F.when(F.col("kind") == "IN", G.INSERTION).otherwise(G.SNP_OR_DELETION)
    return rows.select("contig", cls.alias("cls"), F.col("code").alias("gt"), "rec_ord", "alt_idx", F.inline(parts)).select("contig", "vpos", "cls", "vref", "valt", "gt", "rec_ord", "alt_idx", "i")


def genotype_counts(records: DataFrame, hom_filter: bool = True, config: PileupConfig = PileupConfig()) -> DataFrame:
    """hom, het, hom_alt over ALT alleles; what is neither of the first two counts as hom_alt."""
    code = F.col("code")
    return alleles(passing(records, hom_filter), config).agg(
        F.count_if(code == G.HOM).alias("hom"), F.count_if(code == G.HET).alias("het"), F.count_if(code.isNull() | (code == G.HOM_ALT)).alias("hom_alt")
    )


def position_index(truth: DataFrame) -> DataFrame:
    """contig, vpos, cls, entries: the decomposed records of each position and class, in record order."""
    entry = F.struct("rec_ord", "alt_idx", "i", "vref", "valt", "gt")
    return truth.groupBy("contig", "vpos", "cls").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def record_text(records: DataFrame) -> DataFrame:
    """rec_ord, line: pos, qual, genotype, filter, whether called, alleles and ALTs, separated by tabs."""
    called = G.is_called(F.col("gt"), F.col("filter"))
    shown = F.array_join(F.transform("gt", lambda g: F.coalesce(g.cast("string"), F.lit("."))), "/")
    parts = [F.col("pos").cast("string"), F.col("qual").cast("int").cast("string"), shown, F.col("filter"), called.cast("string"), F.concat_ws(",", F.col("ref"), F.array_join("alts", ",")), F.array_join("alts", ",")]
    return records.select("rec_ord", F.concat_ws("\t", *parts).alias("line"))
