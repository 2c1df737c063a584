"""Aligned reads: filters, order, and CIGAR operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import cigar as C


def with_end(reads: DataFrame) -> DataFrame:
    """Adds ref_end, the position after the last aligned one."""
    return reads.withColumn("ref_end", C.reference_end("ref_start", "cigar"))


def in_region(reads: DataFrame, contig: str, start: int, stop: int, max_span: int | None = None) -> DataFrame:
    """Reads that overlap [start, stop); contig and ref_start are pushed to the scan.  No flag is filtered.

    ``max_span``: how many positions a read spans at most, if that is known; the scan then starts near the region.
    """
    near = reads.where((F.col("contig") == contig) & (F.col("ref_start") < stop))
    if max_span is not None:
        near = near.where(F.col("ref_start") > start - max_span)
    return with_end(near).where(F.col("ref_end") > start)


def well_mapped(reads: DataFrame, min_mapq: int = 5) -> DataFrame:
    """Reads with a mapping quality above the limit."""
    return reads.where(F.col("mapq") > min_mapq)


def is_valid():
    """Whether a read can be walked: known CIGAR operations only, as many bases as they use, and a start."""
    used = C.total_length(C.parse_cigar("cigar"), C.ON_READ)
    return C.is_valid_cigar("cigar") & F.coalesce((used == F.length("seq")) & (F.col("ref_start") >= 0), F.lit(False))


def valid_reads(reads: DataFrame, invalid: str = "quarantine") -> DataFrame:
    """Reads that can be walked; others are left out, or fail the job with ``invalid="raise"``."""
    if invalid == "raise":
        return reads.where(F.when(is_valid(), True).otherwise(F.raise_error(F.concat(F.lit("read can't be walked: "), F.coalesce("read_name", F.lit("?"))))))
    return reads.where(is_valid())


def invalid_reads(reads: DataFrame) -> DataFrame:
    """The reads that valid_reads() leaves out."""
    return reads.where(~is_valid())


#: Why a read is set aside, the first that holds.
READ_REASONS = ("no start", "no CIGAR", "unknown operation", "bases that don't fit")


def read_reason() -> Column:
    """Which of READ_REASONS sets a read aside; null if none does."""
    reason = (
        F.when(F.coalesce(F.col("ref_start") < 0, F.lit(True)), READ_REASONS[0])
        .when(F.coalesce(F.col("cigar").isin("*", ""), F.lit(True)), READ_REASONS[1])
        .when(~C.is_valid_cigar("cigar"), READ_REASONS[2])
    )
    return reason.when(~is_valid(), READ_REASONS[3])


def watched(rows: DataFrame, reasons: Sequence[str], reason: Column) -> tuple[DataFrame, Observation]:
    """The rows without a reason, and an observation of how many rows there are (``rows``) and how many each reason set aside.

    The counts come with whatever job reads the rows; nothing is read for them alone.
    """
    seen = Observation()
    counted = rows.withColumn("_reason", reason).observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col("_reason") == r, 1)).alias(r) for r in reasons])
    return counted.where("_reason is null").drop("_reason"), seen


def number_in_order(rows: DataFrame, position: str, ties: Sequence[str], name: str, bin_width: int = 65_536, per_contig: bool = False) -> DataFrame:
    """Adds ``name``, counting from 1 in the order of (contig, position, *ties), which must be unique; ``per_contig`` counts each contig anew.

    Rows are dealt by (contig, bin of position) and numbered inside each bin; the bins' row counts, one row per
    bin of the genome, give where each starts.  No task sees the whole table.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(position) / bin_width))
    counts = binned.groupBy("contig", "_bin").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("contig").orderBy("_bin") if per_contig else Window.orderBy("contig", "_bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("contig", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("contig", "_bin").orderBy(position, *ties)
    return binned.join(starts, ["contig", "_bin"]).withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long")).drop("_bin", "_before")


def cigar_ops(reads: DataFrame, *keep: str) -> DataFrame:
    """One row per CIGAR operation: read_ord, op_idx, op, n, rp, qp, bases, and the columns to keep.

    ``rp`` is the offset from the alignment start, ``qp`` the offset into the read, ``bases`` what M and I have of
    the read, so that later rows don't carry the read itself; with a column ``qual`` also ``quals``, their qualities.
    """
    own = {"bases": "seq"} | ({"quals": "qual"} if "qual" in reads.columns else {})
    part = lambda x, c: F.when(x["op"].isin("M", "I"), F.substring(F.col(c), (x["qp"] + 1).cast("int"), x["n"]))
    cut = lambda x: F.struct(*[x[c].alias(c) for c in ("op", "n", "rp", "qp")], *[part(x, c).alias(name) for name, c in own.items()])
    ops = F.transform(C.with_offsets(C.parse_cigar("cigar")), cut)
    return reads.select("read_ord", *keep, F.posexplode(ops).alias("op_idx", "o")).select("read_ord", *keep, "op_idx", *[f"o.{c}" for c in ("op", "n", "rp", "qp", *own)])


def by_flags(reads: DataFrame, exclude: int = 0, require: int = 0) -> DataFrame:
    """Reads with none of the excluded flag bits and all of the required ones; a null flag is 0."""
    flag = F.coalesce(F.col("flag"), F.lit(0))
    return reads.where((flag.bitwiseAND(F.lit(exclude)) == 0) & (flag.bitwiseAND(F.lit(require)) == require))
