"""From reads, reference and truth to candidate alleles and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..operators import intervals, labels, pileup, reads, variants
from ..operators.pieces import packed_pieces
from ..session import cut


def _said(read_rows: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """What candidates need of the reads: their pieces, packed by bin and run; limits on totals need a row per mismatch and stretch."""
    return (pileup.sparse_events if config.threshold == "final" else packed_pieces)(read_rows, reference, block_size, config, keep)


def find_candidates(read_rows: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig()) -> DataFrame:
    """Candidate alleles over all contigs at once: chunks are left to Spark's partitioning, and no position counts twice."""
    return pileup.candidate_alleles(_said(read_rows, reference, block_size, config), config)


def find_positions(read_rows: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig()) -> DataFrame:
    """Distinct candidate positions over all contigs at once."""
    return pileup.candidate_positions(_said(read_rows, reference, block_size, config), config)


def find_candidates_by_chunk(read_rows: DataFrame, reference: DataFrame, block_size: int, chunk_rows: DataFrame, config: PileupConfig = PileupConfig()) -> DataFrame:
    """Candidate alleles of each chunk for itself, with chunk_id; positions in the overlap of two chunks come out of both.

    A chunk has the reads that overlap [start, stop) and reports positions from start to stop, both included.  Reads and chunks meet in bins about as wide
    as the longest chunk, so that a read is compared with few chunks that it doesn't overlap.
    """
    longest = chunk_rows.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 1
    in_chunks = intervals.assign_chunks(reads.with_end(reads.well_mapped(read_rows, config.min_mapq)), chunk_rows, width=max(64, 1 << (longest - 1).bit_length()))
    found = _said(in_chunks, reference, block_size, config, ("chunk_id", "chunk_start", "chunk_stop"))
    inside = pileup.clip(found, F.col("chunk_start"), F.col("chunk_stop")).drop("chunk_start", "chunk_stop")
    return pileup.candidate_alleles(inside, config, by=("chunk_id", "contig", "pos"))


def label_candidates(read_rows: DataFrame, reference: DataFrame, records: DataFrame, block_size: int, config: PileupConfig = PileupConfig()) -> DataFrame:
    """Candidate alleles with the genotype that the truth records give them: contig, pos, ref_base, cls, allele, freq, rnk, gt."""
    found = find_candidates(read_rows, reference, block_size, config)
    if config.label_match != "none":
        records = cut(records)  # else each filter and expansion of the truth derives the records' columns again
    return labels.label_alleles(found, variants.decompose(records, config=config), config)


def label_region(read_rows: DataFrame, reference: DataFrame, records: DataFrame, block_size: int, contig: str, start: int, stop: int, config: PileupConfig = PileupConfig(), max_span: int | None = None) -> DataFrame:
    """The six output columns for the candidates of one region, positions start to stop, both included; ``max_span`` as in_region() has it."""
    near = reads.in_region(read_rows, contig, start, stop, max_span)
    found = pileup.clip(_said(near, reference.where(F.col("contig") == contig), block_size, config), F.lit(start), F.lit(stop))
    truth = variants.decompose(records.where(F.col("contig") == contig), config=config)
    return labels.labelled_rows(labels.label_alleles(pileup.candidate_alleles(found, config), truth, config))
