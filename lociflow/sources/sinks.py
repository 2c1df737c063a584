"""Writers: labelled rows as BED, region documents as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bed(labelled: DataFrame, path: str) -> None:
    """Tab-separated rows without a header, in a folder per contig, sorted by start inside each file.

    Rows are ranged by contig and start, so that a large contig is written by many tasks; Spark's commit protocol leaves no
    temporary files to merge or to delete.
    """
    ranged = labelled.repartitionByRange("contig", "start").sortWithinPartitions("contig", "start", "ref", "allele")
    ranged.withColumn("chrom", F.col("contig")).write.partitionBy("chrom").csv(path, sep="\t", header=False, quote="")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select("document").write.text(path)


def read_documents(spark, path: str) -> DataFrame:
    """chromosome_name, start_position, end_position, all_candidates of documents written before."""
    candidate = "struct<allele:string,cls:int,freq:bigint,pos:int,ref_base:string>"
    return spark.read.schema(f"all_candidates array<{candidate}>, chromosome_name string, end_position int, start_position int").json(path)
