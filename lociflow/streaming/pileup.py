"""Pile-up counts that grow as alignment files land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import PileupConfig
from ..operators import pileup as P
from ..schemas import READS


def read_arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the reads in Parquet files as they come into a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def pileup_stream(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig()) -> DataFrame:
    """Counts by position over all reads so far; the reference is a static side of the join."""
    return P.pileup(P.events(reads, reference, block_size, config))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a pileup_stream() until the files that are there now are used up; ``path``/batch=N has the positions that batch N changed, with their new counts."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every position after the last batch that changed it."""
    every = spark.read.parquet(path)
    columns = [c for c in every.columns if c not in ("contig", "pos", "batch")]
    last = every.groupBy("contig", "pos").agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select("contig", "pos", "x.*")
