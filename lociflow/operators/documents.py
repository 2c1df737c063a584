"""JSON documents of the candidates of a region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region_documents(alleles: DataFrame, regions: DataFrame, pretty: bool = False) -> DataFrame:
    """contig, start, stop, document: all candidates of each region as one JSON text with sorted keys.

    ``regions`` has contig, start and an inclusive stop.  A region is matched in bins of the width it has at most; one without
    candidates gives an empty list.
    """
    width = 16_384
    spans = regions.select("contig", F.col("start").alias("s"), F.col("stop").alias("t"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("bin"))
    rows = alleles.withColumn("bin", F.floor(F.col("pos") / width))
    inside = spans.join(rows, ["contig", "bin"]).where("pos between s and t")
    one = F.struct("pos", "cls", "rnk", F.struct("allele", "cls", "freq", "pos", "ref_base").alias("shown"))
    listed = inside.groupBy("contig", "s", "t").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["shown"]).alias("all_candidates"))
    whole = regions.select("contig", F.col("start").alias("s"), F.col("stop").alias("t")).join(listed, ["contig", "s", "t"], "left")
    none = F.array().cast(listed.schema["all_candidates"].dataType)
    body = F.struct(F.coalesce("all_candidates", none).alias("all_candidates"), F.col("contig").alias("chromosome_name"), F.col("t").alias("end_position"), F.col("s").alias("start_position"))
    return whole.select("contig", F.col("s").alias("start"), F.col("t").alias("stop"), F.to_json(body, {"pretty": str(pretty).lower()}).alias("document"))
