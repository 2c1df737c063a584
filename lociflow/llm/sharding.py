"""Contiguous, byte-balanced shards from global prefix sums (DataFrame functions only).

Rows are range-partitioned by key.  One sum per partition and its exclusive prefix give each partition's
offset; a window inside the partition adds the rest.  The byte axis is cut at equal targets, and a row
belongs to the shard that holds its midpoint, so that a cut is off by half a row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, cut, ordered, pick, range_of


ORDER = ("key", "crc", "tie")


def _measured(text) -> dict:
    """size, crc and tie of a row; the last is its number as read."""
    filled = F.coalesce(text, F.lit(""))
    return {"size": (F.octet_length(filled) + 1).cast("long"), "crc": F.crc32(filled), "tie": F.monotonically_increasing_id()}


def assign_shards(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot (gapless from 0 in each shard), in key order.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty.  Null keys come first.  Rows with
    equal keys follow each other by checksum, then as read; the row number also splits a key that holds a
    large part of the table over several partitions.  An empty table gives no rows; other columns are ignored.
    """
    placed, firsts = _placed(df, n_shards, key, text)
    return placed.join(F.broadcast(firsts.select("shard", "first")), "shard").select(  # n_shards rows
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") - F.col("first")).alias("slot")
    )


def _placed(df: DataFrame, n_shards: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its shard and its place among all, and the first row of each shard."""
    rows = pick(df, key, text).toDF("key", "text").withColumns(_measured(F.col("text"))).select(*ORDER, "size")
    rows = rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    rows = cut(rows)  # ranges come from a sample: every use must see the same ones

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        rows.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(all_parts).alias("total"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*ORDER)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = (
        rows.join(F.broadcast(offsets), "part")  # as many rows as partitions
        .withColumn("start", start)
        .withColumn("nth", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(2 * start + size) * {n_shards} div (2 * total)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"), F.min(F.struct(*ORDER)).alias("row"))
    return placed, firsts


def write_shards(df: DataFrame, path: str, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> None:
    """Write every row of ``df``, all columns, to the folder of its shard in assign_shards().

    A row's shard follows from the first rows of the shards, so nothing is joined and null or repeated keys are as
    good as others; of rows that repeat in full, some may move over the border between two shards.
    Null texts are written as they are, columns that repeat a name aren't possible in Parquet and fail, and an empty table writes no rows.
    """
    firsts = _placed(df, n_shards, key, text)[1].orderBy("shard").collect()  # n_shards rows
    bounds = ordered([tuple(r["row"]) for r in firsts[1:]])
    numbers = [r["shard"] for r in firsts] or [0]
    at = [df.columns.index(c) for c in (key, text)]
    rows = by_place(df).withColumn("key", F.col(f"_c{at[0]}")).withColumns(_measured(F.col(f"_c{at[1]}")))
    rows = rows.withColumn("shard", F.get(F.array(*map(F.lit, numbers)), range_of(bounds, list(ORDER)))).drop(*ORDER, "size")
    rows.toDF(*df.columns, "shard").write.partitionBy("shard").parquet(path)
