"""Intervals: chunks of a contig, overlap joins, intersection, and windows merged from positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BED
from .reads import number_in_order


def contig_lengths(reference: DataFrame, block_size: int) -> DataFrame:
    """contig, length of a blocked reference."""
    return reference.groupBy("contig").agg(F.max(F.col("block").cast("long") * block_size + F.length("seq")).alias("length"))


def chunks(lengths: DataFrame, size: int = 200_000, overlap: int = 10, clamp: bool = True) -> DataFrame:
    """contig, chunk_id, start, stop: chunks of a fixed size, each reaching ``overlap`` into the next."""
    count = F.ceil(F.col("length") / size)
    rows = lengths.where("length > 0").withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    stop = (F.col("chunk_id") + 1) * size + overlap
    return rows.select("contig", F.col("chunk_id").cast("int").alias("chunk_id"), (F.col("chunk_id") * size).cast("int").alias("start"), (F.least(stop, "length") if clamp else stop).cast("int").alias("stop"))


def equal_chunks(lengths: DataFrame, n: int, overlap: int = 1000) -> DataFrame:
    """contig, chunk_id, start, stop: ``n`` chunks per contig of ceil(length / n), whose ends aren't clamped."""
    size = F.ceil(F.col("length") / n)
    rows = lengths.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("contig", "chunk_id", (F.col("chunk_id") * size).cast("int").alias("start"), ((F.col("chunk_id") + 1) * size + overlap).cast("int").alias("stop"))


#: Levels of bins, each eight times as wide as the one before; the widest of the default width hold any contig.
LEVELS = 8


def _level(width: int) -> Column:
    """The first level whose bins are as wide as the interval is long; it touches two of them at most."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(F.col("stop").cast("long") - F.col("start") <= width << 3 * k, k).otherwise(out)
    return out.cast("int")


def _places(width: int, levels: Column) -> Column:
    """(level, bin) of the bins that an interval touches, for these levels."""
    wide = lambda k: F.call_function("shiftleft", F.lit(width).cast("long"), 3 * k)
    touched = lambda k: F.transform(F.sequence(F.floor(F.col("start") / wide(k)), F.floor((F.col("stop") - 1) / wide(k))), lambda b: F.struct(k.alias("level"), b.alias("bin")))
    return F.flatten(F.transform(levels, touched))


def _levels(df: DataFrame, width: int) -> list[int]:
    """The levels that a table's intervals have, LEVELS rows at most."""
    return sorted(r[0] for r in df.where("stop > start").select(_level(width)).distinct().collect())


def overlap_join(left: DataFrame, right: DataFrame, width: int = 16_384, left_levels: list[int] | None = None) -> DataFrame:
    """Pairs of rows on the same contig whose half-open (start, stop) overlap, as structs ``l`` and ``r``.

    An interval's level is that whose bins are as wide as it is long.  A pair meets at the higher of its two levels, where each touches two bins at most,
    however long it is, so the join is on equal keys.  Rows of ``left`` are put on their own level and on the higher ones that ``right``, which should
    be the smaller side and is read for that first, has; rows of ``right`` on their own and all higher ones, or those of them in ``left_levels``, if it is given.
    A pair that shares two bins is given in the first.  Empty intervals overlap nothing.  Both sides are shuffled: Spark knows only the bytes of the files that
    they come from, and would collect and broadcast a side that grows with the input and has several rows for each of its intervals.
    """

    def binned(df: DataFrame, name: str, levels: Column) -> DataFrame:
        kept = df.where("stop > start").withColumn("_level", _level(width))
        return kept.select(F.struct(*df.columns).alias(name), "contig", F.col("_level").alias(f"{name}_level"), F.explode(_places(width, levels)).alias("_at")).select("*", "_at.level", "_at.bin").drop("_at")

    def own_and(theirs: list[int]) -> Column:
        return F.concat(F.array("_level"), F.filter(F.array(*map(F.lit, theirs)).cast("array<int>"), lambda k: k > F.col("_level")))

    higher = list(range(LEVELS)) if left_levels is None else left_levels
    joined = binned(left, "l", own_and(_levels(right, width))).join(binned(right, "r", own_and(higher)).hint("merge"), ["contig", "level", "bin"])
    first = F.floor(F.greatest("l.start", "r.start") / F.call_function("shiftleft", F.lit(width).cast("long"), 3 * F.col("level")))
    overlap = (F.col("l.start") < F.col("r.stop")) & (F.col("r.start") < F.col("l.stop"))
    return joined.where((F.col("level") == F.greatest("l_level", "r_level")) & overlap & (F.col("bin") == first)).select("l", "r")


def intersect(a: DataFrame, b: DataFrame, width: int = 16_384) -> DataFrame:
    """One row per overlapping pair: the columns of ``a`` with start and stop clipped to the overlap.  Both tables are read once before, for their levels."""
    pairs = overlap_join(a, b, width, _levels(a, width))
    clipped = {"start": F.greatest("l.start", "r.start"), "stop": F.least("l.stop", "r.stop")}
    return pairs.select(*[clipped.get(c, F.col(f"l.{c}")).alias(c) for c in a.columns])


def assign_chunks(reads: DataFrame, chunk_rows: DataFrame, width: int = 16_384) -> DataFrame:
    """Reads (with ref_end) with the chunk_id, chunk_start and chunk_stop of every chunk they overlap."""
    spans = reads.withColumn("start", F.col("ref_start")).withColumn("stop", F.col("ref_end"))
    pairs = overlap_join(spans, chunk_rows, width)
    return pairs.select("l.*", F.col("r.chunk_id").alias("chunk_id"), F.col("r.start").alias("chunk_start"), F.col("r.stop").alias("chunk_stop")).drop("start", "stop")


def merge_windows(positions: DataFrame, distance: int = 0, offset: int = 0, adjacent: bool = True) -> DataFrame:
    """contig, start, stop, n: runs of positions at most ``distance`` apart, widened by ``offset`` on both sides; stop is inclusive.

    ``adjacent``: whether neighbouring positions have distance 0.  Runs are found inside bins of positions first.  Those between a bin's first and last are
    whole and stay alone; only these two, at most, of each bin are then ordered along a contig.  Bins are read once, and only positions are shuffled to them.
    """
    gap = distance + (1 if adjacent else 0)
    bins = positions.select("contig", "pos").distinct().withColumn("_bin", F.floor(F.col("pos") / 65_536))

    def runs(df: DataFrame, keys: list[str], start: str, stop: str, n: Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(start)
        new = F.coalesce(F.col(start) - F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)) > gap, F.lit(True)).cast("int")
        numbered = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
        return numbered.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), n.alias("n")).drop("_run")

    local = runs(bins, ["contig", "_bin"], "pos", "pos", F.count("*"))
    inside = Window.partitionBy("contig", "_bin")
    whole = (F.col("start") != F.min("start").over(inside)) & (F.col("start") != F.max("start").over(inside))
    alone = local.withColumn("_alone", F.when(whole, F.col("start"))).drop("_bin")  # null for all that are ordered along a contig
    merged = runs(alone, ["contig", "_alone"], "start", "stop", F.sum("n"))
    return merged.select("contig", (F.col("start") - offset).alias("start"), (F.col("stop") + offset).alias("stop"), "n")


def numbered(intervals: DataFrame) -> DataFrame:
    """Adds idx, the place of each row in the order of contig, start, stop, counted from 0 on each contig.  No task sees a whole contig."""
    return number_in_order(intervals, "start", ["stop"], "idx", per_contig=True).withColumn("idx", (F.col("idx") - 1).cast("int"))


def from_list(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """Intervals (contig, start, stop) from a list."""
    return spark.createDataFrame(rows, BED)
