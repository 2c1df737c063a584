"""An alignment, a reference and truth variants derived from the standard tables.

Everything follows from the keys of lineitem, part and orders: two contigs of eight bases per part, a read per
line with one substituted base, and a variant per order.  Depth doesn't change with the scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import number_in_order
from ..operators.variants import parse_records
from ..session import ship

BLOCK = 32
CONTIGS = ("chr1", "chr2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contig_length(spark: SparkSession, sf_dir: str) -> int:
    return 8 * table(spark, sf_dir, "part").count()


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, block, seq in blocks of BLOCK bases."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.explode(F.array(*map(F.lit, CONTIGS))).alias("contig"), (F.col("p_partkey") / 4).cast("int").alias("block"))
    digest = F.md5(F.concat("contig", F.lit(":"), F.col("block").cast("string")).cast("binary"))
    return parts.select("contig", "block", F.translate(digest, "0123456789abcdef", "ACGT" * 4).alias("seq"))


#: Positions of a contig up to which the reference, a byte for each, is broadcast.
SMALL_CONTIG = 1 << 24


def _with_bases(rows: DataFrame, ref: DataFrame, at: str, length: int, contig: int) -> DataFrame:
    """Adds t, the ``length`` reference bases from position ``at`` on; ``contig`` is the contigs' length.

    Spark takes the rows for the smaller side where it knows only the bytes of the few columns that they come from, and would broadcast them and
    leave all that follows to one task.
    """
    a, b = ref.select("contig", F.col("block").alias("block_a"), F.col("seq").alias("seq_a")), ref.select("contig", (F.col("block") - 1).alias("block_a"), F.col("seq").alias("seq_b"))
    placed = rows.withColumn("block_a", F.floor(F.col(at) / BLOCK).cast("int"))
    pairs = a.join(b, ["contig", "block_a"])
    return placed.join(F.broadcast(pairs) if contig <= SMALL_CONTIG else pairs.hint("merge"), ["contig", "block_a"]).withColumn("t", F.substring(F.concat("seq_a", "seq_b"), F.col(at) % BLOCK + 1, F.lit(length))).drop("block_a", "seq_a", "seq_b")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_ord, read_name, contig, ref_start, mapq, flag, cigar, seq, one read per line."""
    length = contig_length(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(l_orderkey % 2 + 1 as string)) as contig",
        f"cast((l_partkey * 37 + l_linenumber * 101 + l_suppkey * 13 + l_orderkey * 7) % {length - 64} as int) as ref_start",
        "cast(l_quantity as int) as mapq", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    numbered = number_in_order(lines, "ref_start", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "read_ord", bin_width=4096)
    kinds = numbered.selectExpr("read_ord", "contig", "ref_start", "mapq", "l_orderkey", "l_linenumber", "mapq % 5 as k", "cast(6 + l_linenumber as int) as j", "l_suppkey % 3 as rot")  # only now, so that the numbering doesn't shuffle what follows from its columns
    shaped = _with_bases(kinds, reference(spark, sf_dir), "ref_start", BLOCK, length).selectExpr(
        "*",
        "case k when 0 then '30M' when 1 then '4S10M2I16M' when 2 then '12M3D17M' when 3 then '10M1I5M2N13M' else '2H30M' end as cigar",
        """case k when 1 then concat('NNNN', substr(t, 1, 10), 'GT', substr(t, 11, 16)) when 2 then concat(substr(t, 1, 12), substr(t, 16, 17))
           when 3 then concat(substr(t, 1, 10), 'A', substr(t, 11, 5), substr(t, 18, 13)) else substr(t, 1, 30) end as q""",
    )
    return shaped.selectExpr(
        "read_ord", "concat('r', cast(l_orderkey as string), '_', cast(l_linenumber as string)) as read_name", "contig", "ref_start", "mapq", "0 as flag", "cigar",
        "concat(substr(q, 1, j), translate(substr(q, j + 1, 1), 'ACGT', case rot when 0 then 'CGTA' when 1 then 'GTAC' else 'TACG' end), substr(q, j + 2)) as seq",
    )


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_ord, contig, pos, ref, alt, gt, filter as text, one record per order."""
    length = contig_length(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderpriority", "concat('chr', cast(o_orderkey % 2 + 1 as string)) as contig",
        f"cast((o_orderkey * 11 + o_custkey) % {length - 64} as int) as p0", "o_orderkey % 6 as k",
    )
    placed = _with_bases(number_in_order(rows, "p0", ["o_orderkey"], "rec_ord", bin_width=4096), reference(spark, sf_dir), "p0", 4, length)
    return placed.selectExpr(
        "rec_ord", "contig", "p0 + 1 as pos", "case k when 2 then substr(t, 1, 4) when 4 then substr(t, 1, 2) else substr(t, 1, 1) end as ref",
        """case k when 1 then concat(substr(t, 1, 1), 'GT') when 2 then substr(t, 1, 1)
           when 3 then concat(translate(substr(t, 1, 1), 'ACGT', 'CGTA'), ',', translate(substr(t, 1, 1), 'ACGT', 'GTAC'))
           when 4 then concat(substr(t, 1, 2), 'T,', substr(t, 1, 1)) else translate(substr(t, 1, 1), 'ACGT', 'TACG') end as alt""",
        "case o_custkey % 5 when 0 then '0/1' when 1 then '1/1' when 2 then '0/0' when 3 then './.' else '1' end as gt",
        "case when substr(o_orderpriority, 1, 1) = '1' then 'q10' else 'PASS' end as filter",
    )


#: Rows of a file that a query writes on its way.
FILE_ROWS = 500_000


def n_files(spark: SparkSession, sf_dir: str, source: str, least: int) -> int:
    """How many files the rows that come from a table are written to; the table's metadata has its count."""
    return max(least, -(-table(spark, sf_dir, source).count() // FILE_ROWS))


def in_files(spark: SparkSession, sf_dir: str, rows: DataFrame, order: str, source: str, least: int) -> DataFrame:
    """``rows``, counted by ``order`` from 1 on and one for each of the table ``source``, in n_files() files by that order.

    The count comes from the table's metadata and the files' borders from the count, so that the rows aren't derived once more to sample them.
    """
    total, n = table(spark, sf_dir, source).count(), n_files(spark, sf_dir, source, least)
    file = F.least(F.floor((F.col(order) - 1) * n / max(total, 1)), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, file).sortWithinPartitions(order)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(raw_variants(spark, sf_dir))
