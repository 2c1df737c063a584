"""SAM, FASTA, VCF and BED text files, read with Spark's own readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BED
from .bgzf import open_path

#: Bits of a line's place in its task; above them is the number of the split that the line is in.
_PLACE_BITS = 33


def in_name_order(names: list[str]) -> list[str]:
    """Names in their order, digits in them as numbers, so that part-10 comes after part-9."""
    return sorted(names, key=lambda name: [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", name)])


def _bytes(text: str) -> int:
    """A size as sessions state it, such as 128MB or 4194304b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1].lower()]


def read_lines(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """value, file, line_ord: every line, with a number that grows along the files in the order of their names.  ``whole``: only \\n ends a line, a \\r before it stays.

    The number of a line's split comes before the line's place in the task that reads it.  Splits are numbered over all files, from the listing: a file has
    as many as its bytes hold of the smallest split that the session can make, and one at least.  No shuffle and no single task orders the lines;
    the files' names and sizes, which Spark lists on the driver too, are looked up by a join, unless there is one file.  Fails where 30 bits are too
    few for the splits, which some thousands of TB would need.
    """
    unit = max(1, min(_bytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes")))
    lines = spark.read.text(path, lineSep="\n" if whole else None).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    listed = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size").collect()  # contents aren't read
    sizes = {r["file_path"]: r["file_size"] for r in listed}
    before, rows = 0, []
    for name in in_name_order(list(sizes)):
        rows.append((name, before))
        before += sizes[name] // unit + 1
    if before >= 1 << 63 - _PLACE_BITS:
        raise ValueError(f"{path}: {before} splits of {unit} bytes are too many to number; raise spark.sql.files.openCostInBytes")
    if len(rows) > 1:
        lines = lines.join(F.broadcast(spark.createDataFrame(rows, "file string, _before long")), "file")
    else:
        lines = lines.withColumn("_before", F.lit(0).cast("long"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    split = F.col("_before") + F.floor(F.col("_start") / unit)
    return lines.withColumn("_place", place).select("value", "file", (F.shiftleft(split, _PLACE_BITS) + F.col("_place")).alias("line_ord"))


def read_sam(spark: SparkSession, path: str | list[str], qualities: bool = False) -> DataFrame:
    """The reads of SAM files (compressed or not) as READS, in the order of the files' names; header lines are left out, ``*`` as contig is null.

    ``qualities`` adds qual, the bases' qualities as the file writes them, null for ``*``.
    """
    fields = F.split("value", "\t", 12)
    field = lambda i: F.get(fields, F.lit(i))
    rows = read_lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return rows.select(
        F.col("line_ord").alias("read_ord"), field(0).alias("read_name"), F.nullif(field(2), F.lit("*")).alias("contig"), (field(3).cast("int") - 1).alias("ref_start"),
        field(4).cast("int").alias("mapq"), field(1).cast("int").alias("flag"), field(5).alias("cigar"), field(9).alias("seq"),
        *([F.nullif(field(10), F.lit("*")).alias("qual")] if qualities else []),
    )


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """rec_ord, contig, pos, ref, alt, qual, filter, gt (text of the first sample) of VCF files, for parse_records(); rec_ord grows over files in the order of their names."""
    fields = F.split("value", "\t")
    field = lambda i: F.get(fields, F.lit(i))
    keys = F.split(field(8), ":")
    genotype = F.get(F.split(field(9), ":"), F.array_position(keys, F.lit("GT")).cast("int") - 1)
    rows = read_lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(
        F.col("line_ord").alias("rec_ord"), field(0).alias("contig"), field(1).cast("int").alias("pos"), field(3).alias("ref"), field(4).alias("alt"),
        field(5).try_cast("double").alias("qual"), field(6).alias("filter"), genotype.alias("gt"),
    )


def variants_in_region(variants: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """Records whose reference bases overlap the half-open region [start, stop) of 0-based positions."""
    return variants.where((F.col("contig") == contig) & (F.col("pos") - 1 < stop) & (F.col("pos") - 1 + F.length("ref") > start))


def read_bed(spark: SparkSession, path: str, schema: str = BED) -> DataFrame:
    """Tab-separated intervals without a header."""
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="", enforceSchema=True)


def read_fasta(spark: SparkSession, path: str, block_size: int = 65_536) -> DataFrame:
    """contig, block, seq (upper case): a FASTA file in blocks of a fixed number of bases.

    Each split sums up its lines since its last header; a prefix over the splits (a row each) says which contig,
    and how many bases of it, come before a split.  Lines are then placed inside their splits and put into blocks.
    """
    lines = read_lines(spark, path).where("value <> ''").withColumn("split", F.shiftright("line_ord", _PLACE_BITS))
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))
    rows = lines.withColumn("name", name).withColumn("bases", F.when(F.col("name").isNull(), F.upper(F.trim("value"))))
    inside = Window.partitionBy("file", "split").orderBy("line_ord")
    rows = (
        rows.withColumn("part", F.count("name").over(inside))
        .withColumn("contig", F.last("name", ignorenulls=True).over(inside))
        .withColumn("before", F.coalesce(F.sum(F.length("bases")).over(Window.partitionBy("file", "split", "part").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    # per split: its last header, the bases after it (all, if it has none)
    ends = rows.groupBy("file", "split").agg(F.max_by("contig", "line_ord").alias("last"), F.max("part").alias("parts"), F.max_by(F.col("before") + F.coalesce(F.length("bases"), F.lit(0)), "line_ord").alias("bases_after"))
    along = Window.partitionBy("file").orderBy("split")
    ends = ends.withColumn("era", F.sum((F.col("parts") > 0).cast("int")).over(along))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "file", "split", F.last("last", ignorenulls=True).over(earlier).alias("carried"),
        "era", "bases_after",
    )
    sums = carried.withColumn("through", F.sum("bases_after").over(Window.partitionBy("file", "era").orderBy("split")))
    offsets = sums.withColumn("offset", F.coalesce(F.lag("through").over(along), F.lit(0))).select("file", "split", "carried", "offset")
    placed = rows.where("bases is not null").join(offsets, ["file", "split"]).select(
        F.coalesce("contig", "carried").alias("contig"), (F.col("before") + F.when(F.col("part") == 0, F.col("offset")).otherwise(0)).cast("long").alias("at"), "bases")
    pieces = placed.where("bases <> ''").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_size), F.floor((F.col("at") + F.length("bases") - 1) / block_size))))
    first = F.greatest(F.col("at"), F.col("block") * block_size)
    stop = F.least(F.col("at") + F.length("bases"), (F.col("block") + 1) * block_size)
    cut = pieces.select("contig", F.col("block").cast("int").alias("block"), F.struct(first.alias("at"), F.substring("bases", (first - F.col("at") + 1).cast("int"), (stop - first).cast("int")).alias("piece")).alias("x"))
    return cut.groupBy("contig", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("seq"))


def fasta_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, name, length, offset, line_bases, line_bytes, broken: the rows of a ``.fai`` index for each contig of FASTA files.

    Bytes and lines are summed inside each split, and a prefix over the splits, a row each, places them in their file.  A contig's lines are then
    one sum, too: its bases, its first line's widths, and in how many lines other than the last the widths differ (``broken``, which an index can't express).
    """
    lines = read_lines(spark, path, whole=True).select("file", "line_ord", F.shiftright("line_ord", _PLACE_BITS).alias("split"), F.octet_length("value").alias("bytes"),
        F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1)).alias("name"), F.length(F.rtrim("value", F.lit("\r"))).alias("bases"))
    inside = Window.partitionBy("file", "split").orderBy("line_ord")
    sizes = lines.groupBy("file", "split").agg(F.sum(F.col("bytes") + 1).alias("size"), F.count("name").alias("headers"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "split", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("headers").over(earlier), F.lit(0)).alias("headers_before"))
    at = lines.withColumn("end", F.sum(F.col("bytes") + 1).over(inside)).withColumn("nth", F.count("name").over(inside)).join(before, ["file", "split"])
    placed = at.select("file", "line_ord", "name", "bytes", "bases", (F.col("bytes_before") + F.col("end")).alias("end"), (F.col("headers_before") + F.col("nth")).alias("contig")).where("contig > 0")
    line = F.col("name").isNull() & (F.col("bases") > 0)
    width = F.when(line, F.struct("line_ord", "bases", (F.col("bytes") + 1).alias("bytes")))
    per = placed.groupBy("file", "contig").agg(
        F.max("name").alias("name"), F.coalesce(F.sum(F.when(line, F.col("bases"))), F.lit(0)).alias("length"), F.max(F.when(F.col("name").isNotNull(), F.col("end"))).alias("offset"), F.min(width).alias("first"),
        F.count(F.when(line, 1)).alias("lines"), F.max(width).alias("last"),
    )
    even = placed.where(line).join(per.select("file", "contig", "first", "last"), ["file", "contig"]).where((F.col("line_ord") < F.col("last.line_ord")) & ((F.col("bases") != F.col("first.bases")) | (F.col("bytes") + 1 != F.col("first.bytes"))) | (F.col("bases") > F.col("first.bases")))
    odd = even.groupBy("file", "contig").agg(F.count("*").alias("broken"))
    return per.join(odd, ["file", "contig"], "left").select("file", "contig", "name", "length", "offset", F.coalesce("first.bases", F.lit(0)).alias("line_bases"), F.coalesce("first.bytes", F.lit(0)).cast("int").alias("line_bytes"), F.coalesce("broken", F.lit(0)).alias("broken"))


def write_fasta_index(spark: SparkSession, path: str | list[str]) -> None:
    """Puts a ``.fai`` beside each FASTA file.  Fails if lines of a contig differ in width.  The contigs' rows reach the driver one part at a time."""
    rows = fasta_index(spark, path)
    out, now = None, None
    try:
        for r in rows.orderBy("file", "contig").toLocalIterator():
            if r["broken"]:
                raise ValueError(f"{r['file']}: lines of {r['name']} differ in width")
            if r["file"] != now:
                if out:
                    out.close()
                now = r["file"]
                system, where = open_path(now + ".fai")
                out = system.open_output_stream(where)
            out.write("\t".join(str(r[c]) for c in ("name", "length", "offset", "line_bases", "line_bytes")).encode() + b"\n")
    finally:
        if out:
            out.close()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the regular files of a folder, not of its subfolders; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def render_sam(reads: DataFrame) -> DataFrame:
    """value: one SAM line per read; unknown fields get their defaults."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    flag = F.coalesce(F.col("flag").cast("string"), F.lit("0")) if "flag" in reads.columns else F.lit("0")
    return reads.select(F.concat_ws("\t", text("read_name"), flag, text("contig"), (F.col("ref_start") + 1).cast("string"), F.col("mapq").cast("string"), text("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), text("seq"), text("qual") if "qual" in reads.columns else F.lit("*")).alias("value"))


def render_vcf(raw: DataFrame) -> DataFrame:
    """value: one VCF line per record of read_vcf()'s columns (without rec_ord)."""
    qual = F.coalesce(F.col("qual").cast("string"), F.lit(".")) if "qual" in raw.columns else F.lit(".")
    return raw.select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", qual, "filter", F.lit("."), F.lit("GT"), "gt").alias("value"))
