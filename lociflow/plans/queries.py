"""Every operator as a query over the alignment that ``alignment`` derives from the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..functions.genotype import is_supported
from ..operators import documents, intervals, labels, pileup, variants
from ..operators import reads as R
from ..operators.pieces import read_pieces
from ..schemas import LABELLED
from ..session import new_path
from ..sources import bam, fasta, sinks, text, vcf
from ..streaming import pileup as stream_pileup
from ..streaming import sessions
from . import alignment as A
from . import pipelines

CHUNK, OVERLAP = 500, 10


def events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return pileup.events(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK, keep=keep)


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.sparse_events(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pieces(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK)


def region(spark: SparkSession, sf_dir: str) -> tuple[str, int, int]:
    """The middle half of a contig."""
    n = A.contig_length(spark, sf_dir)
    return A.CONTIGS[0], n // 4, 3 * n // 4


def src2_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_region(A.reads(spark, sf_dir), *region(spark, sf_dir), max_span=2 * A.BLOCK).select("read_ord", "read_name", "ref_start", "ref_end")


def src3_pileup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.piece_columns(said(spark, sf_dir))


def src3_filtered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without the reads that are marked as duplicates, without bases of a low quality, and of no more than 20 reads; through a SAM file with qualities."""
    path = new_path(spark, "sam")
    marked = A.reads(spark, sf_dir).withColumn("flag", F.when(F.col("read_ord") % 10 == 0, 0x400).otherwise(0)).withColumn("qual", F.expr("substr(repeat('+5?I', 20), cast(read_ord % 4 as int) + 1, length(seq))"))
    text.render_sam(A.in_files(spark, sf_dir, marked, "read_ord", "lineitem", 4)).write.text(path)
    return pileup.pileup_scan(text.read_sam(spark, path, qualities=True), A.reference(spark, sf_dir), A.BLOCK, PileupConfig(), max_depth=20, min_base_quality=20)


def src5_reference_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference under each read, pieced together over block borders."""
    spans = R.with_end(A.reads(spark, sf_dir)).select("read_ord", "contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("stop"))
    pieces = pileup.reference_bases(A.reference(spark, sf_dir), spans, A.BLOCK)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_start", "piece_bases"))), lambda x: x["piece_bases"]), "")
    return pieces.groupBy("read_ord").agg(whole.alias("bases"))


def src6_contig_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.contig_lengths(A.reference(spark, sf_dir), A.BLOCK)


def src1_sam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sam")
    text.render_sam(A.reads(spark, sf_dir)).write.text(path)
    return text.read_sam(spark, path).select("read_name", "contig", "ref_start", "mapq", "flag", "cigar", "seq")


def src1_bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as several BAM files with their indexes, read back in order: read_nth counts along the files."""
    bam.register(spark, bam.BamSource)
    path = new_path(spark, "bam")
    n = A.contig_length(spark, sf_dir)
    ranged = A.in_files(spark, sf_dir, A.reads(spark, sf_dir), "read_ord", "lineitem", 4)
    ranged.write.format("bam").option("contigs", ",".join(f"{c}:{n}" for c in A.CONTIGS)).mode("append").save(path)
    found = R.number_in_order(spark.read.format("bam").load(path), "ref_start", ["read_ord"], "read_nth")
    return found.select("read_nth", "read_name", "contig", "ref_start", "mapq", "flag", "cigar", "seq")


def src2_bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads over a region, from the blocks of BAM files that their indexes give for it."""
    bam.register(spark, bam.BamSource, bam.PushedBamSource)
    path, (contig, start, stop) = new_path(spark, "bam"), region(spark, sf_dir)
    n = A.contig_length(spark, sf_dir)
    A.in_files(spark, sf_dir, A.reads(spark, sf_dir), "read_ord", "lineitem", 4).write.format("bam").option("contigs", ",".join(f"{c}:{n}" for c in A.CONTIGS)).mode("append").save(path)
    return R.in_region(spark.read.format("bam_pushed").load(path), contig, start, stop, max_span=2 * A.BLOCK).select("read_name", "ref_start", "ref_end", "cigar")


def src1_files_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join3_label from reads and variants in several SAM and VCF files each."""
    sam, vcf = new_path(spark, "sam"), new_path(spark, "vcf")
    text.render_sam(A.in_files(spark, sf_dir, A.reads(spark, sf_dir), "read_ord", "lineitem", 5)).write.text(sam)
    text.render_vcf(A.in_files(spark, sf_dir, A.raw_variants(spark, sf_dir), "rec_ord", "orders", 3)).write.text(vcf)
    records = variants.parse_records(text.read_vcf(spark, vcf))
    return labels.labelled_rows(pipelines.label_candidates(text.read_sam(spark, sam), A.reference(spark, sf_dir), records, A.BLOCK))


def src4_fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference blocks as FASTA lines of 32 bases, read back in blocks of 100."""
    path = new_path(spark, "fasta")
    blocks = A.reference(spark, sf_dir)
    lines = blocks.select("contig", "block", F.lower("seq").alias("value")).union(blocks.select("contig", F.lit(-1), F.concat(F.lit(">"), "contig", F.lit(" synthetic"))).distinct())
    lines.repartition("contig").sortWithinPartitions("contig", "block").select("value", "contig").write.partitionBy("contig").text(path)
    return text.read_fasta(spark, path, block_size=100).select("contig", "block", "seq")


def fasta_of_contigs(spark: SparkSession, sf_dir: str) -> str:
    """FASTA files with a contig each, which is one text and therefore one task's."""
    path, blocks = new_path(spark, "fasta"), A.reference(spark, sf_dir)
    lines = blocks.select("contig", "block", F.lower("seq").alias("value")).union(blocks.select("contig", F.lit(-1), F.concat(F.lit(">"), "contig", F.lit(" synthetic"))).distinct())
    lines.repartition("contig").sortWithinPartitions("contig", "block").select("value").write.text(path)
    return path


def src4_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference in blocks of 100 through an index that Spark makes of its files."""
    bam.register(spark, fasta.FastaSource)
    path = fasta_of_contigs(spark, sf_dir)
    text.write_fasta_index(spark, path)
    return spark.read.format("fasta").option("blockSize", 100).load(path).select("contig", "block", "seq")


def src4_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of that index."""
    return text.fasta_index(spark, fasta_of_contigs(spark, sf_dir)).select("name", "length", "line_bases", "line_bytes", "broken")


def src7_vcf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vcf")
    text.render_vcf(A.raw_variants(spark, sf_dir)).write.text(path)
    return text.read_vcf(spark, path).select("contig", "pos", "ref", "alt", "filter", "gt")


def indexed_vcf(spark: SparkSession, sf_dir: str) -> str:
    vcf.register(spark, vcf.VcfSource)
    path = new_path(spark, "vcf")
    A.in_files(spark, sf_dir, A.raw_variants(spark, sf_dir), "rec_ord", "orders", 3).write.format("vcf").mode("append").save(path)
    return path


def src7_indexed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants as several block-compressed VCF files with their indexes, read back."""
    return spark.read.format("vcf").load(indexed_vcf(spark, sf_dir)).select("contig", "pos", "ref", "alt", "filter", "gt")


def src7_indexed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants over a region, from the blocks that the indexes give for it."""
    path = indexed_vcf(spark, sf_dir)
    return spark.read.format("vcf").option("region", "{}:{}-{}".format(*region(spark, sf_dir))).load(path).select("contig", "pos", "ref", "alt", "gt")


def src7_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.variants_in_region(A.raw_variants(spark, sf_dir), *region(spark, sf_dir)).select("rec_ord", "contig", "pos", "ref")


def src8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.passing(A.records(spark, sf_dir))
    return rows.select("rec_ord", "contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.size("gt").alias("n_gt"), "filter", "qual")


def lim1_first_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a second filter and a second sample, of which the first counts, through a file."""
    path = new_path(spark, "vcf")
    raw = A.raw_variants(spark, sf_dir).withColumn("filter", F.concat("filter", F.lit(";s50")))
    lines = text.render_vcf(raw).withColumn("value", F.concat("value", F.lit("\t9/9")))
    lines.write.text(path)
    shown = F.array_join(F.transform("gt", lambda g: F.coalesce(g.cast("string"), F.lit("."))), "/")
    return variants.parse_records(text.read_vcf(spark, path)).select("contig", "pos", "ref", F.array_join("alts", ",").alias("alt"), shown.alias("gt"), "filter")


def fn4_odd_alts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALT alleles that are missing, symbolic or a deletion marker; those as long as a longer REF have no class."""
    kind = F.col("pos") % 4
    odd = F.when(kind == 0, ".").when(kind == 1, "<DEL>").when(kind == 2, "*").otherwise(F.col("alt"))
    return variants.decompose(variants.parse_records(A.raw_variants(spark, sf_dir).withColumn("alt", odd)), hom_filter=False)


def flt10_invalid_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads that are set aside, once every fourth mapping quality writes matches with ``=``."""
    marked = F.when(F.col("mapq") % 4 == 0, F.translate("cigar", "M", "=")).otherwise(F.col("cigar"))
    return R.invalid_reads(A.reads(spark, sf_dir).withColumn("cigar", marked)).select("read_ord")


def flt10_read_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reads are set aside, by reason, once some are damaged; null for those that stay."""
    kind = F.col("mapq") % 8
    damaged = A.reads(spark, sf_dir).withColumns({
        "cigar": F.when(kind == 0, F.translate("cigar", "M", "=")).when(kind == 1, "*").otherwise(F.col("cigar")),
        "seq": F.when(kind == 2, F.concat("seq", F.lit("A"))).otherwise(F.col("seq")), "ref_start": F.when(kind == 3, -1).otherwise(F.col("ref_start")),
    })
    return damaged.groupBy(R.read_reason().alias("reason")).agg(F.count("*").alias("n"))


def flt5_record_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ALT alleles give no truth row, by reason, once some are as long as their REF."""
    raw = A.raw_variants(spark, sf_dir).withColumn("alt", F.when(F.col("pos") % 4 == 0, F.repeat(F.lit("G"), F.length("ref"))).otherwise(F.col("alt")))
    return variants.record_reasons(variants.parse_records(raw)).groupBy("reason").agg(F.count("*").alias("n"))


def flt1_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.well_mapped(A.reads(spark, sf_dir)).select("read_ord", "read_name", "mapq")


def exp1_cigar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cigar_ops(A.reads(spark, sf_dir)).select("read_ord", "op_idx", "op", "n", "rp", "qp", F.coalesce("bases", F.lit("")).alias("bases"))


def exp2_mismatch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("mm = 1").select("contig", "pos", "read_ord", "op_idx", "cls", "allele", "ref_base", "cov", "edit")


def agg1_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.sparse_pileup(sparse_events(spark, sf_dir))


def agg4_reads_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.mismatching_reads(events(spark, sf_dir, "read_name")).select("contig", "pos", F.array_join("read_names", ",").alias("read_names"))


def agg5_allele_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.allele_histogram(events(spark, sf_dir)).select("contig", "pos", "cls", "allele", "freq", F.col("first_seen.read_ord").alias("first_read"))


def agg7_covered_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.covered_by_pieces(said(spark, sf_dir))


def win1_candidates_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.find_positions(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK)


def win1_candidates_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.candidate_positions(sparse_events(spark, sf_dir), PileupConfig(threshold="final"))


def topk1_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.find_candidates(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK)


def topk1_alleles_commonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.find_candidates(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK, PileupConfig(allele_order="commonest"))


def prj1_candidate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["allele"], F.lit(":"), x["freq"].cast("string"))), ",").alias(c)
    return pileup.candidate_sites(topk1_alleles(spark, sf_dir)).select("contig", "pos", "ref_base", shown("in_alleles"), shown("snp_alleles"))


def win3_merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_windows(win1_candidates_running(spark, sf_dir))


def win3_merge_windows_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_windows(win1_candidates_running(spark, sf_dir), distance=2, offset=1, adjacent=False)


def vcf_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.decompose(A.records(spark, sf_dir))


def vcf_decompose_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.decompose(A.records(spark, sf_dir), hom_filter=False, config=PileupConfig(ref_mutation=False))


def agg9_genotype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.genotype_counts(A.records(spark, sf_dir), hom_filter=False)


def agg10_position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda x: F.concat(x["vref"], F.lit(">"), x["valt"], F.lit(":"), x["gt"].cast("string"))
    return variants.position_index(vcf_decompose(spark, sf_dir)).select("contig", "vpos", "cls", F.array_join(F.transform("entries", entry), ",").alias("entries"))


def fn13_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.record_text(A.records(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str, config: PileupConfig = PileupConfig()) -> DataFrame:
    return pipelines.label_candidates(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.records(spark, sf_dir), A.BLOCK, config)


def join3_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled_rows(labelled(spark, sf_dir))


def join3_label_one_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled_rows(labelled(spark, sf_dir, PileupConfig(label_span=1)))


def join3_label_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled_rows(labelled(spark, sf_dir, PileupConfig(label_match="none")))


def flt8_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.supported_positions(labelled(spark, sf_dir))


def flt8_supported_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same test on the list of genotypes of each position and class."""
    lists = labelled(spark, sf_dir).groupBy("contig", "pos", "cls").agg(F.collect_list("gt").alias("gts"), F.count("*").alias("n"))
    return lists.select("contig", "pos", "cls", "n", is_supported(F.col("gts")).alias("supported"))


def par5_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.label_region(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.records(spark, sf_dir), A.BLOCK, *region(spark, sf_dir), max_span=2 * A.BLOCK)


def par5_chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows of every chunk."""
    found = par3_chunk_candidates(spark, sf_dir)
    done = labels.label_alleles(found, variants.decompose(A.records(spark, sf_dir)))
    return done.select("chunk_id", "contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), F.col("ref_base").alias("ref"), "allele", "gt")


def par1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chunks(src6_contig_length(spark, sf_dir), CHUNK, OVERLAP)


def par2_equal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.equal_chunks(src6_contig_length(spark, sf_dir), 5)


def join1_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = intervals.assign_chunks(R.with_end(A.reads(spark, sf_dir)), par1_chunks(spark, sf_dir), width=1024)
    return placed.select("contig", "chunk_id", "read_ord", "ref_start")


def par3_chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.find_candidates_by_chunk(A.reads(spark, sf_dir), A.reference(spark, sf_dir), A.BLOCK, par1_chunks(spark, sf_dir))


def bed_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sets of intervals: one for every order, one for every part."""
    n = A.contig_length(spark, sf_dir)
    a = A.table(spark, sf_dir, "orders").selectExpr("concat('chr', cast(o_orderkey % 2 + 1 as string)) as contig", f"cast(o_orderkey * 17 % {n} as int) as start", f"cast(o_orderkey * 17 % {n} + 5 + o_custkey % 20 as int) as stop", "o_orderkey as name")
    b = A.table(spark, sf_dir, "part").selectExpr("concat('chr', cast(p_partkey % 2 + 1 as string)) as contig", f"cast(p_partkey * 29 % {n} as int) as start", f"cast(p_partkey * 29 % {n} + p_size as int) as stop")
    return a, b


def join5_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect(*bed_rows(spark, sf_dir), width=256).select("contig", "start", "stop", "name")


def src9_bed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bed")
    bed_rows(spark, sf_dir)[0].select(F.concat_ws("\t", "contig", "start", "stop", "name")).write.text(path)
    return text.read_bed(spark, path, "contig string, start int, stop int, name string")


def src10_list_to_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = A.table(spark, sf_dir, "nation").collect()  # 25 rows
    return intervals.from_list(spark, [(f"chr{r['n_regionkey'] + 1}", r["n_nationkey"] * 100, r["n_nationkey"] * 100 + len(r["n_name"])) for r in nations])


def src11_bed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.numbered(bed_rows(spark, sf_dir)[1]).select("contig", "start", "stop", "idx")


def agg11_region_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = par1_chunks(spark, sf_dir).select("contig", "start", (F.least(F.col("stop") - OVERLAP, F.col("start") + CHUNK) - 1).alias("stop"))
    return documents.region_documents(topk1_alleles(spark, sf_dir), regions)


def sink1_bed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bed")
    sinks.write_bed(join3_label(spark, sf_dir), path)
    return text.read_bed(spark, path, LABELLED).select("contig", "start", "stop", "ref", "allele", "gt")


def sink2_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    sinks.write_documents(agg11_region_json(spark, sf_dir), path)
    return sinks.read_documents(spark, path).select("chromosome_name", "start_position", "end_position", F.inline_outer("all_candidates"))


def src12_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and bytes of the files that a BED writer left, by contig folder."""
    path = new_path(spark, "files")
    sinks.write_bed(join3_label(spark, sf_dir), path)
    found = None
    for contig in A.CONTIGS:
        files = text.list_files(spark, f"{path}/chrom={contig}").groupBy(F.lit(contig).alias("contig"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind")).agg(F.sum("length").alias("bytes"))
        found = files if found is None else found.union(files)
    return found


def stream1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events that are closed, by event time, from a stream that has used up the table."""
    path = new_path(spark, "sessions")
    A.table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{path}/in")
    found = sessions.sessions(sessions.read_arriving(spark, f"{path}/in"), "12 hours", late="1 day")
    sessions.write_closed(found, f"{path}/out", f"{path}/state").awaitTermination()
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return spark.read.parquet(f"{path}/out").select("user_id", shown("start"), shown("stop"), "n", F.round("total", 4).alias("total"))


def stream2_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by position from a stream over files of reads, each batch giving the positions that it changed."""
    path = new_path(spark, "counts")
    A.in_files(spark, sf_dir, A.reads(spark, sf_dir), "read_ord", "lineitem", 3).write.parquet(f"{path}/in")
    per_batch = -(-A.n_files(spark, sf_dir, "lineitem", 3) // 3)
    counts = stream_pileup.pileup_stream(stream_pileup.read_arriving(spark, f"{path}/in", per_batch), A.reference(spark, sf_dir), A.BLOCK)
    stream_pileup.write_counts(counts, f"{path}/out", f"{path}/state").awaitTermination()
    return stream_pileup.latest_counts(spark, f"{path}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        src1_sam_roundtrip, src1_bam_roundtrip, src1_files_labelled, src2_region_scan, src2_bam_region, src3_pileup_columns, src3_filtered_columns, src4_fasta_roundtrip, src4_indexed, src4_index, src5_reference_bases, src6_contig_length, src7_vcf_roundtrip, src7_region_scan, src7_indexed_roundtrip, src7_indexed_region, src8_records, src9_bed_load, src10_list_to_bed, src11_bed_index, src12_list_files,
        lim1_first_filter, fn4_odd_alts, flt10_invalid_reads, flt10_read_reasons, flt5_record_reasons, flt1_mapq, flt8_supported, flt8_supported_lists, exp1_cigar_ops, exp2_mismatch_events, agg1_pileup, agg4_reads_by_position, agg5_allele_histogram, agg7_covered_reference, agg9_genotype_counts,
        agg10_position_index, agg11_region_json, win1_candidates_running, win1_candidates_final, win3_merge_windows, win3_merge_windows_apart, topk1_alleles, topk1_alleles_commonest, prj1_candidate_sites,
        vcf_decompose, vcf_decompose_unchanged, fn13_record_text, join1_chunk_overlap, join3_label, join3_label_one_position, join3_label_none, join5_intersect, par1_chunks, par2_equal_chunks,
        par3_chunk_candidates, par5_region, par5_chunk_labels, sink1_bed_roundtrip, sink2_json_roundtrip, stream1_sessions, stream2_pileup,
    )
}
