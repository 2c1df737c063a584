"""File readers on small files."""

import random
import re
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lociflow.operators import reads, variants
from lociflow.schemas import READS
from lociflow.sources import bam, binning, fasta, text, vcf
from lociflow.sources import bgzf as B
from lociflow.streaming import pileup as S
from lociflow.streaming import sessions

SAM = """@HD\tVN:1.6
r1\t0\tchr1\t3\t60\t4M\t*\t0\t0\tACGT\t*\tNM:i:0
r2\t16\t*\t0\t0\t*\t*\t0\t0\t*\t*
r3\t4\tchr2\t1\t7\t2S2M\t*\t0\t0\tNNAC\tIIII
"""
VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t10\t.\tA\tC,G\t50\tPASS\t.\tDP:GT\t3:0/1\t9:1/1
chr1\t20\t.\tA\t.\t.\tq10;q20\t.\tGT\t0/0\t0/0
"""


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    rows = text.read_sam(spark, str(tmp_path / "a.sam")).orderBy("read_ord").collect()
    assert [tuple(r)[1:] for r in rows] == [("r1", "chr1", 2, 60, 0, "4M", "ACGT"), ("r2", None, -1, 0, 16, "*", "*"), ("r3", "chr2", 0, 7, 4, "2S2M", "NNAC")]


@pytest.mark.parametrize(("most", "least"), [("128MB", "4MB"), ("200000", "50000"), ("300000b", "64k")])
def test_order_over_files_and_splits(spark, tmp_path, most, least):
    """Numbers are unique, and grow along files in the order of their names, part-2 before part-10."""
    rows, names = [], ["part-2.sam", "part-10.sam", "part-9 x.sam", "b/part-1.sam"]
    for k, name in enumerate(["part-2.sam", "part-9 x.sam", "part-10.sam"]):
        mine = [f"r{k}_{i}\t0\tchr1\t{i + 1}\t60\t4M\t*\t0\t0\tACGT\t*" for i in range((20_000, 3, 9_000)[k])]
        rows += [x.split("\t")[0] for x in mine]
        (tmp_path / name).write_text("@HD\tVN:1.6\n" + "\n".join(mine) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", least)
        got = text.read_sam(spark, str(tmp_path))
        assert [r["read_name"] for r in got.orderBy("read_ord").collect()] == rows
        assert got.select("read_ord").distinct().count() == len(rows)
        some = text.read_sam(spark, [str(tmp_path / n) for n in names[:2]])
        assert [r["read_name"] for r in some.orderBy("read_ord").collect()] == rows[:20_000] + rows[20_003:]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_too_many_splits_to_number(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("x\ny\n")
    monkeypatch.setattr(text, "_PLACE_BITS", 63)
    with pytest.raises(ValueError, match="too many"):
        text.read_lines(spark, str(tmp_path / "a.txt"))


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    raw = text.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert [(r["pos"], r["alt"], r["qual"], r["filter"], r["gt"]) for r in raw.orderBy("rec_ord").collect()] == [(10, "C,G", 50.0, "PASS", "0/1"), (20, ".", None, "q10;q20", "0/0")]
    assert [r["filter"] for r in variants.parse_records(raw).orderBy("rec_ord").collect()] == ["PASS", "q10"]
    assert text.variants_in_region(raw, "chr1", 0, 10).count() == 1


def test_fasta_over_splits(spark, tmp_path):
    contigs = {"one": "ACGTN" * 40_000, "two": "TTGCA" * 3, "three": "GATTACA" * 30_000}
    (tmp_path / "a.fa").write_text("".join(f">{n} some text\n" + "\n".join(s[i : i + 60].lower() for i in range(0, len(s), 60)) + "\n" for n, s in contigs.items()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
        spark.conf.set("spark.sql.files.openCostInBytes", "70000")
        ref = text.read_fasta(spark, str(tmp_path / "a.fa"), block_size=1000)
        got = {}
        for r in ref.orderBy("contig", "block").collect():
            assert len(r["seq"]) == 1000 or r["block"] == (len(contigs[r["contig"]]) - 1) // 1000
            got[r["contig"]] = got.get(r["contig"], "") + r["seq"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == contigs


def test_indexed_fasta(spark, tmp_path):
    contigs = {"one": "ACGTN" * 4001, "two": "TTGCA" * 3, "empty": "", "three": "gattaca" * 300}
    body, index = "", ""
    for n, s in contigs.items():
        body += f">{n} some text\n"
        index += f"{n}\t{len(s)}\t{len(body)}\t60\t61\n"
        body += "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60))
    path = str(tmp_path / "a.fa")
    (tmp_path / "a.fa").write_text(body)
    (tmp_path / "a.fa.fai").write_text(index)
    spark.dataSource.register(fasta.FastaSource)
    whole = spark.read.format("fasta").options(blockSize=1000, blocksPerTask=3).load(path)
    assert whole.rdd.getNumPartitions() == 9
    got = {}
    for r in whole.orderBy("contig", "block").collect():
        got[r["contig"]] = got.get(r["contig"], "") + r["seq"]
    assert got == {n: s.upper() for n, s in contigs.items() if s}
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, text.read_fasta(spark, path, block_size=1000).collect()))
    part = spark.read.format("fasta").options(blockSize=1000, region="one:2500-4001").load(path).orderBy("block").collect()
    assert [(r["block"], r["seq"]) for r in part] == [(b, contigs["one"][b * 1000 : b * 1000 + 1000]) for b in (2, 3, 4)]
    assert spark.read.format("fasta").options(region="none:0-5").load(path).count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("least", ["70000", "4MB"])
def test_fasta_index_made_by_spark(spark, tmp_path, end, least):
    """Over splits: equal to an index made line by line, and what is read by it equal to the files."""
    want, bases = {}, {}
    for k, file in enumerate(("a 1.fa", "b.fa")):
        body = ""
        for n, s in {f"one{k}": "ACGTN" * 40_001, f"two{k}": "TTGCA" * 3, f"empty{k}": "", f"three{k}": "gattaca" * 20_000}.items():
            body += f">{n} some text{end}"
            want[n] = (len(s), len(body), min(60, len(s)), min(60, len(s)) + len(end) if s else 0)
            body += "".join(s[i : i + 60] + end for i in range(0, len(s), 60))
            bases[n] = s.upper()
        (tmp_path / file).write_bytes(body.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, least)
        text.write_fasta_index(spark, str(tmp_path) + "/*.fa")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    made = [(c.name, (c.length, c.offset, c.line_bases, c.line_bytes)) for f in ("a 1.fa", "b.fa") for c in fasta.read_index(str(tmp_path / f))]
    assert made == list(want.items())
    bam.register(spark, fasta.FastaSource)
    got = {}
    for r in spark.read.format("fasta").option("blockSize", 1000).load(str(tmp_path)).orderBy("contig", "block").collect():
        got[r["contig"]] = got.get(r["contig"], "") + r["seq"]
    assert got == {n: s for n, s in bases.items() if s}


def test_fasta_that_no_index_can_express(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\nAC\nACGT\n")
    (tmp_path / "b.fa").write_text(">x\nACG\nACGT\n")
    assert [r["broken"] for r in text.fasta_index(spark, str(tmp_path) + "/*.fa").orderBy("file").collect()] == [1, 1]
    with pytest.raises(ValueError, match="width"):
        text.write_fasta_index(spark, str(tmp_path / "a.fa"))


def test_bed_and_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t1\t5\nchr1\t7\t9\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.bed").write_text("x\t1\t2\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 5), ("chr1", 7, 9)]
    assert [r["path"].rsplit("/", 1)[1] for r in text.list_files(spark, str(tmp_path)).collect()] == ["a.bed"]


def bgzf(data: bytes, block: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Compressed bytes, and (plain offset, file offset) of each block."""
    out, places = b"", []
    for i in [*range(0, len(data), block), None]:
        part = b"" if i is None else data[i : i + block]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        places.append((len(data) if i is None else i, len(out)))
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out, places


def test_bam_with_and_without_index(spark, tmp_path):
    names = ["chr1", "chr2"]
    data = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in names)
    starts, want = [], []
    for i in range(500):
        name, seq, ops = f"read{i}", "ACGTN"[: i % 5 + 1] * 3, [(len("ACGTN"[: i % 5 + 1]) * 3, 0), (2, 2)]
        packed = [bam.BASES.index(c) for c in seq] + [0]
        body = struct.pack("<iiBBHHHiiii", i % 3 - 1, i, len(name) + 1, i % 60, 0, len(ops), i % 4096, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(packed[k] << 4 | packed[k + 1] for k in range(0, len(seq), 2)) + b"\xff" * len(seq) + b"NMC\0"
        starts.append(len(data))
        data += struct.pack("<i", len(body)) + body
        want.append((name, names[i % 3 - 1] if i % 3 else None, i, i % 60, i % 4096, f"{len(seq)}M2D", seq))
    packed, places = bgzf(data, 777)
    path = tmp_path / "a.bam"
    path.write_bytes(packed)
    bam.register(spark, bam.BamSource)

    def read(**options):
        df = spark.read.format("bam").options(**options).load(str(path))
        return df, [tuple(r)[1:] for r in df.orderBy("read_ord").collect()]

    assert read()[1] == want
    for split in (300, 1000, 3000):  # without an index, tasks look for their first record
        df, rows = read(splitBytes=split)
        assert rows == want and df.rdd.getNumPartitions() > 3
    virtual = [next(f << 16 | s - p for p, f in reversed(places) if p <= s) for s in starts]
    (tmp_path / "a.bam.bai").write_bytes(b"BAI\1" + struct.pack("<i", 2) + struct.pack("<ii", 0, 3) + struct.pack("<3Q", *virtual[100:400:100]) + struct.pack("<iIiQQi", 1, 4681, 1, 0, 1, 1) + struct.pack("<Q", virtual[450]))
    df, rows = read(splitBytes=1)
    assert rows == want and df.rdd.getNumPartitions() == 5


def test_bam_region_and_long_cigar(spark, tmp_path):
    names = ["chr1", "chr2", "chr3"]
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 3) + b"".join(struct.pack("<i", 5) + n.encode() + b"\0" + struct.pack("<i", 10**6) for n in names)
    reads, index, plain = [], [{}, {}, {}], []
    for ref in (0, 2):
        for i in range(300):
            pos, long = i * 137, i % 50 == 7
            ops = [(4, 0), (20_000 if long else 3, 2), (4, 0)]
            field = [(8, 4), (sum(n for n, o in ops), 3)] if long else ops
            body = struct.pack("<iiBBHHHiiii", ref, pos, 3, 9, 0, len(field), 0, 8, -1, -1, 0) + b"r1\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in field) + b"\x11" * 4 + b"\xff" * 8
            body += b"NMC\1XZZab\0XBBS" + struct.pack("<iHH", 2, 1, 2) + (b"CGBI" + struct.pack("<i3I", 3, *(n << 4 | o for n, o in ops)) if long else b"")
            end = pos + sum(n for n, _ in ops)
            plain.append((len(data), ref, pos, end))
            reads.append((names[ref], pos, end, "".join(f"{n}{'MID'[o]}" for n, o in ops)))
            data += struct.pack("<i", len(body)) + body
    packed, places = bgzf(data, 3000)
    (tmp_path / "a.bam").write_bytes(packed)
    for at, ref, pos, end in plain:
        where = next(f << 16 | at - p for p, f in reversed(places) if p <= at)
        for w in range(pos >> 14, (end - 1 >> 14) + 1):
            index[ref].setdefault(w, where)
    bam.register(spark, bam.BamSource)

    def check(**options):
        for region in (("chr1", 30_000, 31_000), ("chr3", 0, 138), ("chr2", 0, 10**6), ("none", 0, 9), ("chr3", 41_000, 900_000), ("chr1", 900_000, 900_001)):
            df = spark.read.format("bam").options(region="{}:{}-{}".format(*region), **options).load(str(tmp_path / "a.bam"))
            want = [(c, s, cig) for c, s, e, cig in reads if c == region[0] and s < region[2] and e > region[1]]
            assert [tuple(r) for r in df.orderBy("read_ord").select("contig", "ref_start", "cigar").collect()] == want
        return df

    check()
    bai = b"BAI\1" + struct.pack("<i", 3)
    for x in index:
        n = max(x, default=-1) + 1
        bai += struct.pack("<ii", 0, n) + b"".join(struct.pack("<Q", x.get(w, 0)) for w in range(n))
    (tmp_path / "a.bam.bai").write_bytes(bai)
    check()
    check(splitBytes=1)
    reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "region": "chr3:41000-900000"})
    assert reader.partitions()[0].start > bam.BamReader({"path": str(tmp_path / "a.bam"), "region": "chr3:0-9"}).partitions()[0].start


def test_streaming_counts(spark, tmp_path):
    ref = spark.createDataFrame([("c", 0, "ACGT")], "contig string, block int, seq string")
    for i in range(2):
        spark.createDataFrame([(i, "r", "c", 0, 60, 0, "4M", "ACTT")], READS).write.mode("append").parquet(str(tmp_path / "in"))
    counts = S.pileup_stream(S.read_arriving(spark, str(tmp_path / "in"), 1), ref, 16)
    query = S.write_counts(counts, str(tmp_path / "counts"), str(tmp_path / "state"))
    query.awaitTermination(120)
    every = spark.read.parquet(str(tmp_path / "counts"))
    last = every.where(F.col("batch") == every.agg(F.max("batch")).first()[0])
    rows = last.orderBy("pos").select("pos", "coverage", "mismatches").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 0), (1, 2, 0), (2, 2, 2), (3, 2, 0)]
    assert last.agg(F.sum("edits")).first()[0] == 2


CONTIGS = {"chr1": 400_000, "chr2": 90_000, "chr10": 5_000}


def made_reads(spark, n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for contig, length in CONTIGS.items():
        for start in sorted(rng.randrange(length - 200) for _ in range(n)):
            k = rng.randint(1, 60)
            cigar = rng.choice([f"{k}M", f"2S{k}M", f"{k}M20D1M", f"{k}M30000N1M", f"3H{k}M1I"])
            size = sum(int(x) for x, o in re.findall(r"(\d+)([MIS])", cigar))
            rows.append((len(rows), f"r{len(rows)}", contig, start, rng.randrange(61), rng.randrange(4096), cigar, "".join(rng.choice("ACGTN") for _ in range(size))))
    rows.append((len(rows), "loose", None, -1, 0, 4, "*", "ACG"))
    return rows, spark.createDataFrame(rows, READS)


def written_bam(spark, path, df, parts=3):
    bam.register(spark, bam.BamSource)
    df.repartitionByRange(parts, "read_ord").sortWithinPartitions("read_ord").write.format("bam").option("contigs", ",".join(f"{c}:{n}" for c, n in CONTIGS.items())).mode("append").save(path)


def blocks_of(reader):
    """Compressed bytes that the reader's tasks load, and the rows they give."""
    n, rows = 0, []
    for part in reader.partitions():
        if part.path:
            blocks = B.Blocks(part.path, part.start)
            rows += reader.records(part, blocks)
            n += blocks.loaded
    return n, rows


def test_bam_written_and_read(spark, tmp_path):
    rows, df = made_reads(spark)
    path = str(tmp_path / "out")
    written_bam(spark, path, df)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == sorted(f"part-0000{i}.bam{e}" for i in range(3) for e in ("", ".bai"))
    for options in ({}, {"splitBytes": 5000}):
        got = spark.read.format("bam").options(**options).load(path)
        assert [tuple(r)[1:] for r in got.orderBy("read_ord").collect()] == [r[1:] for r in rows]
        assert got.select("read_ord").distinct().count() == len(rows)
    for x in (tmp_path / "out").glob("*.bai"):
        x.unlink()
    assert [tuple(r)[1:] for r in spark.read.format("bam").options(splitBytes=5000).load(path).orderBy("read_ord").collect()] == [r[1:] for r in rows]


def test_bam_filters_reach_the_index(spark, tmp_path):
    rows, df = made_reads(spark, 12_000)
    path = str(tmp_path / "out")
    written_bam(spark, path, df)
    bam.register(spark, bam.PushedBamSource)
    got = lambda: spark.read.format("bam_pushed").load(path)
    near = got().where((F.col("contig") == "chr1") & (F.col("ref_start") >= 100_000) & (F.col("ref_start") < 101_000))
    assert [r["read_name"] for r in near.orderBy("read_ord").collect()] == [r[1] for r in rows if r[2] == "chr1" and 100_000 <= r[3] < 101_000]
    assert got().where("contig = 'chr2' and ref_start = 7 or contig = 'chr10'").count() == sum(r[2] == "chr10" or (r[2], r[3]) == ("chr2", 7) for r in rows)
    assert got().where("contig = 'none'").count() == 0 and got().where("contig is null").count() == 1
    over = reads.in_region(got(), "chr1", 200_000, 200_500, max_span=31_000)
    assert over.count() == sum(r[2] == "chr1" and r[3] < 200_500 and r[3] + cigar_span(r[6]) > 200_000 for r in rows)

    def read(*filters, **options):
        reader = bam.PushedBamReader({"path": path, **options})
        list(reader.pushFilters(list(filters)))
        return blocks_of(reader)

    contig, least, below = D.EqualTo(("contig",), "chr1"), D.GreaterThanOrEqual(("ref_start",), 100_000), lambda n: D.LessThan(("ref_start",), n)
    every, few, more = read()[0], read(contig, least, below(100_100)), read(contig, least, below(300_000))
    assert len(few[1]) == sum(r[2] == "chr1" and 100_000 <= r[3] < 100_100 for r in rows)
    assert few[0] < more[0] / 2 < every / 3
    assert read(region="chr1:100000-100100")[0] < every / 3


def cigar_span(cigar):
    return sum(int(n) for n, o in re.findall(r"(\d+)([MDN])", cigar))


def test_bam_writer_refuses(spark, tmp_path):
    _, df = made_reads(spark, 20)
    with pytest.raises(PySparkException, match="order"):
        df.orderBy(F.col("read_ord").desc()).where("contig is not null").coalesce(1).write.format("bam").option("contigs", "chr1:9,chr2:9,chr10:9").mode("append").save(str(tmp_path / "x"))
    assert not list((tmp_path / "x").glob("part*"))  # nothing is left of a failed job
    written_bam(spark, str(tmp_path / "y"), df.limit(0))
    assert spark.read.format("bam").load(str(tmp_path / "y")).count() == 0
    with pytest.raises(Exception, match="already"):
        df.write.format("bam").option("contigs", "chr1:9").mode("append").save(str(tmp_path / "y"))


def test_bins_of_positions():
    """Every bin that can hold a row that overlaps a region touches it, at each depth."""
    rng = random.Random(1)
    for shift, depth in ((14, 5), (14, 7), (3, 2)):
        most = 1 << shift + 3 * depth
        for _ in range(3000):
            a, b = sorted(rng.sample(range(most + 1), 2))
            c = min(most - 1, max(0, rng.choice([a, b]) + rng.randrange(-9, 9)))
            d = min(most, c + rng.randrange(1, 50))
            if a < d and c < b:
                assert any(binning.bin_of(a, b, shift, depth) in x for x in binning.bins_touching(c, d, shift, depth))


def made_records(spark, n=4000):
    rng = random.Random(8)
    rows = []
    for contig, length in CONTIGS.items():
        for pos in sorted(rng.randrange(1, length) for _ in range(n)):
            rows.append((len(rows), contig, pos, rng.choice(["A", "AC", "G" * 300]), rng.choice(["T", "T,GG", "."]), rng.choice([None, 10.0, 50.5]), rng.choice(["PASS", "q10"]), rng.choice(["0/1", "1|1", "./."])))
    return rows, spark.createDataFrame(rows, vcf.RAW)


def written_vcf(spark, path, df, parts=3):
    vcf.register(spark, vcf.VcfSource, vcf.PushedVcfSource)
    df.repartitionByRange(parts, "rec_ord").sortWithinPartitions("rec_ord").write.format("vcf").mode("append").save(path)


def test_indexed_vcf(spark, tmp_path):
    rows, df = made_records(spark)
    path = str(tmp_path / "out")
    written_vcf(spark, path, df)
    for options in ({}, {"splitBytes": 3000}, {"splitBytes": 20_000}):
        got = spark.read.format("vcf").options(**options).load(path)
        assert [tuple(r)[1:] for r in got.orderBy("rec_ord").collect()] == [r[1:] for r in rows], options
    over = lambda c, a, b: [r[1:] for r in rows if r[1] == c and r[2] - 1 < b and r[2] - 1 + len(r[3]) > a]
    for region in (("chr1", 100_000, 101_000), ("chr2", 0, 1), ("chr2", 89_000, 10**9), ("chr10", 100, 200), ("none", 0, 9), ("chr1", 16_384, 16_385)):
        got = spark.read.format("vcf").option("region", "{}:{}-{}".format(*region)).load(path)
        assert [tuple(r)[1:] for r in got.orderBy("rec_ord").collect()] == over(*region), region
    near = spark.read.format("vcf_pushed").load(path).where("contig = 'chr1' and pos > 5000 and pos <= 5400")
    assert [tuple(r)[1:] for r in near.orderBy("rec_ord").collect()] == [r[1:] for r in rows if r[1] == "chr1" and 5000 < r[2] <= 5400]
    assert text.read_vcf(spark, path + "/*.vcf.gz").count() == len(rows)  # a plain gzip reader takes the blocks too

    def read(region):
        return blocks_of(vcf.VcfReader({"path": path} | ({"region": region} if region else {})))[0]

    assert read("chr1:100000-100100") < read("chr1:100000-300000") / 2 < read(None) / 3


def test_csi_index(spark, tmp_path):
    """The same regions by a .csi of other widths, made here from the lines' places."""
    rows, df = made_records(spark, 600)
    written_vcf(spark, str(tmp_path / "out"), df, 1)
    path = tmp_path / "out" / "part-00000.vcf.gz"
    names, blocks, contigs = list(CONTIGS), B.Blocks(str(path)), [{} for _ in CONTIGS]
    while True:
        begin = blocks.offset
        line = blocks.line()
        if line is None:
            break
        if line[:1] != b"#":
            f = line.decode().split("\t")
            a, b = int(f[1]) - 1, int(f[1]) - 1 + len(f[3])
            contigs[names.index(f[0])].setdefault(binning.bin_of(a, b, 10, 4), []).append((begin, blocks.offset))
    joined = b"".join(n.encode() + b"\0" for n in names)
    extra = struct.pack("<7i", 2, 1, 2, 0, 35, 0, len(joined)) + joined
    out = b"CSI\1" + struct.pack("<iii", 10, 4, len(extra)) + extra + struct.pack("<i", len(names))
    for bins in contigs:
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<IQi", k, 0, len(v)) + b"".join(struct.pack("<2Q", *x) for x in v) for k, v in bins.items())
    path.with_name(path.name + ".tbi").unlink()
    path.with_name(path.name + ".csi").write_bytes(bgzf(out, 5000)[0])
    for c, a, b in (("chr1", 100_000, 120_000), ("chr2", 0, 400), ("chr10", 4000, 9000)):
        got = spark.read.format("vcf").option("region", f"{c}:{a}-{b}").load(str(path))
        assert [tuple(r)[1:] for r in got.orderBy("rec_ord").collect()] == [r[1:] for r in rows if r[1] == c and r[2] - 1 < b and r[2] - 1 + len(r[3]) > a]


def test_sessions_on_a_stream(spark, tmp_path):
    """Closed sessions come once; events that come too late are dropped; a table gives all sessions."""
    at = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    files = [[(1, 0), (1, 20), (2, 5)], [(1, 45), (1, 200)], [(2, 6), (1, 400), (2, 401)]]  # (2, 6) comes 195 minutes after newer ones
    for i, rows in enumerate(files):
        made = spark.createDataFrame([(k, at(m), u, "x", 1.0, None) for k, (u, m) in enumerate(rows)], "event_id long, ts string, user_id long, event_type string, value double, props string")
        made.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    every = spark.read.parquet(str(tmp_path / "in" / "*"))
    shown = lambda df: sorted((r["user_id"], str(r["start"])[11:16], str(r["stop"])[11:16], r["n"]) for r in df.collect())
    whole = shown(sessions.sessions(every))
    assert whole == [(1, "00:00", "01:15", 3), (1, "03:20", "03:50", 1), (1, "06:40", "07:10", 1), (2, "00:05", "00:36", 2), (2, "06:41", "07:11", 1)]
    for i in range(3):  # each run of the query takes what has come since, and goes on from its state
        (tmp_path / "come" / f"{i}").mkdir(parents=True)
        for f in (tmp_path / "in" / f"{i}").glob("*.parquet"):
            (tmp_path / "come" / f"{i}" / f.name).write_bytes(f.read_bytes())
        found = sessions.sessions(sessions.read_arriving(spark, str(tmp_path / "come" / "*")), late="60 minutes")
        sessions.write_closed(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == [(1, "00:00", "01:15", 3), (1, "03:20", "03:50", 1), (2, "00:05", "00:35", 1)]


def test_counts_of_changed_positions_only(spark, tmp_path):
    ref = spark.createDataFrame([("c", 0, "ACGTACGT")], "contig string, block int, seq string")
    for i, start in enumerate((0, 4, 3)):
        spark.createDataFrame([(i, "r", "c", start, 60, 0, "4M", "ACTT")], READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.write_counts(S.pileup_stream(S.read_arriving(spark, str(tmp_path / "in"), 1), ref, 16), str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination(120)
    every = spark.read.parquet(str(tmp_path / "counts"))
    assert {r["batch"]: r["n"] for r in every.groupBy("batch").agg(F.count("*").alias("n")).where("n > 0").collect()} == {0: 4, 1: 4, 2: 4}
    assert [(r["pos"], r["coverage"]) for r in S.latest_counts(spark, str(tmp_path / "counts")).orderBy("pos").collect()] == [(p, 2 if 3 <= p < 7 else 1) for p in range(8)]
