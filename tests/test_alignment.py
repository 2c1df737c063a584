"""Operators on hand-made inputs, and against a plain sequential walk over random reads."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lociflow.config import PileupConfig
from lociflow.functions import cigar as C
from lociflow.functions import genotype as G
from lociflow.operators import documents, intervals, labels, pileup, reads, variants
from lociflow.schemas import READS

BLOCK = 16


def reference(spark, **contigs):
    rows = [(c, b, s[b * BLOCK : (b + 1) * BLOCK]) for c, s in contigs.items() for b in range((len(s) + BLOCK - 1) // BLOCK)]
    return spark.createDataFrame(rows, "contig string, block int, seq string")


def make_reads(spark, rows, contig="c"):
    """Rows of (start, cigar, seq) or (start, cigar, seq, mapq)."""
    return spark.createDataFrame([(i, f"r{i}", contig, r[0], r[3] if len(r) > 3 else 60, 0, r[1], r[2]) for i, r in enumerate(rows)], READS)


def column(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def walk(rows, ref, min_mapq=5):
    """A sequential pile-up: (coverage, mismatches, histogram with first-seen order, flagged positions)."""
    cov, mm, hist, flagged = Counter(), Counter(), defaultdict(Counter), set()
    for r in rows:
        start, cig, seq = r[:3]
        if (r[3] if len(r) > 3 else 60) <= min_mapq:
            continue
        a, q = start, 0
        for n, op in re.findall(r"(\d+)([MIDNSHP])", cig):
            n, touched = int(n), []
            if op == "M":
                for i in range(n):
                    cov[a + i] += 1
                    if seq[q + i] != ref[a + i]:
                        mm[a + i] += 1
                        hist[a + i, 0][seq[q + i]] += 1
                        touched.append(a + i)
            elif op == "I":
                mm[a - 1] += 1
                hist[a - 1, 1][seq[q : q + n]] += 1
                touched.append(a - 1)
            elif op in "DN":
                for i in range(n):
                    cov[a + i] += 1
                    mm[a + i] += 1
                    hist[a + i, 0]["*"] += 1
                    touched.append(a + i)
            a += n if op in "MDN" else 0
            q += n if op in "MIS" else 0
            flagged |= {p for p in touched if cov[p] and mm[p] > 2 and mm[p] * 100 // cov[p] > 2 and cov[p] > 10}
    return cov, mm, hist, flagged


def test_walk_of_one_read(spark):
    ev = pileup.events(make_reads(spark, [(2, "3M2I2M1D1M", "GTTGGCGA")]), reference(spark, c="ACGTACGTAC"), BLOCK)
    counts = {r["pos"]: r for r in pileup.pileup(ev).collect()}
    assert {p: r["coverage"] for p, r in counts.items()} == dict.fromkeys(range(2, 9), 1)
    assert {p: r["mismatches"] for p, r in counts.items() if r["mismatches"]} == {4: 2, 7: 1}
    assert {p: r["edits"] for p, r in counts.items() if r["edits"]} == {4: 2}
    assert column(pileup.allele_histogram(ev), "pos", "cls", "allele") == [(4, 0, "T"), (4, 1, "GG"), (7, 0, "*")]


def test_skips_clips_and_pads(spark):
    ev = pileup.events(make_reads(spark, [(2, "1H2S2M3N1P2M", "NNGTAC")]), reference(spark, c="ACGTACGACGT"), BLOCK)
    assert column(ev.where("mm = 1"), "pos", "allele") == [(4, "*"), (5, "*"), (6, "*"), (7, "A"), (8, "C")][:3] + [(p, a) for p, a in ((7, "A"), (8, "C")) if "ACGTACGACGT"[p] != a]


def test_operations_of_a_long_read(spark):
    ops = [(random.Random(1).choice("MIDNSHP"), i % 7 + 1) for i in range(1)] + [("MIDN"[i % 4], i % 5 + 1) for i in range(300)]
    df = spark.createDataFrame([("".join(f"{n}{o}" for o, n in ops),)], "cigar string")
    got = df.select(C.with_offsets(C.parse_cigar("cigar")).alias("x")).first()["x"]
    rp = qp = 0
    for (o, n), x in zip(ops, got, strict=True):
        assert (x["op"], x["n"], x["rp"], x["qp"]) == (o, n, rp, qp)
        rp += n if o in "MDN" else 0
        qp += n if o in "MIS" else 0


def test_invalid_reads_are_quarantined_or_raise(spark):
    rows = make_reads(spark, [(0, "5=", "ACGTA"), (0, "5M", "ACGTA"), (0, "4M", "ACGTA"), (0, "*", "ACGTA"), (None, "5M", "ACGTA"), (0, None, "ACGTA"), (0, "5M", None)])
    assert column(reads.valid_reads(rows), "read_ord") == [(1,)]
    assert reads.invalid_reads(rows).count() == 6
    with pytest.raises(PySparkException):
        reads.valid_reads(rows, "raise").collect()


def test_leading_insertion_does_not_flag(spark):
    ev = pileup.events(make_reads(spark, [(5, "2I3M", "GGCGT"), (0, "2I3M", "GGACG")]), reference(spark, c="ACGTACGTAC"), BLOCK)
    sparse = pileup.sparse_events(make_reads(spark, [(5, "2I3M", "GGCGT"), (0, "2I3M", "GGACG")]), reference(spark, c="ACGTACGTAC"), BLOCK)
    assert pileup.candidate_positions(sparse).count() == 0
    assert column(ev.where("cls = 1"), "pos") == [(4,)]
    assert pileup.pileup(ev).where("pos = 4").first()["percent"] is None


@pytest.mark.parametrize(
    "mismatches, total, running, final",
    [({9, 10, 12}, 300, True, False), ({1, 2, 3}, 50, False, True), ({5, 20}, 20, False, False), ({8, 9, 10}, 10, False, False), ({8, 9, 11}, 11, True, True), ({1, 2, 101}, 101, False, False)],
)
def test_threshold_depends_on_order(spark, mismatches, total, running, final):
    sparse = pileup.sparse_events(make_reads(spark, [(0, "1M", "T" if i + 1 in mismatches else "A") for i in range(total)]), reference(spark, c="A"), BLOCK)
    assert bool(pileup.candidate_positions(sparse).count()) == running
    assert bool(pileup.candidate_positions(sparse, PileupConfig(threshold="final")).count()) == final


def test_alleles_by_frequency_and_first_seen(spark):
    rows = [(0, "1M", x) for x in "CGTTGGCGGGGTTTGGGT"]  # C 2, G 9, T 7... against A
    sparse = pileup.sparse_events(make_reads(spark, rows), reference(spark, c="A"), BLOCK)
    count = Counter("CGTTGGCGGGGTTTGGGT")
    assert [tuple(r) for r in pileup.candidate_alleles(sparse).orderBy("rnk").select("allele", "freq").collect()] == [("C", count["C"]), ("T", count["T"])]
    top = pileup.candidate_alleles(sparse, PileupConfig(allele_order="commonest")).orderBy("rnk").select("allele")
    assert [r[0] for r in top.collect()] == ["G", "T"]
    ties = pileup.sparse_events(make_reads(spark, [(0, "1M", x) for x in "TCGGCTTCGTCG"]), reference(spark, c="A"), BLOCK)
    assert [r[0] for r in pileup.candidate_alleles(ties).orderBy("rnk").select("allele").collect()] == ["T", "C"]


@pytest.mark.parametrize("bits", [16, 6, 2])
def test_random_reads_against_a_sequential_walk(spark, monkeypatch, bits):
    monkeypatch.setattr(pileup, "RUN_BITS", bits)  # few reads in a run: a position's counts are carried over many
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGT") for _ in range(90))
    rows = []
    for _ in range(700):
        cig, seq, used, start = [], "", 0, rng.randrange(50)
        if rng.random() < 0.2:
            cig, seq = ["2S"], "NN"
        for _ in range(rng.randint(1, 4)):
            op, n = rng.choice("MMMMIDN"), rng.randint(1, 8)
            if start + used + n > len(ref) or not used and op != "M":
                continue
            cig.append(f"{n}{op}")
            if op == "M":
                seq += "".join(c if rng.random() < 0.93 else rng.choice("ACGT") for c in ref[start + used : start + used + n])
            elif op == "I":
                seq += "".join(rng.choice("AC") for _ in range(n % 2 + 1))
                cig[-1] = f"{n % 2 + 1}I"
            used += n if op in "MDN" else 0
        if used:
            rows.append((start, "".join(cig), seq, rng.choice([3, 5, 6, 60])))
    cov, mm, hist, flagged = walk(rows, ref)
    ev = pileup.events(make_reads(spark, rows), reference(spark, c=ref), BLOCK)
    sparse = pileup.sparse_events(make_reads(spark, rows), reference(spark, c=ref), BLOCK)
    counts = pileup.pileup(ev).collect()
    assert {r["pos"]: r["coverage"] for r in counts if r["coverage"]} == dict(cov)
    assert {r["pos"]: r["mismatches"] for r in counts if r["mismatches"]} == dict(mm)
    assert {p for (p,) in column(pileup.candidate_positions(sparse), "pos")} == flagged
    want = sorted((p, cls, a, n, i + 1) for (p, cls), h in hist.items() if p in flagged for i, (a, n) in enumerate(sorted(h.items(), key=lambda x: x[1])[:2]))
    assert column(pileup.candidate_alleles(sparse), "pos", "cls", "allele", "freq", "rnk") == want
    sites = pileup.candidate_sites(pileup.candidate_alleles(sparse))
    assert sum(len(r["in_alleles"]) + len(r["snp_alleles"]) for r in sites.collect()) == len(want)


def records(spark, rows):
    raw = spark.createDataFrame([(i, "c", *r) for i, r in enumerate(rows)], "rec_ord long, contig string, pos int, ref string, alt string, gt string, filter string, qual double")
    return variants.parse_records(raw)


def truth_rows(df):
    return column(df, "vpos", "cls", "vref", "valt", "gt")


def test_decomposition(spark):
    rows = records(spark, [(101, "ACGT", "A", "0/1", "PASS", None), (50, "AT", "AGGT", "1/1", "PASS", 0.0), (60, "AT", "ATT,A", "0/1", "PASS", 3.0)])
    assert truth_rows(variants.decompose(rows)) == [(49, 1, "A", "AGG", 2), (59, 0, "A", "A", 1), (59, 1, "A", "AT", 1), (101, 0, "C", "*", 1), (102, 0, "G", "*", 1), (103, 0, "T", "*", 1)]
    assert (60, 0, "T", "*", 1) in truth_rows(variants.decompose(rows, config=PileupConfig(ref_mutation=False)))
    assert [r["qual"] for r in rows.orderBy("rec_ord").collect()] == [10.0, 10.0, 3.0]


def test_filters_and_invalid_records(spark):
    rows = records(spark, [(1, "A", "C", "0/0", "PASS", None), (2, "A", "C", "0/1", "q10", None), (3, "AC", "GT", "0/1", "PASS", None), (4, "A", None, "1", "PASS", None), (5, "A", "G", "2", "PASS;x", None), (6, "A", "G", "0/1/1", "PASS", None), (7, "A", "G", "0/1", None, None)])
    assert truth_rows(variants.decompose(rows)) == [(3, 0, "A", ".", 2), (4, 0, "A", "G", None)]
    assert tuple(variants.genotype_counts(rows, hom_filter=False).first()) == (1, 0, 2)
    with pytest.raises(PySparkException):
        variants.decompose(rows, config=PileupConfig(invalid="raise")).collect()


@pytest.mark.parametrize("gt, code", [("0/0", 0), ("0/1", 1), ("1/1", 2), ("1|2", 1), ("./.", 2), ("./1", 1), ("0", 0), ("1", 2), ("2", None)])
def test_genotype_codes(spark, gt, code):
    assert spark.createDataFrame([(gt,)], "gt string").select(G.genotype_code(G.parse_genotype("gt"))).first()[0] == code


def test_supported(spark):
    df = spark.createDataFrame([([],), ([0],), ([0, 0],), ([0, 1],), ([2],), ([None],)], "g array<int>")
    assert [r[0] for r in df.select(G.is_supported(F.col("g"))).collect()] == [False, False, False, True, True, True]


def test_labels(spark):
    truth = spark.createDataFrame([("c", 10, 0, "A", "T", 1, 0, 0, 0), ("c", 11, 0, "A", "T", 2, 1, 0, 0), ("c", 20, 1, "A", "AGG", 1, 2, 0, 0), ("c", 30, 0, "A", "T", None, 3, 0, 0)], "contig string, vpos int, cls int, vref string, valt string, gt int, rec_ord long, alt_idx int, i int")
    alleles = spark.createDataFrame([("c", 10, "A", 0, "T", 3, 1), ("c", 10, "A", 0, "G", 3, 2), ("c", 20, "A", 1, "GG", 3, 1), ("c", 30, "A", 0, "T", 3, 1)], "contig string, pos int, ref_base string, cls int, allele string, freq long, rnk int")
    get = lambda **k: column(labels.label_alleles(alleles, truth, PileupConfig(**k)).withColumn("gt", F.coalesce("gt", F.lit(-1))), "pos", "allele", "gt")
    assert get() == [(10, "G", 0), (10, "T", 2), (20, "GG", 1), (30, "T", -1)]
    assert get(label_span=1)[1] == (10, "T", 1)
    assert {x[2] for x in get(label_match="none")} == {0}
    assert labels.labelled_rows(labels.label_alleles(alleles, truth)).columns == ["contig", "start", "stop", "ref", "allele", "gt"]


def test_intervals(spark):
    bed = lambda *rows: spark.createDataFrame([("c", *r) for r in rows], "contig string, start int, stop int")
    assert column(intervals.intersect(bed((10, 40), (5, 5)), bed((5, 12), (30, 60), (40, 50)), width=8), "start", "stop") == [(10, 12), (30, 40)]
    lengths = spark.createDataFrame([("c", 450_000)], "contig string, length long")
    assert column(intervals.chunks(lengths), "start", "stop") == [(0, 200_010), (200_000, 400_010), (400_000, 450_000)]
    assert column(intervals.equal_chunks(lengths, 2), "start", "stop") == [(0, 226_000), (225_000, 451_000)]


@pytest.mark.parametrize("distance, adjacent, want", [(0, False, [(3, 3), (4, 4), (9, 9)]), (0, True, [(3, 4), (9, 9)]), (5, False, [(3, 9)])])
def test_merged_windows(spark, distance, adjacent, want):
    at = spark.createDataFrame([("c", 3), ("c", 4), ("c", 9), ("c", 4)], "contig string, pos int")
    assert column(intervals.merge_windows(at, distance, adjacent=adjacent), "start", "stop") == want


def test_windows_over_bin_borders(spark):
    at = spark.createDataFrame([("c", p) for p in (65_534, 65_535, 65_536, 65_600)], "contig string, pos int")
    assert column(intervals.merge_windows(at), "start", "stop", "n") == [(65_534, 65_536, 3), (65_600, 65_600, 1)]


def test_documents(spark):
    alleles = spark.createDataFrame([("c", 5, "A", 0, "T", 3, 1)], "contig string, pos int, ref_base string, cls int, allele string, freq long, rnk int")
    regions = spark.createDataFrame([("c", 0, 9), ("c", 10, 19)], "contig string, start int, stop int")
    got = {r["start"]: r["document"] for r in documents.region_documents(alleles, regions).collect()}
    assert got[0] == '{"all_candidates":[{"allele":"T","cls":0,"freq":3,"pos":5,"ref_base":"A"}],"chromosome_name":"c","end_position":9,"start_position":0}'
    assert '"all_candidates":[]' in got[10]


def test_long_reads_cost_no_more_per_base(spark):
    """Every base of a read of 40,000 is compared, in pieces of the reference's blocks, and only mismatches and stretches are rows."""
    ref = "ACGT" * 10_000
    seq = ref[:999] + "A" + ref[1000:]
    rows = make_reads(spark, [(0, "40000M", seq)] * 12)
    sparse = pileup.sparse_events(rows, reference(spark, c=ref), BLOCK)
    blocks = len(range(0, 40_000, BLOCK))
    assert sparse.where("cls is null").count() == 12 * blocks and column(sparse.where("cls = 0"), "pos", "allele") == [(999, "A")] * 12
    assert column(pileup.candidate_positions(sparse), "pos") == column(pileup.candidate_positions(sparse, PileupConfig(threshold="final")), "pos") == [(999,)]
    assert pileup.events(rows, reference(spark, c=ref), BLOCK).agg(F.sum("cov")).first()[0] == 480_000
    clipped = pileup.clip(sparse, F.lit(990), F.lit(999))
    assert clipped.where("cls is null").agg(F.sum(F.col("stop") - F.col("pos"))).first()[0] == 120 and clipped.where("cls = 0").count() == 12


def test_final_alleles(spark):
    rows = [(0, "1M", x) for x in "CGTTGGCGGGGTTTGGGT"]
    sparse = pileup.sparse_events(make_reads(spark, rows), reference(spark, c="A"), BLOCK)
    got = pileup.candidate_alleles(sparse, PileupConfig(threshold="final")).orderBy("rnk").select("allele").collect()
    assert [r[0] for r in got] == ["C", "T"]


def test_empty_tables(spark):
    none = make_reads(spark, [(0, "1M", "A")]).where("false")
    sparse = pileup.sparse_events(none, reference(spark, c="ACGT"), BLOCK)
    assert pileup.candidate_alleles(sparse).count() == 0
    assert intervals.merge_windows(pileup.candidate_positions(sparse)).count() == 0


def test_pileup_without_a_row_per_base(spark):
    """Over borders of bins, with insertions where nothing is covered, and gaps."""
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = []
    for _ in range(300):
        start = rng.choice([rng.randrange(2900), rng.randrange(1000, 1030), 2040])
        n = rng.randint(1, min(900 if rng.random() < 0.1 else 40, len(ref) - start))
        seq = "".join(c if rng.random() < 0.9 else rng.choice("ACGT") for c in ref[start : start + n])
        rows.append((start, f"{n}M", seq) if rng.random() < 0.7 or start == 0 else (start, f"2I{n}M", "AC" + seq))
    made = make_reads(spark, rows)
    want = column(pileup.pileup(pileup.events(made, reference(spark, c=ref), BLOCK)), "contig", "pos", "coverage", "mismatches", "edits", "percent")
    assert column(pileup.sparse_pileup(pileup.sparse_events(made, reference(spark, c=ref), BLOCK)), "contig", "pos", "coverage", "mismatches", "edits", "percent") == want


def test_a_deep_position_is_many_tasks(spark, monkeypatch):
    """All reads at one position: no group has more than a run of them, and the order still decides."""
    monkeypatch.setattr(pileup, "RUN_BITS", 7)
    rng = random.Random(9)
    bases = "".join(rng.choice("AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAT") for _ in range(4000))
    sparse = pileup.sparse_events(make_reads(spark, [(0, "1M", x) for x in bases]), reference(spark, c="A"), BLOCK)
    counted = pileup._counted(sparse, PileupConfig(), pileup.SITE).orderBy("read_ord").collect()
    m, want = 0, []
    for i, x in enumerate(bases):
        m += x == "T"
        if x == "T":
            want.append((i, m > 2 and i + 1 > 10 and m * 100 // (i + 1) > 2))
    assert [(r["read_ord"], r["ok"]) for r in counted] == want
    sizes = pileup._binned(sparse, ["contig"]).groupBy("contig", "bin", "run").count().collect()
    assert len(sizes) == -(-4000 // 128) and max(r["count"] for r in sizes) <= 2 * 128


@pytest.mark.parametrize("laid_out", [1, 7, 1 << 21])
def test_running_counts(monkeypatch, laid_out):
    monkeypatch.setattr(pileup, "_LAID_OUT", laid_out)
    rng = np.random.default_rng(2)
    for n in (0, 1, 60, 400):
        one = rng.random(n) < 0.5
        start = rng.integers(0, 30, n)
        stop = np.where(one, start + 1, start + rng.integers(1, 20, n))
        cov, mm = rng.integers(0, 9, pileup.WIDTH), rng.integers(0, 9, pileup.WIDTH)
        c, m, want = cov.copy(), mm.copy(), []
        for a, b, x in zip(start, stop, one, strict=True):
            if x:
                m[a] += 1
                want.append((c[a], m[a]))
            else:
                c[a:b] += 1
        assert list(zip(*map(list, pileup.running_counts(start, stop, one, cov, mm)), strict=True)) == want


def test_overlaps_of_short_and_long_intervals(spark):
    """Against all pairs, and how many rows an interval becomes."""
    rng = random.Random(6)

    def some(n):
        out = []
        for i in range(n):
            length = int(2 ** rng.uniform(-1, 28)) if rng.random() < 0.5 else rng.randrange(0, 40)
            start = rng.randrange(1 << 20) if rng.random() < 0.5 else rng.choice([0, 16, 127, 128, 1023, 1024])
            out.append((rng.choice(["a", "b"]), start, start + length, i))
        return out

    a, b = some(250), some(120)
    left, right = (spark.createDataFrame(x, "contig string, start int, stop int, name int") for x in (a, b))
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    for width in (16, 16_384):
        assert column(intervals.overlap_join(left, right, width).select(F.col("l.name").alias("x"), F.col("r.name").alias("y")), "x", "y") == want
    whole = spark.createDataFrame([("a", 3, 200_000_003, 0)], left.schema)
    places = whole.withColumn("_level", intervals._level(16_384)).select(F.size(intervals._places(16_384, F.sequence("_level", F.lit(intervals.LEVELS - 1)))))
    assert places.first()[0] <= 2 * intervals.LEVELS
    assert intervals.overlap_join(left, whole).count() == sum(x[0] == "a" and x[2] > 3 and x[1] < x[2] for x in a)
    assert intervals.overlap_join(left, right.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "adjacent"), [(0, True), (3, True), (90_000, True), (2, False)])
def test_merged_windows_over_many_bins(spark, distance, adjacent):
    rng = random.Random(distance)
    at = sorted({rng.choice([rng.randrange(400_000), 65_536 * rng.randrange(6) + rng.randrange(-3, 4), rng.randrange(120)]) for _ in range(700)} - set(range(-9, 0)))
    gap, want = distance + (1 if adjacent else 0), []
    for p in at:
        if want and p - want[-1][1] <= gap:
            want[-1] = (want[-1][0], p, want[-1][2] + 1)
        else:
            want.append((p, p, 1))
    rows = spark.createDataFrame([("c", p) for p in at for _ in range(2)], "contig string, pos int")
    assert column(intervals.merge_windows(rows, distance, adjacent=adjacent), "start", "stop", "n") == want


def test_pileup_scan(spark, monkeypatch):
    """Flags, base qualities and the first arrivals over many runs, against a plain walk."""
    monkeypatch.setattr(pileup, "RUN_BITS", 3)
    rng, ref, rows, want = random.Random(12), "ACGTACGTACGTACGTACGTACGTACGT", [], {}
    for i in range(400):
        start, n, flag = rng.randrange(20), rng.randrange(1, 6), rng.choice([0, 0, 0, 16, 0x400, 4, 0x100])
        cigar, seq = rng.choice([(f"{n}M", n), (f"1S{n}M", n + 1), (f"{n}M1D1M", n + 1), (f"{n}M1I", n + 1)])
        bases, quals = "".join(rng.choice("ACGT") for _ in range(seq)), rng.choice([None, "".join(chr(33 + rng.randrange(30)) for _ in range(seq))])
        rows.append((i, f"r{i}", "c", start, 60, flag, cigar, bases, quals))
        if flag & 0x704 or flag & 16:
            continue
        a, q = start, 0
        for k, op in re.findall(r"(\d+)([MIDS])", cigar):
            for j in range(int(k)):
                if op == "D" or op == "M" and (quals is None or ord(quals[q + j]) - 33 >= 13):
                    want.setdefault(a + j, []).append("*" if op == "D" else bases[q + j])
            a, q = a + int(k) * (op in "MD"), q + int(k) * (op in "MIS")
    made = spark.createDataFrame(rows, READS + ", qual string")
    for depth in (1, 7, 8000):
        got = pileup.pileup_scan(made, reference(spark, c=ref), BLOCK, max_depth=depth, exclude_flags=0x704 | 16)
        assert column(got, "pos", "n_reads", "bases") == sorted((p, min(depth, len(x)), "".join(x[:depth])) for p, x in want.items())
    assert reads.by_flags(made, require=16).count() == sum(r[5] == 16 for r in rows)
    assert pileup.pileup_scan(made.drop("qual"), reference(spark, c=ref), BLOCK, min_base_quality=99).count() > 0


def test_reasons_come_with_the_job(spark):
    made = make_reads(spark, [(0, "5=", "ACGTA"), (0, "5M", "ACGTA"), (0, "4M", "ACGTA"), (0, "*", "ACGTA"), (None, "5M", "ACGTA"), (0, None, "ACGTA"), (0, "5M", None), (-1, "*", "A")])
    kept, seen = reads.watched(made, reads.READ_REASONS, reads.read_reason())
    assert column(kept, "read_ord") == column(reads.valid_reads(made), "read_ord") == [(1,)]
    assert seen.get == {"rows": 8, "no start": 2, "no CIGAR": 2, "unknown operation": 1, "bases that don't fit": 2}
    raw = spark.createDataFrame([(1, "c", 5, "AC", "GT,A,ACC,AG", "0/1", "PASS"), (2, "c", 6, "A", "T", "0/0", "PASS"), (3, "c", 7, "A", "T", "1/1", "q"), (4, "c", 8, "A", "T", "0/1/1", "PASS"), (5, "c", 9, "A", "T", "./.", None)], "rec_ord long, contig string, pos int, ref string, alt string, gt string, filter string")
    found = variants.record_reasons(variants.parse_records(raw))
    assert column(found, "rec_ord", "alt_idx", "reason") == sorted([(1, 0, "no class"), (1, 1, None), (1, 2, None), (1, 3, None), (2, 0, "not called"), (3, 0, "filter"), (4, 0, "genotype of many alleles"), (5, 0, "filter")])
    assert column(found.where("reason is null"), "rec_ord", "alt_idx") == sorted(set(column(variants.decompose(variants.parse_records(raw)), "rec_ord", "alt_idx")))
