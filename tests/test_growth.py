"""What grows with the input is shuffled, cut into more files or tasks, and never collected."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lociflow import session
from lociflow.config import PileupConfig
from lociflow.functions import genotype
from lociflow.operators import intervals, pieces, pileup, variants
from lociflow.plans import alignment, pipelines, queries
from lociflow.schemas import READS
from lociflow.sources import bam

BED = "contig string, start int, stop int, name string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_join_broadcasts_neither_side_and_places_rows_on_met_levels_only(spark):
    a = spark.createDataFrame([("c", 10, 40, "x"), ("c", 0, 5000, "y")], BED)
    b = spark.createDataFrame([("c", 5, 12, "p"), ("c", 30, 60, "q"), ("c", 9, 9, "empty")], BED)
    found = intervals.intersect(a, b, width=256)
    assert sorted(map(tuple, found.collect())) == [("c", 5, 12, "y"), ("c", 10, 12, "x"), ("c", 30, 40, "x"), ("c", 30, 60, "y")]
    assert "Broadcast" not in plan(found)
    assert "Broadcast" not in plan(intervals.overlap_join(a, b, width=256))
    short = intervals.intersect(a.where("name = 'x'"), b, width=256)
    assert "sequence(_level" not in plan(short) and short.count() == 2


@pytest.mark.parametrize("laid_out, run_bits", [(1 << 21, 16), (50, 16), (1 << 21, 4), (64, 3)])
def test_pieces_give_the_candidates_of_events(spark, monkeypatch, laid_out, run_bits):
    """Odd CIGARs, reads over bins and off the contig, gaps in the reference, runs and parts: the same alleles as from a row per mismatch."""
    monkeypatch.setattr(pieces, "LAID_OUT", laid_out)
    monkeypatch.setattr(pieces, "RUN_BITS", run_bits)
    monkeypatch.setattr(pileup, "RUN_BITS", run_bits)
    rng = random.Random(laid_out + run_bits)
    ref = "".join(rng.choice("ACGT") for _ in range(2500))
    rows = []
    for i in range(400):
        start = rng.choice([rng.randrange(2490), rng.randrange(1015, 1030), 2040, 0])
        ops = [(rng.randint(1, 1200 if rng.random() < 0.02 else 12), rng.choice("MMMMMIDNSHP")) for _ in range(rng.randint(1, 6))]
        at, seq = start, ""
        for n, op in ops:
            if op == "M":
                seq += "".join(c if rng.random() < 0.8 else rng.choice("ACGTN") for c in (ref[at : at + n] + "A" * n)[:n])
            elif op in "IS":
                seq += "".join(rng.choice("AC") for _ in range(n))
            at += n if op in "MDN" else 0
        rows.append((start, "".join(f"{n}{o}" for n, o in ops), seq))
    rows += [(0, "5=", "ACGTA"), (0, "*", "A"), (None, "1M", "A"), (0, None, "A"), (0, "3M", None), (0, "4M", "ACG"), (5, "3MM", "ACG"), (5, "3M1", "ACG"), (5, "", "")]
    made = spark.createDataFrame([(i, f"r{i}", "c", r[0], 60, 0, r[1], r[2]) for i, r in enumerate(rows)], READS)
    blocks = spark.createDataFrame([("c", b, ref[b * 16 : b * 16 + 16].lower()) for b in range(157) if b not in (5, 64, 130)], "contig string, block int, seq string")
    names = ["contig", "pos", "ref_base", "cls", "allele", "freq", "rnk"]
    for said in (lambda x: x, lambda x: pileup.clip(x, F.lit(1000), F.lit(2045))):
        want = pileup.candidate_alleles(said(pileup.sparse_events(made, blocks, 16)))
        got = pileup.candidate_alleles(said(pieces.read_pieces(made, blocks, 16)))
        assert got.columns == want.columns == names
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
    wide = pieces.read_pieces(made, blocks, 16)
    assert wide.groupBy("read_ord", "bin").count().where("count > 2").count() == 0


@pytest.mark.parametrize("laid_out, run_bits, order", [(50, 16, "commonest"), (64, 4, "rarest")])
def test_packed_pieces_give_the_candidates_of_events(spark, monkeypatch, laid_out, run_bits, order):
    """Sorted or not, over bins, runs and parts; reads next to each other are a row for each bin and run."""
    monkeypatch.setattr(pieces, "LAID_OUT", laid_out)
    monkeypatch.setattr(pieces, "RUN_BITS", run_bits)
    rng = random.Random(laid_out + run_bits)
    ref = "".join(rng.choice("ACGT") for _ in range(2500))
    rows = [(i, f"r{i}", "c", rng.choice([rng.randrange(2480), rng.randrange(1010, 1030), 0]), 60, 0, rng.choice(["12M", "3S5M2I2M", "4M3D8M", "1I2N11M", "9M5H", "12=", "999999999H12M"]), "".join(rng.choice("ACGTN") for _ in range(12))) for i in range(600)]
    made = spark.createDataFrame(rows, READS)
    blocks = spark.createDataFrame([("c", b, ref[b * 16 : b * 16 + 16].lower()) for b in range(157) if b not in (5, 64, 130)], "contig string, block int, seq string")
    config = PileupConfig(allele_order=order)
    events, clipped = pileup.sparse_events(made, blocks, 16), lambda x: pileup.clip(x, F.lit(1000), F.lit(2045))
    for rows, said in ((made, clipped), (made.repartition(1).sortWithinPartitions("ref_start"), lambda x: x)):
        packed = pieces.packed_pieces(rows, blocks, 16)
        assert packed.groupBy("contig", "bin", "run").count().count() <= packed.count() < 600
        want = sorted(map(tuple, pileup.candidate_alleles(said(events), config).collect()))
        got = pileup.candidate_alleles(said(packed), config)
        assert got.columns == ["contig", "pos", "ref_base", "cls", "allele", "freq", "rnk"]
        assert sorted(map(tuple, got.collect())) == want and len(want) > 10
        assert "FlatMapGroupsInArrow" in plan(got)  # alleles are ranked where they are counted
    assert sorted(map(tuple, pileup.candidate_positions(packed).collect())) == sorted({r[:2] for r in want})


def test_pieces_of_long_reads_are_no_longer_than_the_reads(spark):
    ref = "ACGT" * 10_000
    made = spark.createDataFrame([(0, "r", "c", 0, 60, 0, "40000M", ref)], READS)
    found = pieces.read_pieces(made, spark.createDataFrame([("c", 0, ref)], "contig string, block int, seq string"), 65_536)
    assert found.agg(F.sum(F.length("seq")), F.max(F.length("seq")), F.count("*")).first() == (40_000, 1024, 40)
    assert found.where(F.substring("ref", 2, 2000) != F.col("seq")).count() == 0


def test_columns_and_covered_reference_from_pieces(spark, monkeypatch):
    """Over bins, runs and parts, with and without a bound: what events give."""
    monkeypatch.setattr(pieces, "LAID_OUT", 200)
    monkeypatch.setattr(pieces, "RUN_BITS", 4)
    rng, ref = random.Random(5), "ACGT" * 300
    rows = [(i, f"r{i}", "c", rng.choice([1015, 1020, rng.randrange(1150)]), 60, 0, "6M2D2I4M", "".join(rng.choice("ACGT") for _ in range(12))) for i in range(120)]
    made, blocks = spark.createDataFrame(rows, READS), spark.createDataFrame([("c", 0, ref)], "contig string, block int, seq string")
    ev, found = pileup.events(made, blocks, 1200), pieces.read_pieces(made, blocks, 1200)
    whole = {r["pos"]: r["bases"] for r in pileup.columns(ev).collect()}
    assert {r["pos"]: r["bases"] for r in pileup.piece_columns(found).collect()} == whole
    assert {r["pos"]: (r["n_reads"], r["bases"]) for r in pileup.piece_columns(found, 7).collect()} == {p: (min(7, len(b)), b[:7]) for p, b in whole.items()}
    assert sorted(map(tuple, pileup.covered_by_pieces(found).collect())) == sorted(map(tuple, pileup.covered_reference(ev).collect()))


def test_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = spark.range(1, 1001).withColumnRenamed("id", "read_ord")
    monkeypatch.setattr(alignment, "FILE_ROWS", 100)
    spread = alignment.in_files(spark, str(tmp_path), rows, "read_ord", "lineitem", 4).select("read_ord", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("read_ord"), F.max("read_ord")).orderBy("p").collect()
    assert [tuple(r) for r in spread] == [(i, i * 100 + 1, i * 100 + 100) for i in range(10)]
    monkeypatch.setattr(alignment, "FILE_ROWS", 500_000)
    assert alignment.n_files(spark, str(tmp_path), "lineitem", 4) == 4


def test_spans_of_an_index_that_nearly_meet_are_one_task():
    at = lambda *blocks: [(a << 16, b << 16) for a, b in blocks]
    assert bam.near_together(at((0, 10), (20, 30), (30, 90_000), (200_000, 200_001))) == at((0, 90_000), (200_000, 200_001))
    assert bam.near_together([(5, None)]) == [(5, None)] and bam.near_together([]) == []


def test_truth_is_derived_once_and_genotypes_are_read_in_compiled_code(spark):
    """Filters repeat what they test, so genotypes have no lambda, and labels read records that were written."""
    odd = spark.createDataFrame([(x,) for x in ("0/1", "1|1", "./.", "1", "", "0|.", "a/2", "1/2/3", None)], "gt string")
    parsed = odd.select(genotype.parse_genotype("gt").alias("gt"))
    assert [r["gt"] for r in parsed.collect()] == [[0, 1], [1, 1], [None, None], [1], [None], [0, None], [None, 2], [1, 2, 3], None]
    assert "lambda" not in plan(parsed)
    made = spark.createDataFrame([(i, f"r{i}", "c", 0, 60, 0, "4M", "ACTT") for i in range(12)], READS)
    blocks = spark.createDataFrame([("c", 0, "ACGT")], "contig string, block int, seq string")
    raw = spark.createDataFrame([(1, "c", 3, "G", "T", "0/1", "PASS"), (2, "c", 3, "G", "T,C", "1/1", "q10")], "rec_ord long, contig string, pos int, ref string, alt string, gt string, filter string")
    found = pipelines.label_candidates(made, blocks, variants.parse_records(raw), 4)
    assert [(r["pos"], r["allele"], r["freq"], r["gt"]) for r in found.collect()] == [(2, "T", 12, 1)]
    assert "split(" not in plan(found)


def test_running_positions_write_far_fewer_rows_than_reads(spark, monkeypatch):
    """The query's pieces are packed, and where bins have one run only positions leave the tasks, each once and unsorted."""
    written = []
    for module in (pieces, pileup):
        monkeypatch.setattr(module, "cut", lambda df: written.append(session.cut(df)) or written[-1])
    sf_dir = "/root/testdata/sf0.001"
    got = queries.win1_candidates_running(spark, sf_dir)
    assert max(df.count() for df in written) * 10 < alignment.reads(spark, sf_dir).count()
    assert not any("Exchange" in line and "pos#" in line for line in plan(got).splitlines())
    want = pileup.candidate_positions(queries.sparse_events(spark, sf_dir))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


@pytest.mark.parametrize("laid_out, run_bits", [(1 << 21, 16), (40, 16), (1 << 21, 3), (40, 3)])
def test_positions_of_pieces_come_once_over_runs_and_parts(spark, monkeypatch, laid_out, run_bits):
    monkeypatch.setattr(pieces, "LAID_OUT", laid_out)
    monkeypatch.setattr(pieces, "RUN_BITS", run_bits)
    rng, ref = random.Random(run_bits), "ACGT" * 600
    rows = [(i, f"r{i}", "c", rng.choice([1015, 1020, rng.randrange(2300)]), 60, 0, rng.choice(["6M2D2I4M", "2I10M", "5M3N5M2I"]), "".join(rng.choice("AACGT") for _ in range(12))) for i in range(900)]
    made, blocks = spark.createDataFrame(rows, READS), spark.createDataFrame([("c", 0, ref)], "contig string, block int, seq string")
    want = sorted(map(tuple, pileup.candidate_positions(pileup.sparse_events(made, blocks, 2400)).collect()))
    for said in (pieces.read_pieces, pieces.packed_pieces):
        assert sorted(map(tuple, pileup.candidate_positions(said(made, blocks, 2400)).collect())) == want and len(want) > 10


def test_shuffle_files_go_with_what_was_written(spark):
    """Not when the driver collects garbage: a table that is written holds no second copy of itself on disk."""
    folders = [Path(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for d in folders for f in d.rglob("shuffle_*.data")}
    before, kept = files(), session.cut(spark.range(1000).repartition(3))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and kept.count() == 1000


@pytest.mark.parametrize("query, distance, offset, adjacent", [("win3_merge_windows", 0, 0, True), ("win3_merge_windows_apart", 2, 1, False)])
def test_windows_read_their_bins_once(spark, monkeypatch, query, distance, offset, adjacent):
    """Positions are derived and shuffled once, without what follows from them; runs of both kinds are merged by one step."""
    rng = random.Random(8)
    at = sorted({rng.choice([rng.randrange(300_000), 65_536 * rng.randrange(1, 4) + rng.randrange(-4, 4)]) for _ in range(3000)})
    monkeypatch.setattr(queries, "win1_candidates_running", lambda *_: spark.createDataFrame([(c, p) for c in "cd" for p in at], "contig string, pos int"))
    found, want = queries.QUERIES[query](spark, ""), []
    for p in at:
        if want and p - want[-1][1] <= distance + adjacent:
            want[-1] = (want[-1][0], p, want[-1][2] + 1)
        else:
            want.append((p, p, 1))
    assert sorted(map(tuple, found.collect())) == sorted((c, a - offset, b + offset, n) for c in "cd" for a, b, n in want)
    assert found.dtypes == [("contig", "string"), ("start", "int"), ("stop", "int"), ("n", "bigint")]
    shown = found._jdf.queryExecution().sparkPlan().toString()
    assert shown.count("Scan ExistingRDD") == 1 and "Union" not in shown


def test_intersected_intervals_are_those_of_every_order_and_every_part(spark):
    sf_dir = "/root/testdata/sf0.001"
    for rows, name in zip(queries.bed_rows(spark, sf_dir), ("orders", "part"), strict=True):
        assert rows.count() == alignment.table(spark, sf_dir, name).count()
        assert not {"Filter", "Sample", "Limit"} & set(rows._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ").split())
