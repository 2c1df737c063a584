"""Pile-up: events of reads against the reference, counts by position, candidates and their alleles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..functions.genotype import DELETED, INSERTION, SNP_OR_DELETION
from ..session import cut
from . import pieces as P
from .pieces import RUN_BITS, WIDTH
from .reads import by_flags, cigar_ops, valid_reads, well_mapped

SITE = ("contig", "pos")
ARRIVAL = ("read_ord", "op_idx")


def reference_bases(reference: DataFrame, intervals: DataFrame, block_size: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """``intervals`` cut at block borders, each piece with its upper-case reference bases: piece_start, piece_bases.

    The join is on (contig, block), for whole pieces and not for single bases.  Spark broadcasts the reference
    where it knows it to be small.  Pieces off the contig are left out.
    """
    b = F.col("block")
    blocks = F.sequence(F.floor(F.greatest(F.col(start), F.lit(0)) / block_size).cast("int"), F.floor((F.col(stop) - 1) / block_size).cast("int"))
    pieces = intervals.where((F.col(stop) > 0) & (F.col(stop) > F.col(start))).withColumn("block", F.explode(blocks))
    ref = reference.select("contig", "block", F.upper("seq").alias("_block_seq"))
    first = F.greatest(F.col(start), b * block_size)
    joined = pieces.join(ref, ["contig", "block"]).withColumn("piece_start", first.cast("int"))
    length = (F.least(F.col(stop), (b + 1) * block_size) - F.col("piece_start")).cast("int")
    found = joined.withColumn("piece_bases", F.substring("_block_seq", (F.col("piece_start") - b * block_size + 1).cast("int"), length))
    return found.where("piece_bases <> ''").drop("_block_seq", "block")


def _pieces(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig, keep: Sequence[str]) -> DataFrame:
    """CIGAR operations cut at block borders, with ``both``: an array of (ref_base, allele) for each position of the piece; ``same``: whether all are matches.

    Strings are cut to the piece once and split, so that the work grows with their length and no later row carries them.
    """
    walked = cigar_ops(valid_reads(well_mapped(reads, config.min_mapq), config.invalid), "contig", "ref_start", *keep).where("op in ('M', 'I', 'D', 'N') and n > 0")
    at = F.col("ref_start") + F.col("rp")
    inserted = F.col("op") == "I"
    spans = walked.withColumn("start", F.when(inserted, at - 1).otherwise(at)).withColumn("stop", F.when(inserted, at).otherwise(at + F.col("n")))
    pieces = reference_bases(reference, spans, block_size)
    size = F.length("piece_bases")
    pieces = pieces.withColumn("read_bases", F.substring("bases", (F.col("piece_start") - F.col("start") + 1).cast("int"), size))
    alleles = F.when(F.col("op") == "M", F.split("read_bases", "")).when(inserted, F.array("bases")).otherwise(F.array_repeat(F.lit(DELETED), size))
    zipped = [F.split("piece_bases", "").alias("ref_base"), alleles.alias("allele")]
    if "quals" in pieces.columns:  # none for insertions, deletions and skips, and where a read has none
        quals = F.when((F.col("op") == "M") & (F.length("quals") == F.length("bases")), F.split(F.substring("quals", (F.col("piece_start") - F.col("start") + 1).cast("int"), size), ""))
        zipped.append(F.coalesce(quals, F.array().cast("array<string>")).alias("qual"))
    both = F.arrays_zip(*zipped)
    cls = F.when(inserted, INSERTION).otherwise(SNP_OR_DELETION)
    return pieces.select("contig", *ARRIVAL, *keep, "op", "piece_start", size.alias("size"), cls.alias("cls"), ((F.col("op") == "M") & (F.col("read_bases") == F.col("piece_bases"))).alias("same"), both.alias("both"))


def events(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """One row per read and position it has something to say on.

    contig, pos, read_ord, op_idx, cls (0 base or deletion, 1 insertion), allele, ref_base, cov, mm, edit.  Deletions
    and skips give ``*`` at every position; an insertion stands at the base before it and covers nothing.  If ``reads`` have a column ``qual``
    (qualities as SAM writes them), so have events, with the quality of the base as a number; it is null where there is none.
    """
    pieces = _pieces(reads, reference, block_size, config, keep)
    placed = pieces.select("contig", *ARRIVAL, *keep, "op", "piece_start", "cls", F.posexplode_outer("both").alias("k", "base"))  # outer, else both is also computed to test its size
    mismatch = (F.col("op") != "M") | (F.col("base.allele") != F.col("base.ref_base"))
    return placed.select(
        "contig", (F.col("piece_start") + F.col("k")).cast("int").alias("pos"), *ARRIVAL, *keep, "cls", F.col("base.allele").alias("allele"), F.col("base.ref_base").alias("ref_base"),
        (F.col("op") != "I").cast("int").alias("cov"), mismatch.cast("int").alias("mm"), (mismatch & F.col("op").isin("M", "I")).cast("int").alias("edit"),
        *([(F.ascii("base.qual") - 33).alias("qual")] if "qual" in reads.columns else []),
    )


def sparse_events(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """What candidates need of events(): a row per mismatch, and a row per stretch [pos, stop) that a read covers.

    contig, pos, stop, read_ord, op_idx, cls, allele, ref_base; cls is null for a stretch.  Matching bases give no rows.
    """
    pieces = _pieces(reads.drop("qual"), reference, block_size, config, keep)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("ref_base"), F.lit(None).cast("string").alias("allele")))  # stands for the stretch
    shown = F.when(F.col("same"), whole).otherwise(F.concat(whole, "both"))  # most pieces of most reads are the reference's, and no base of them is looked at
    placed = pieces.select("contig", *ARRIVAL, *keep, "op", "piece_start", "size", "cls", F.posexplode_outer(shown).alias("k", "base"))
    stretch = F.col("k") == 0
    mismatch = (F.col("op") != "M") | (F.col("base.allele") != F.col("base.ref_base"))
    kept = placed.where(F.when(stretch, F.col("op") != "I").otherwise(mismatch))
    pos = F.when(stretch, F.col("piece_start")).otherwise(F.col("piece_start") + F.col("k") - 1).cast("int")
    stop = F.when(stretch, F.col("piece_start") + F.col("size")).otherwise(F.col("piece_start") + F.col("k")).cast("int")
    return kept.select("contig", pos.alias("pos"), stop.alias("stop"), *ARRIVAL, *keep, F.when(~stretch, F.col("cls")).alias("cls"), F.col("base.allele").alias("allele"), F.col("base.ref_base").alias("ref_base"))


def clip(sparse: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Mismatches at positions from start to stop, both included, and what stretches have of them; also of pieces."""
    if "ops" in sparse.columns:
        return sparse.withColumn("first", start.cast("int")).withColumn("last", stop.cast("int"))
    cut = sparse.withColumn("pos", F.greatest("pos", F.when(F.col("cls").isNull(), start).otherwise(F.col("pos")))).withColumn("stop", F.least("stop", stop + 1))
    return cut.where((F.col("pos") < F.col("stop")) & (F.col("pos") >= start))


def over_limits(mismatches: Column, coverage: Column, config: PileupConfig) -> Column:
    """The candidate test; the percentage is compared after rounding down."""
    return (mismatches > config.min_mismatches) & (coverage > config.min_coverage) & (mismatches * 100 >= coverage * (config.min_percent + 1))


def pileup(events: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """coverage, mismatches, edits and the whole percentage of mismatches (null without coverage) by position."""
    counts = events.groupBy(*by).agg(F.sum("cov").alias("coverage"), F.sum("mm").alias("mismatches"), F.sum("edit").alias("edits"))
    return counts.withColumn("percent", F.when(F.col("coverage") > 0, F.expr("mismatches * 100 div nullif(coverage, 0)")))


def columns(events: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """n_reads and the bases that cover each position, in order of arrival (insertions are left out)."""
    seen = F.array_sort(F.collect_list(F.struct(*ARRIVAL, "allele")))
    return events.where("cov = 1").groupBy(*by).agg(F.count("*").alias("n_reads"), F.array_join(F.transform(seen, lambda x: x["allele"]), "").alias("bases"))


def pileup_scan(
    reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig(min_mapq=-1),
    max_depth: int = 8000, exclude_flags: int = 0x704, require_flags: int = 0, min_base_quality: int = 13,
) -> DataFrame:
    """contig, pos, n_reads, bases: columns() of the reads and bases that pass, of each position the first ``max_depth`` to arrive.

    By default unmapped, secondary, failed and duplicate reads are left out.  Bases under ``min_base_quality`` are, too; those without a quality, deletions and skips
    stay.  A position's first bases are chosen in each run of reads, then the runs before a run tell how many of its own stay, so no list is longer than ``max_depth``.
    """
    return piece_columns(P.read_pieces(by_flags(reads, exclude_flags, require_flags), reference, block_size, config), max_depth, min_base_quality)


def piece_columns(pieces: DataFrame, max_depth: int | None = None, min_base_quality: int | None = None) -> DataFrame:
    """columns() from read_pieces(); of each position the first ``max_depth`` bases, if it is given, and if pieces have qualities, of those that ``min_base_quality`` leaves.

    A run of reads gives each position one row with its bases as a string; the runs before a run tell how many of its own stay.
    """

    def count(rows: pa.Table) -> pa.Table:
        tables = [_column_rows(found, max_depth, min_base_quality) for found in P.parts(rows)]
        return pa.concat_tables([t.append_column("part", pa.array(np.full(t.num_rows, i), pa.int32())) for i, t in enumerate(tables)])

    in_run = pieces.groupBy("contig", "bin", "run").applyInArrow(count, "contig string, pos int, run long, n long, bases string, part int")
    if max_depth is not None:
        before = F.coalesce(F.sum("n").over(Window.partitionBy("pos", "contig").orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        in_run = in_run.withColumn("left", max_depth - before).where("left > 0").withColumn("bases", F.substring("bases", F.lit(1), F.col("left").cast("int"))).withColumn("n", F.least("n", "left"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "part", "bases"))), lambda x: x["bases"]), "")
    return in_run.groupBy("pos", "contig").agg(F.sum("n").alias("n_reads"), joined.alias("bases")).select(*SITE, "n_reads", "bases")


def _column_rows(found: P.Bases, max_depth: int | None, min_base_quality: int | None) -> pa.Table:
    """contig, pos, run, n, bases: the bases of each position of a bin, as a string in order of arrival."""
    at, base = found.at, found.base
    if found.qual is not None and min_base_quality is not None:
        at, base = at[found.qual >= min_base_quality], base[found.qual >= min_base_quality]
    order, _, nth = _places(at)
    if max_depth is not None:
        order = order[nth[order] < max_depth]
    n = np.bincount(at[order], minlength=WIDTH)
    places = np.flatnonzero(n)
    ends = np.concatenate([[0], np.cumsum(n[places])]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(base[order].tobytes())).cast(pa.string())
    contig, run = (found.key(c, len(places)) for c in ("contig", "run"))
    return pa.table({"contig": contig, "pos": pa.array(found.start + places, pa.int32()), "run": run, "n": pa.array(n[places], pa.int64()), "bases": text})


def mismatching_reads(events: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """read_names: array of the reads with a mismatch at each position, in order of arrival (``events`` must keep read_name)."""
    seen = F.array_sort(F.collect_list(F.struct(*ARRIVAL, "read_name")))
    return events.where("mm = 1").groupBy(*by).agg(F.transform(seen, lambda x: x["read_name"]).alias("read_names"))


def covered_reference(events: DataFrame) -> DataFrame:
    """contig, pos, ref_base of every position that an aligned read spans."""
    return events.where("cov = 1").groupBy(*SITE).agg(F.min("ref_base").alias("ref_base"))


def covered_by_pieces(pieces: DataFrame) -> DataFrame:
    """covered_reference() from read_pieces(): a row per position from each run of reads in a bin."""

    def spanned(rows: pa.Table) -> pa.Table:
        under = np.zeros(WIDTH, np.uint8)
        for found in P.parts(rows):
            under[found.at] = found.ref
        places = np.flatnonzero(under)
        contig = rows.column("contig").combine_chunks().take(pa.array(np.zeros(len(places), np.int64)))
        return pa.table({"contig": contig, "pos": pa.array(rows.column("bin")[0].as_py() * WIDTH + places, pa.int32()), "ref_base": P.letters(under[places])})

    found = pieces.groupBy("contig", "bin", "run").applyInArrow(spanned, "contig string, pos int, ref_base string")
    return found.groupBy("pos", "contig").agg(F.min("ref_base").alias("ref_base")).select(*SITE, "ref_base")


def allele_histogram(events: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """freq and first_seen of every allele that differs from the reference, by position and class."""
    return events.where("mm = 1").groupBy(*by, "ref_base", "cls", "allele").agg(F.count("*").alias("freq"), F.min(F.struct(*ARRIVAL)).alias("first_seen"))


def _binned(sparse: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sparse events cut at the borders of bins of positions: ``bin``, ``run`` (of the reads, by read_ord), and ``from`` and ``to`` inside the bin."""
    start, stop = F.col("pos") - F.col("bin") * WIDTH, F.col("stop") - F.col("bin") * WIDTH
    rows = sparse.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / WIDTH), F.floor((F.col("stop") - 1) / WIDTH))))
    return rows.select("*", F.shiftright("read_ord", RUN_BITS).alias("run"), F.greatest(start, F.lit(0)).cast("int").alias("from"), F.least(stop, F.lit(WIDTH)).cast("int").alias("to"))


def position_totals(sparse: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """``by`` (contig and pos, and what else), stop, coverage, mismatches, edits: stretches of equal coverage, with the mismatches at their first position.

    A stretch of a read counts at its ends only, and ends are summed before the shuffle; then a bin has a row for each of its positions at most.
    """
    keys = [c for c in by if c != "pos"]
    at = lambda place, coverage, mismatch, edit: F.struct(place.alias("at"), coverage.alias("coverage"), mismatch.alias("mismatches"), edit.alias("edits"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.array(at(F.col("from"), one, none, none), at(F.col("to"), -one, none, none))
    points = F.when(F.col("cls").isNull(), ends).otherwise(F.array(at(F.col("from"), none, one, (F.col("allele") != DELETED).cast("long"))))
    summed = _binned(sparse, keys).select(*keys, "bin", F.inline(points)).groupBy(*keys, "bin", "at").agg(F.sum("coverage").alias("change"), F.sum("mismatches").alias("mismatches"), F.sum("edits").alias("edits"))
    along = Window.partitionBy(*keys, "bin").orderBy("at")
    stop = F.coalesce(F.lead("at").over(along), F.lit(WIDTH))
    found = summed.withColumn("coverage", F.sum("change").over(along)).withColumn("stop", stop).where((F.col("at") < WIDTH) & ((F.col("coverage") > 0) | (F.col("mismatches") > 0)))
    place = lambda c: (F.col("bin") * WIDTH + F.col(c)).cast("int").alias({"at": "pos"}.get(c, c))
    return found.select(*keys, place("at"), place("stop"), "coverage", "mismatches", "edits")


def sparse_pileup(sparse: DataFrame, by: Sequence[str] = SITE) -> DataFrame:
    """pileup() from sparse_events(): no row per base of a read, only one per position."""
    totals = position_totals(sparse, by)
    covered = F.when(F.col("coverage") > 0, F.sequence("pos", F.col("stop") - 1)).otherwise(F.array("pos"))
    first = F.col("each") == F.col("pos")
    each = totals.withColumn("each", F.explode(covered)).select(*[F.col("each").alias(c) if c == "pos" else c for c in by], "coverage", *[F.when(first, F.col(c)).otherwise(0).alias(c) for c in ("mismatches", "edits")])
    return each.withColumn("percent", F.when(F.col("coverage") > 0, F.expr("mismatches * 100 div nullif(coverage, 0)")))


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _totals(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    """The coverage and the mismatches that a run gives each position of a bin."""
    start, stop = _numbers(table, "from", "to")
    one = table.column("cls").is_valid().to_numpy()
    change = np.bincount(start[~one], minlength=WIDTH + 1) - np.bincount(stop[~one], minlength=WIDTH + 1)
    lists = [pa.array([x[:WIDTH].tolist()], pa.list_(pa.int64())) for x in (np.cumsum(change), np.bincount(start[one], minlength=WIDTH))]
    return pa.table([*(table.column(c).slice(0, 1).combine_chunks() for c in (*keys, "bin", "run")), *lists], [*keys, "bin", "run", "cov", "mm"])


def _carried(table: pa.Table) -> pa.Table:
    """What the runs before each run of a bin have given."""
    table = table.sort_by("run")
    before = [np.vstack(table.column(c).to_pylist()).cumsum(axis=0)[:-1] for c in ("cov", "mm")]
    return table.slice(1).drop_columns(["cov", "mm"]).append_column("cov", pa.array(before[0].tolist(), pa.list_(pa.int64()))).append_column("mm", pa.array(before[1].tolist(), pa.list_(pa.int64())))


#: Covered positions that are laid out at once.
_LAID_OUT = 1 << 21


def running_counts(start: np.ndarray, stop: np.ndarray, one: np.ndarray, cov: np.ndarray, mm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of arrival, mismatches (``one``) at ``start`` and stretches [start, stop): coverage and mismatches that each mismatch finds at its position, itself included.

    ``cov`` and ``mm`` have what earlier runs gave each position.  A stretch is laid out as its positions; these are sorted by position and arrival, and a mismatch
    looks for its own place among them.  Long runs are laid out in parts, and each part hands its totals on.
    """
    places = np.flatnonzero(one)
    n_cov, n_mm = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    by_place = np.argsort(start[places], kind="stable")
    sorted_at = start[places][by_place]
    n_mm[by_place] = np.arange(len(places)) - np.searchsorted(sorted_at, sorted_at) + 1 + mm[sorted_at]
    size = np.where(one, 0, stop - start)
    ends, done, cov = np.cumsum(size), 0, cov.copy()
    while done < len(size):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _LAID_OUT, "right")))
        rows = np.flatnonzero(size[done:until]) + done
        each = np.repeat(rows, size[rows])
        position = np.arange(len(each)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]) + start[each]
        laid = np.sort(position * (until - done) + (each - done))
        first, last = np.searchsorted(places, (done, until))
        mine = places[first:last]
        at = start[mine]
        n_cov[first:last] = np.searchsorted(laid, at * (until - done) + (mine - done)) - np.searchsorted(laid, at * (until - done)) + cov[at]
        cov += np.bincount(position, minlength=len(cov))
        done = until
    return n_cov, n_mm


def _counting(config: PileupConfig, keep: Sequence[str]):
    """The mismatches of a run in a bin, with ``ok``: whether their position passes the limits when they arrive."""

    def count(rows: pa.Table, carry: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("cls").is_valid().to_numpy(), *_numbers(rows, *reversed(ARRIVAL))))
        rows = rows.take(pa.array(order))
        start, stop = _numbers(rows, "from", "to")
        one = rows.column("cls").is_valid().to_numpy()
        cov, mm = (np.array(carry.column(c)[0].as_py()) for c in ("cov", "mm")) if carry.num_rows else (np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64))
        n_cov, n_mm = running_counts(start, stop, one, cov, mm)
        ok = (n_mm > config.min_mismatches) & (n_cov > config.min_coverage) & (n_mm * 100 >= n_cov * (config.min_percent + 1))
        return rows.select(list(keep)).filter(pa.array(one)).append_column("ok", pa.array(ok))

    return count


def _counted(sparse: DataFrame, config: PileupConfig, by: Sequence[str]) -> DataFrame:
    """The mismatches with ``ok``: whether their position passes the limits when they arrive.

    A task counts one run of reads in one bin of positions, so a deep bin is as many tasks as it has runs.  Where a bin has several, their totals are summed
    along the runs first and carried into each.  Sparse events are written once, since they are read for the runs, the totals and the counts.
    """
    keys = [c for c in by if c != "pos"]
    rows = _binned(cut(sparse), keys)
    several = rows.groupBy(*keys, "bin").agg(F.min("run").alias("first"), F.max("run").alias("last")).where("first < last").select(*keys, "bin")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    group = ", ".join(f"`{c}` {kind[c]}" for c in (*keys, "bin", "run"))
    arrays = f"{group}, cov array<long>, mm array<long>"
    totals = rows.join(several, [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "run").applyInArrow(lambda table: _totals(table, keys), arrays)
    carry = totals.groupBy(*keys, "bin").applyInArrow(_carried, arrays)
    keep = [c for c in sparse.columns if c != "stop"]
    counted = rows.groupBy(*keys, "bin", "run").cogroup(carry.groupBy(*keys, "bin", "run"))
    return counted.applyInArrow(_counting(config, keep), ", ".join(f"`{c}` {kind[c]}" for c in keep) + ", ok boolean")


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by position in a bin, how many rows stand at smaller positions, and how many come before each row at its own."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # by digits, since these are short
    n = np.bincount(at, minlength=WIDTH)
    smaller = np.cumsum(n) - n
    nth = np.empty(len(at), np.int64)
    nth[order] = np.arange(len(at)) - smaller[at[order]]
    return order, smaller, nth


def _piece_counts(found: P.Bases) -> tuple[np.ndarray, np.ndarray]:
    """The coverage and the mismatches that pieces give each position of their bin."""
    return np.bincount(found.at, minlength=WIDTH), np.bincount(found.at[found.differs], minlength=WIDTH) + np.bincount(found.in_at, minlength=WIDTH)


def _piece_totals(table: pa.Table, keys: Sequence[str], laid_out: int) -> pa.Table:
    """_totals() of pieces."""
    both = [sum(x) for x in zip(*(_piece_counts(found) for found in P.parts(table, laid_out)), strict=True)]
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in both]
    return pa.table([*(table.column(c).slice(0, 1).combine_chunks() for c in (*keys, "bin", "run")), *lists], [*keys, "bin", "run", "cov", "mm"])


def _piece_mismatches(found: P.Bases, cov: np.ndarray, mm: np.ndarray, config: PileupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bases that differ and then the insertions, taken in order of arrival: that order, and of each its position in the bin, row, operation, and whether its position passes the limits as it arrives.

    A base's place among those of its position is its coverage, an insertion looks for its place among them.
    """
    differs, size = np.flatnonzero(found.differs), len(found.pieces.read_ord)
    order, smaller, nth = _places(found.at)
    covered = nth[differs] + 1
    if len(found.in_at):
        among = found.at[order] * size + found.row[order]
        covered = np.concatenate([covered, np.searchsorted(among, found.in_at * size + found.in_row, "right") - smaller[found.in_at]])
    at, op_idx, row = (np.concatenate([a[differs], b]) for a, b in ((found.at, found.in_at), (found.op_idx, found.in_op), (found.row, found.in_row)))
    arrival = np.argsort(row * (op_idx.max(initial=0) + 1) + op_idx, kind="stable")
    covered, at, op_idx, row = (x[arrival] for x in (covered, at, op_idx, row))
    n_cov, n_mm = covered + cov[at], _places(at)[2] + 1 + mm[at]
    return arrival, at, row, op_idx, (n_mm > config.min_mismatches) & (n_cov > config.min_coverage) & (n_mm * 100 >= n_cov * (config.min_percent + 1))


def _piece_positions(found: P.Bases, cov: np.ndarray, mm: np.ndarray, config: PileupConfig, keys: Sequence[str]) -> pa.Table:
    """The positions that pass the limits at one of the mismatches that pieces show."""
    _, at, _, _, ok = _piece_mismatches(found, cov, mm, config)
    places = np.flatnonzero(np.bincount(at[ok], minlength=WIDTH))
    return pa.table({c: found.key(c, len(places)) for c in keys} | {"pos": pa.array(found.start + places, pa.int32())})


def _piece_alleles(found: P.Bases, cov: np.ndarray, mm: np.ndarray, config: PileupConfig, keys: Sequence[str]) -> pa.Table:
    """The alleles that pieces show: freq, the read and operation that show each first, and whether its position passes the limits when one of them arrives."""
    arrival, at, row, op_idx, ok = _piece_mismatches(found, cov, mm, config)
    differs, named = np.flatnonzero(found.differs), found.inserted.dictionary_encode()
    ref = np.concatenate([found.ref[differs], found.in_ref])[arrival]
    cls = np.repeat([SNP_OR_DELETION, INSERTION], [len(differs), len(found.in_at)])[arrival]
    code = np.concatenate([found.base[differs].astype(np.int64), 256 + named.indices.to_numpy()])[arrival]
    _, first, of, n = np.unique((at * 2 + cls) * (256 + len(named.dictionary)) + code, return_index=True, return_inverse=True, return_counts=True)
    columns = {c: found.key(c, len(first)) for c in keys} | {
        "pos": pa.array(found.start + at[first], pa.int32()), "ref_base": P.letters(ref[first]), "cls": pa.array(cls[first], pa.int32()),
        "allele": pa.concat_arrays([P.LETTERS, named.dictionary]).take(pa.array(code[first])).cast(pa.string()), "freq": pa.array(n, pa.int64()),
        "read_ord": pa.array(found.pieces.read_ord[row[first]]), "op_idx": pa.array(op_idx[first], pa.int32()), "ok": pa.array(np.bincount(of, ok, len(first)) > 0),
    }
    return pa.table(columns)


def _in_parts(rows: pa.Table, cov: np.ndarray, mm: np.ndarray, config: PileupConfig, keys: Sequence[str], laid_out: int, found_in=_piece_alleles) -> list[pa.Table]:
    """The alleles, or the positions, of a run in a bin.  Long runs are laid out in parts, and each part hands its totals on."""
    tables, before = [], None
    for found in P.parts(rows, laid_out):
        if before is not None:
            more = _piece_counts(before)
            cov, mm = cov + more[0], mm + more[1]
        tables.append(found_in(found, cov, mm, config, keys))
        before = found
    return tables


def _piece_counting(config: PileupConfig, keys: Sequence[str], laid_out: int, found_in=_piece_alleles):
    """The alleles, or the positions, of one of several runs in a bin; ``carry`` has what the runs before it give."""

    def count(rows: pa.Table, carry: pa.Table) -> pa.Table:
        cov, mm = (np.array(carry.column(c)[0].as_py()) for c in ("cov", "mm")) if carry.num_rows else (np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64))
        return pa.concat_tables(_in_parts(rows, cov, mm, config, keys, laid_out, found_in))

    return count


def _piece_placing(config: PileupConfig, keys: Sequence[str], laid_out: int):
    """The positions of a bin that has one run; a position that passes in two parts of it comes once."""

    def place(rows: pa.Table) -> pa.Table:
        tables = _in_parts(rows, np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64), config, keys, laid_out, _piece_positions)
        return tables[0] if len(tables) == 1 else pa.concat_tables(tables).group_by([*keys, "pos"]).aggregate([])

    return place


def _piece_ranking(config: PileupConfig, keys: Sequence[str], laid_out: int, shown: Sequence[str]):
    """The ranked alleles of a bin that has one run, as _ranked() gives them."""

    def rank(rows: pa.Table) -> pa.Table:
        found = pa.concat_tables(_in_parts(rows, np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64), config, keys, laid_out)).combine_chunks()
        named = found.column("allele").combine_chunks().dictionary_encode()
        pos, cls, freq, read_ord, op_idx = _numbers(found, "pos", "cls", "freq", "read_ord", "op_idx")
        ok, code = found.column("ok").to_numpy(), (pos * 2 + cls) * max(len(named.dictionary), 1) + named.indices.to_numpy()
        _, first, of = np.unique(code, return_index=True, return_inverse=True)  # the parts are in order of arrival, so that the first is the one to keep
        freq, at = np.bincount(of, freq, len(first)).astype(np.int64), pos - pos.min(initial=0)
        passed = np.flatnonzero((np.bincount(at, ok, at.max(initial=0) + 1) > 0)[at[first]])
        first, freq = first[passed], freq[passed]
        order = np.lexsort((op_idx[first], read_ord[first], freq if config.allele_order == "rarest" else -freq, code[first] // max(len(named.dictionary), 1)))
        first, freq = first[order], freq[order]
        place = pos[first] * 2 + cls[first]
        rnk = np.arange(len(place)) - np.searchsorted(place, place) + 1
        chosen = found.take(pa.array(first)).set_column(found.column_names.index("freq"), "freq", pa.array(freq)).append_column("rnk", pa.array(rnk, pa.int32()))
        return chosen.filter(pa.array(rnk <= config.ploidy)).select(list(shown))

    return rank


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kind[c]}" for c in names)


#: Bins, a row of some 40 bytes each, up to which those with several runs are broadcast.
_FEW_BINS = 100_000


def _by_runs(pieces: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The pieces of the bins that have one run, and those of the bins that have several, if there are any; packed pieces are written already, others are here."""
    rows = pieces if "heads" in pieces.columns else cut(pieces)
    several = cut(rows.groupBy("bin", *keys).agg(F.min("run").alias("first"), F.max("run").alias("last")).where("first < last").select(*keys, "bin"))
    n = several.count()
    if not n:
        return rows, None
    here = F.broadcast(several) if n <= _FEW_BINS else several.hint("merge")
    return rows.join(here, [*keys, "bin"], "left_anti"), cut(rows.join(here, [*keys, "bin"], "left_semi"))


def _counted_runs(deep: DataFrame, config: PileupConfig, keys: Sequence[str], laid_out: int, kinds: str, found_in=_piece_alleles) -> DataFrame:
    """What a task finds in each run of bins with several; their totals are summed along the runs first and carried into each."""
    group = [*keys, "bin", "run"]
    arrays = f"{_kinds(deep, group)}, cov array<long>, mm array<long>"
    totals = deep.groupBy(*group).applyInArrow(lambda table: _piece_totals(table, keys, laid_out), arrays)
    carry = totals.groupBy(*keys, "bin").applyInArrow(_carried, arrays)
    return deep.groupBy(*group).cogroup(carry.groupBy(*group)).applyInArrow(_piece_counting(config, keys, laid_out, found_in), kinds)


def _ranked_pieces(pieces: DataFrame, config: PileupConfig, by: Sequence[str]) -> DataFrame:
    """candidate_alleles() from read_pieces() or packed_pieces().

    The pieces of a bin with one run are counted and ranked by one task, and only ranked alleles leave it.  Bins with several are counted run by run, with what the runs
    before give carried into each, and their alleles are summed and ranked in Spark.
    """
    keys, laid_out = [c for c in by if c != "pos"], P.LAID_OUT
    single, deep = _by_runs(pieces, keys)
    shown = [*by, "ref_base", "cls", "allele", "freq", "rnk"]
    kinds = {"pos": "int", "ref_base": "string", "cls": "int", "allele": "string", "freq": "long", "rnk": "int"} | {f.name: f.dataType.simpleString() for f in single.schema if f.name in keys}
    ranked = single.groupBy("bin", *keys).applyInArrow(_piece_ranking(config, keys, laid_out, shown), ", ".join(f"`{c}` {kinds[c]}" for c in shown))
    if deep is None:
        return ranked
    counted = f"{_kinds(deep, keys)}, pos int, ref_base string, cls int, allele string, freq long, read_ord long, op_idx int, ok boolean"
    found = _counted_runs(deep, config, keys, laid_out, counted).repartition(*by)
    # rows are sorted by these columns, numbers first
    alleles = found.groupBy("pos", "cls", "allele", *keys, "ref_base").agg(F.sum("freq").alias("freq"), F.min(F.struct(*ARRIVAL)).alias("first_seen"), F.max("ok").alias("ok"))
    return ranked.union(_ranked(alleles, config, by))


def _placed_pieces(pieces: DataFrame, config: PileupConfig, by: Sequence[str]) -> DataFrame:
    """candidate_positions() from read_pieces() or packed_pieces(): only positions leave the tasks, and only those of bins with several runs, which may repeat, are compared."""
    keys, laid_out = [c for c in by if c != "pos"], P.LAID_OUT
    single, deep = _by_runs(pieces, keys)
    kinds = f"{_kinds(single, keys)}, pos int"
    placed = single.groupBy("bin", *keys).applyInArrow(_piece_placing(config, keys, laid_out), kinds).select(*by)
    return placed if deep is None else placed.union(_counted_runs(deep, config, keys, laid_out, kinds, _piece_positions).select(*by).distinct())


def candidate_positions(sparse: DataFrame, config: PileupConfig = PileupConfig(), by: Sequence[str] = SITE) -> DataFrame:
    """Distinct positions that pass the limits, from sparse_events(), or from read_pieces() with "running".

    "running" is order dependent: a position stays in once it passed at some mismatch, even if later reads dilute it,
    and one whose last mismatch came too early never passes.  "final" tests totals.
    """
    if config.threshold == "final":
        totals = position_totals(sparse, by).where("mismatches > 0")
        return totals.where(over_limits(F.col("mismatches"), F.col("coverage"), config)).select(*by)
    if "ops" in sparse.columns:
        return _placed_pieces(sparse, config, by)
    return _counted(sparse, config, by).where("ok").select(*by).distinct()


def candidate_alleles(sparse: DataFrame, config: PileupConfig = PileupConfig(), by: Sequence[str] = SITE) -> DataFrame:
    """contig, pos, ref_base, cls, allele, freq, rnk: up to ``ploidy`` alleles per class of every candidate position, from sparse_events(), or from read_pieces() with "running".

    Equal counts go by first appearance.  Mismatches are counted by allele before they are shuffled by position.
    """
    if "ops" in sparse.columns:
        return _ranked_pieces(sparse, config, by)
    if config.threshold == "final":
        sparse = cut(sparse)
        found = sparse.where("cls is not null").join(candidate_positions(sparse, config, by), list(by), "left_semi").withColumn("ok", F.lit(True))
    else:
        found = _counted(sparse, config, by)
    alleles = found.groupBy(*by, "ref_base", "cls", "allele").agg(F.count("*").alias("freq"), F.min(F.struct(*ARRIVAL)).alias("first_seen"), F.max("ok").alias("ok"))
    return _ranked(alleles, config, by)


def _ranked(alleles: DataFrame, config: PileupConfig, by: Sequence[str]) -> DataFrame:
    """The first ``ploidy`` alleles of each class, at positions where one of them is ok."""
    shown, by = [*by, "ref_base", "cls", "allele", "freq", "rnk"], sorted(by, key=lambda c: c != "pos")  # sorts compare the position first, then the few contigs
    passed = alleles.withColumn("ok", F.max("ok").over(Window.partitionBy(*by))).where("ok")
    order = F.col("freq").asc() if config.allele_order == "rarest" else F.col("freq").desc()
    rank = F.row_number().over(Window.partitionBy(*by, "cls").orderBy(order, "first_seen"))
    return passed.withColumn("rnk", rank).where(F.col("rnk") <= config.ploidy).select(*shown)


def candidate_sites(alleles: DataFrame) -> DataFrame:
    """contig, pos, ref_base, in_alleles, snp_alleles: both lists of (allele, freq) by rank, at most ``ploidy`` each."""
    of = lambda cls: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("cls", "rnk", "allele", "freq")), lambda x: x["cls"] == cls)), lambda x: F.struct(x["allele"].alias("allele"), x["freq"].alias("freq")))
    # rows are sorted by these columns, numbers first
    return alleles.groupBy("pos", "contig", "ref_base").agg(of(INSERTION).alias("in_alleles"), of(SNP_OR_DELETION).alias("snp_alleles")).select(*SITE, "ref_base", "in_alleles", "snp_alleles")
