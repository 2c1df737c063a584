"""Reads cut at bins of positions, each piece with the reference under it: a row per read and bin, whatever its bases say.

Spark filters, shuffles and joins the pieces; numpy compares the bases of many pieces at once inside tasks.  The columns: contig, what is kept, ``bin``,
``run`` (of the reads, by read_ord), read_ord, op_idx (of its first operation), ``from`` (in the bin), ``ops`` (lengths and operations as BAM has them),
``seq``, perhaps ``qual``, and ``ref``, which starts a base before the piece and has a blank where there is no reference.

packed_pieces() has a row for the pieces that reads next to each other have in a bin and run, so that Spark moves bytes and not a row per read: ``ords`` (read_ord),
``heads`` (op_idx, from, how many operations and bases), ``ops`` and ``seq``, all end to end, and the bin's ``window``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..session import cut
from .reads import valid_reads, well_mapped

#: Positions in a bin; reads in a run, as a power of two of read_ord.
WIDTH, RUN_BITS = 1024, 16

_M, _I = 0, 1
_KIND = np.full(256, 8, np.int8)  # the operations MIDNSHP by number, 7 for digits, 8 for all else
_KIND[np.frombuffer(b"MIDNSHP", np.uint8)] = range(7)
_KIND[48:58] = 7
_ON_REFERENCE, _ON_READ = np.isin(np.arange(9), (0, 2, 3)), np.isin(np.arange(9), (0, 1, 4))
_BLANK, _STAR = 32, 42
LETTERS = pa.array([chr(i) for i in range(256)], pa.large_string())


def _text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each starts and ends among them."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = whole.cast(pa.large_string())
    _, at, data = whole.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(at, np.int64)[whole.offset : whole.offset + len(whole) + 1] if at else np.zeros(1, np.int64)


def _within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``size`` places of each row: the row, and which of its places it is."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of the bytes from each start on."""
    row, k = _within(size)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[start[row] + k].tobytes()))


def parsed(cigar: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The read, kind and length of every operation of these CIGARs, and which CIGARs have only known operations."""
    data, at = _text(cigar)
    text, at = data[at[0] : at[-1]], at - at[0]
    kind = _KIND[text]
    ends = np.flatnonzero(kind != 7)
    read = np.searchsorted(at, ends, "right") - 1
    digits = ends - np.maximum(np.concatenate([[-1], ends[:-1]])[: len(ends)] + 1, at[read])
    n = np.zeros(len(ends), np.int64)
    for k in range(9):
        n += np.where(digits > k, (text[np.maximum(ends - 1 - k, 0)].astype(np.int64) - 48) * 10**k, 0)
    good = (kind[ends] < 7) & (digits > 0) & (digits < 10)
    ok = at[1:] > at[:-1]
    ok[ok] = kind[at[1:][ok] - 1] != 7
    return read, kind[ends], n, ok & (np.bincount(read[~good], minlength=len(ok)) == 0)


@dataclass
class Cuts:
    """The pieces of a batch: the read ``of`` each, its bin, first operation, place in the bin, covered positions, and what it has of ``coded`` (operations) and ``bases``."""

    of: np.ndarray
    order: np.ndarray
    bin: np.ndarray
    op_idx: np.ndarray
    start: np.ndarray
    covered: np.ndarray
    op_at: np.ndarray
    n_ops: np.ndarray
    coded: np.ndarray
    base_at: np.ndarray
    n_bases: np.ndarray
    bases: np.ndarray
    read_at: np.ndarray


def _cuts(batch: pa.RecordBatch) -> Cuts:
    """The pieces of reads; reads that can't be walked have none.  Each distinct CIGAR is read once."""
    cigars = batch.column("cigar").dictionary_encode()
    of_kind, op_kind, n_kind, ok_kind = parsed(cigars.dictionary)
    kind = cigars.indices.fill_null(-1).to_numpy()
    start, order = (batch.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("ref_start", "read_ord"))
    data, at = _text(batch.column("seq"))
    used = np.bincount(of_kind, np.where(_ON_READ[op_kind], n_kind, 0), minlength=len(ok_kind)).astype(np.int64)
    ok = np.concatenate([ok_kind, [False]])[kind] & (start >= 0) & (np.concatenate([used, [-1]])[kind] == at[1:] - at[:-1]) & batch.column("seq").is_valid().to_numpy(zero_copy_only=False)
    n_kinds = np.bincount(of_kind, minlength=len(ok_kind))
    walked = np.flatnonzero(ok)
    row, nth = _within(n_kinds[kind[walked]])
    read, its = walked[row], (np.cumsum(n_kinds) - n_kinds)[kind[walked]][row] + nth
    op, n = op_kind[its], n_kind[its]
    first_kind = (np.cumsum(n_kinds) - n_kinds)[of_kind]

    def before(x: np.ndarray) -> np.ndarray:
        c = np.cumsum(x) - x
        return (c - c[first_kind])[its]

    spans = _ON_REFERENCE[op] & (n > 0)
    place = start[read] + before(np.where(_ON_REFERENCE[op_kind], n_kind, 0))
    in_read = before(np.where(_ON_READ[op_kind], n_kind, 0))
    low = np.where(spans, place, np.where(op == _I, place - 1, np.maximum(place - 1, start[read])))  # an insertion stands at the base before it
    high = np.where(spans, place + n, low + 1)
    each, k = _within((high - 1) // WIDTH - low // WIDTH + 1)
    if len(each) > len(read):
        bins = low[each] // WIDTH + k
        left = np.maximum(low[each], bins * WIDTH)
        op, read, spans, nth = op[each], read[each], spans[each], nth[each]
        size = np.where(spans, np.minimum(high[each], (bins + 1) * WIDTH) - left, n[each])
        place = np.where(spans, left, place[each])
        base = in_read[each] + np.where(spans & (op == _M), place - low[each], 0)
    else:
        bins, size, base = low // WIDTH, n, in_read
    head = np.flatnonzero(np.concatenate([[True], (read[1:] != read[:-1]) | (bins[1:] != bins[:-1])])[: len(read)])
    ends = np.concatenate([head[1:], [len(read)]])[: len(head)]
    said = np.add.reduceat((spans | (op == _I) & (size > 0)).astype(np.int64), head) > 0 if len(head) else np.zeros(0, bool)
    covered = np.add.reduceat(np.where(spans, size, 0), head) if len(head) else np.zeros(0, np.int64)
    on = said & (bins[head] >= 0)
    head, ends, of = head[on], ends[on], read[head][on]
    length = (base + np.where(_ON_READ[op], size, 0))[ends - 1] - base[head]
    coded = np.where(_ON_REFERENCE[op] | _ON_READ[op], size, 0) << 4 | op  # of what is neither in the read nor on the reference any number may be clipped
    return Cuts(of, order[of], bins[head], nth[head], place[head] - bins[head] * WIDTH, covered[on], head, ends - head, coded, at[of] + base[head], length, data, base[head])


def _cut(batch: pa.RecordBatch, keep: Sequence[str], run_bits: int = RUN_BITS) -> pa.RecordBatch:
    """A row for each piece."""
    c = _cuts(batch)
    row, k = _within(c.n_ops)
    ops = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c.n_ops)]), pa.int32()), pa.array(c.coded[c.op_at[row] + k], pa.int32()))
    chosen = pa.array(c.of)
    columns = {name: batch.column(name).take(chosen) for name in ("contig", *keep)} | {
        "bin": pa.array(c.bin), "run": pa.array(c.order >> run_bits), "read_ord": pa.array(c.order), "op_idx": pa.array(c.op_idx, pa.int32()),
        "from": pa.array(c.start, pa.int32()), "size": pa.array(c.covered, pa.int32()), "ops": ops, "seq": _slices(c.bases, c.base_at, c.n_bases).cast(pa.string()),
    }
    if "qual" in batch.schema.names:
        marks, its = _text(batch.column("qual"))
        at = _text(batch.column("seq"))[1]
        fits = (its[1:] - its[:-1] == at[1:] - at[:-1])[c.of]
        columns["qual"] = _slices(marks, its[c.of] + c.read_at, np.where(fits, c.n_bases, 0)).cast(pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _end_to_end(values: np.ndarray, per: np.ndarray) -> pa.Array:
    """Binaries of the bytes of so many values each."""
    ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _pack(batch: pa.RecordBatch, keep: Sequence[str], run_bits: int = RUN_BITS) -> pa.RecordBatch:
    """A row for the pieces that a batch has in a bin and run."""
    c = _cuts(batch)
    run = c.order >> run_bits
    named = [batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy()[c.of] for name in ("contig", *keep)]
    order = np.lexsort((run, c.bin, *named))
    new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (run, c.bin, *named)], axis=0)])[: len(order)]
    head = np.flatnonzero(new)
    per = np.diff(np.append(head, len(order)))
    n_ops, n_bases = c.n_ops[order], c.n_bases[order]
    row, k = _within(n_ops)
    ops = c.coded[c.op_at[order][row] + k].astype(np.int32)
    row, k = _within(n_bases)
    bases = c.bases[c.base_at[order][row] + k]
    heads = np.stack([c.op_idx[order], c.start[order], n_ops, n_bases], axis=1).astype(np.int32).ravel()
    summed = lambda x: np.add.reduceat(x, head) if len(head) else x
    chosen = pa.array(c.of[order][head])
    return pa.RecordBatch.from_pydict(
        {name: batch.column(name).take(chosen) for name in ("contig", *keep)}
        | {"bin": pa.array(c.bin[order][head]), "run": pa.array(run[order][head])}
        | {"ords": _end_to_end(c.order[order], per), "heads": _end_to_end(heads, per * 4), "ops": _end_to_end(ops, summed(n_ops)), "seq": _end_to_end(bases, summed(n_bases))}
    )


def windows(reference: DataFrame, block_size: int) -> DataFrame:
    """contig, bin, window: the upper-case reference of each bin, with a base before it, and blanks where there is none."""
    b = F.col("block").cast("long") * block_size
    spread = reference.select("contig", b.alias("at"), F.upper("seq").alias("seq"), F.explode(F.sequence(F.floor(b / WIDTH), F.floor((b + F.length("seq")) / WIDTH))).alias("bin")).where("seq <> ''")
    first = F.greatest(F.col("at"), F.col("bin") * WIDTH - 1)
    size = F.least(F.col("at") + F.length("seq"), (F.col("bin") + 1) * WIDTH) - first
    parts = spread.select("contig", "bin", F.struct((first - F.col("bin") * WIDTH + 1).cast("int").alias("at"), F.substring("seq", (first - F.col("at") + 1).cast("int"), size.cast("int")).alias("seq")).alias("x"))
    joined = F.aggregate(F.array_sort(F.collect_list("x")), F.lit(""), lambda acc, x: F.concat(F.rpad(acc, x["at"], F.lit(" ")), x["seq"]))
    return parts.groupBy("contig", "bin").agg(joined.alias("window"))


def _placed(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig, keep: Sequence[str], columns: Sequence[str], made: Callable, shown: str, written: bool = False) -> DataFrame:
    """What ``made`` gives of batches of well mapped reads, written if it is to be, with the windows of its bins."""
    mapped = well_mapped(reads, config.min_mapq)
    mapped = (valid_reads(mapped, "raise") if config.invalid == "raise" else mapped).where("read_ord is not null")
    rows = mapped.select("contig", *keep, "read_ord", F.col("ref_start").cast("int").alias("ref_start"), "cigar", "seq", *columns)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    run_bits = RUN_BITS

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield made(batch, keep, run_bits)

    found = rows.mapInArrow(cut_up, ", ".join([f"`{c}` {kind[c]}" for c in ("contig", *keep)] + ["bin long, run long", shown]))
    return (cut(found) if written else found).join(windows(reference, block_size).hint("merge"), ["contig", "bin"])


def read_pieces(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """The pieces of well mapped reads that can be walked (``config.invalid`` has them raise, else they are left out).  Bases are single bytes."""
    qual = ["qual"] if "qual" in reads.columns else []
    shown = ", ".join(["read_ord long, op_idx int, `from` int, size int, ops array<int>, seq string", *(f"{c} string" for c in qual)])
    placed = _placed(reads, reference, block_size, config, keep, qual, _cut, shown)
    under = F.rpad(F.substring("window", F.col("from") + 1, F.col("size") + 1), F.col("size") + 1, F.lit(" "))
    return placed.select("contig", *keep, "bin", "run", "read_ord", "op_idx", "from", "ops", "seq", *qual, under.alias("ref"))


def packed_pieces(reads: DataFrame, reference: DataFrame, block_size: int, config: PileupConfig = PileupConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """The same pieces without qualities, those of a bin and run from one batch of reads in a row; how many these are depends on how reads are sorted, the results don't.

    They are written before the windows are joined, so that what the reads shuffled is gone by then, and the join's shuffle by bin serves those who group by it.
    """
    placed = _placed(reads, reference, block_size, config, keep, (), _pack, "ords binary, heads binary, ops binary, seq binary", written=True)
    return placed.select("contig", *keep, "bin", "run", "ords", "heads", "ops", "seq", "window")


@dataclass
class Pieces:
    """The pieces of a bin in order of arrival: where the operations, bases and the reference of each start in ``coded``, ``seq`` and ``ref``; ``keys`` is a row of what they share."""

    keys: pa.Table
    read_ord: np.ndarray
    op_idx: np.ndarray
    start: np.ndarray
    n_ops: np.ndarray
    op_at: np.ndarray
    coded: np.ndarray
    seq: np.ndarray
    seq_at: np.ndarray
    ref: np.ndarray
    ref_at: np.ndarray
    size: np.ndarray
    bounds: tuple[np.ndarray, np.ndarray] | None
    marks: np.ndarray | None = None
    marks_at: np.ndarray | None = None
    marked: np.ndarray | None = None

    def chosen(self, rows: np.ndarray | slice) -> Pieces:
        some = {f.name: getattr(self, f.name) for f in fields(self)}
        each = ("read_ord", "op_idx", "start", "n_ops", "op_at", "seq_at", "ref_at", "size", "marks_at", "marked")
        bounds = self.bounds and tuple(x[rows] for x in self.bounds)
        return Pieces(**some | {c: some[c][rows] for c in each if some[c] is not None} | {"bounds": bounds})


def _bounds(table: pa.Table, per: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns ``first`` and ``last``, if there are any, bound the positions."""
    if "first" not in table.column_names:
        return None
    offset = table.column("bin").to_numpy().astype(np.int64) * WIDTH
    both = [table.column(c).to_numpy().astype(np.int64) - offset for c in ("first", "last")]
    return tuple(np.repeat(x, per) if per is not None else x for x in both)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def in_order(table: pa.Table) -> Pieces:
    """The rows of a bin, packed or not, as pieces in order of arrival."""
    if "heads" in table.column_names:
        whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        ords = whole("ords", np.int64)
        op_idx, start, n_ops, n_bases = whole("heads", np.int32).reshape(-1, 4).T.astype(np.int64)
        ops = whole("ops", np.int32).astype(np.int64)
        size = np.where(_ON_REFERENCE[ops & 15], ops >> 4, 0)
        window = np.full(WIDTH + 2, _BLANK, np.uint8)
        known = np.frombuffer(table.column("window")[0].as_py().encode(), np.uint8)[: WIDTH + 1]
        window[: len(known)] = known
        per = np.array([len(x) // 8 for x in table.column("ords").to_pylist()], np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        found = Pieces(table.slice(0, 1), ords, op_idx, start, n_ops, _starts(n_ops), ops, whole("seq", np.uint8), _starts(n_bases), window, start, sums[np.cumsum(n_ops)] - sums[_starts(n_ops)] + 1, _bounds(table, per))
    else:
        table = table.combine_chunks()
        lists = table.column("ops").combine_chunks()
        n_ops = np.diff(lists.offsets.to_numpy()).astype(np.int64)  # flatten() below starts where the slice does
        (seq, seq_at), (ref, ref_at) = _text(table.column("seq")), _text(table.column("ref"))
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        quals = ()
        if "qual" in table.column_names:
            marks, at = _text(table.column("qual"))
            quals = (marks, at[:-1], np.diff(at) > 0)
        found = Pieces(table.slice(0, 1), number("read_ord"), number("op_idx"), number("from"), n_ops, _starts(n_ops), lists.flatten().to_numpy().astype(np.int64), seq, seq_at[:-1], ref, ref_at[:-1], np.diff(ref_at), _bounds(table), *quals)
    later = (np.diff(found.read_ord) > 0) | (np.diff(found.read_ord) == 0) & (np.diff(found.op_idx) >= 0)
    return found if later.all() else found.chosen(np.lexsort((found.op_idx, found.read_ord)))


@dataclass
class Bases:
    """What pieces say, in order of arrival: the positions that they span (``row``, ``at``, ``op_idx``, ``base``, ``ref``, ``qual``, ``aligned``) and the insertions in them."""

    pieces: Pieces
    row: np.ndarray
    at: np.ndarray
    op_idx: np.ndarray
    base: np.ndarray
    ref: np.ndarray
    qual: np.ndarray | None
    aligned: np.ndarray
    in_row: np.ndarray
    in_at: np.ndarray
    in_op: np.ndarray
    in_ref: np.ndarray
    inserted: pa.Array

    @property
    def differs(self) -> np.ndarray:
        return ~self.aligned | (self.base != self.ref)

    @property
    def start(self) -> int:
        """The bin's first position."""
        return self.pieces.keys.column("bin")[0].as_py() * WIDTH

    def key(self, name: str, n: int) -> pa.Array:
        """``n`` times what the pieces have in a column that they share."""
        return self.pieces.keys.column(name).combine_chunks().take(pa.array(np.zeros(n, np.int64)))


#: Positions that are laid out at once.
LAID_OUT = 1 << 21


def parts(table: pa.Table, laid_out: int = LAID_OUT) -> Iterator[Bases]:
    """The pieces of a bin in order of arrival, some of them at a time."""
    found = in_order(table)
    part = _starts(found.size) // laid_out
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for start, stop in zip(heads, [*heads[1:], len(part)], strict=True):
        yield bases(found.chosen(slice(start, stop)))


def bases(pieces: Pieces) -> Bases:
    """Pieces with their bases laid out."""
    row, nth = _within(pieces.n_ops)
    coded = pieces.coded[pieces.op_at[row] + nth]
    op, n = coded & 15, coded >> 4
    head = _starts(pieces.n_ops)[row]
    start, seq, ref = pieces.start, pieces.seq, pieces.ref

    def before(x: np.ndarray) -> np.ndarray:
        c = np.cumsum(x) - x
        return c - c[head]

    along, inside, nth = before(np.where(_ON_REFERENCE[op], n, 0)), before(np.where(_ON_READ[op], n, 0)), pieces.op_idx[row] + nth

    def bounded(row: np.ndarray, at: np.ndarray, under: np.ndarray) -> np.ndarray:
        there = under != _BLANK
        if pieces.bounds is None:
            return there
        low, high = pieces.bounds
        return there & (at >= low[row]) & (at <= high[row])

    spans = np.flatnonzero(_ON_REFERENCE[op] & (n > 0))
    each, k = _within(n[spans])
    of, matched = row[spans], op[spans] == _M
    at, under = (start[of] + along[spans])[each] + k, ref[(pieces.ref_at[of] + 1 + along[spans])[each] + k]
    aligned, of = matched[each], of[each]
    in_seq = (pieces.seq_at[row[spans]] + inside[spans])[each] + k
    base = np.where(aligned, seq[np.where(aligned, in_seq, 0)], _STAR) if len(seq) else np.full(len(each), _STAR, np.uint8)
    on = bounded(of, at, under)
    nths, qual = nth[spans][each], None
    if pieces.marks is not None:
        has = aligned & pieces.marked[of]
        qual = np.full(len(each), 1 << 20, np.int64)
        qual[has] = pieces.marks[((pieces.marks_at[row[spans]] + inside[spans])[each] + k)[has]].astype(np.int64) - 33
        qual = qual[on]
    if not on.all():
        of, at, nths, base, under, aligned = (x[on] for x in (of, at, nths, base, under, aligned))
    ins = np.flatnonzero((op == _I) & (n > 0))
    ins_at, ins_ref = start[row[ins]] + along[ins] - 1, ref[pieces.ref_at[row[ins]] + along[ins]]
    ins = ins[kept := bounded(row[ins], ins_at, ins_ref)]
    return Bases(
        pieces, of, at, nths, base.astype(np.uint8, copy=False), under, qual, aligned,
        row[ins], ins_at[kept], nth[ins], ins_ref[kept], _slices(seq, pieces.seq_at[row[ins]] + inside[ins], n[ins]),
    )


def letters(codes: np.ndarray) -> pa.Array:
    return LETTERS.take(pa.array(codes.astype(np.int64))).cast(pa.string())
