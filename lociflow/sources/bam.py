"""BAM files as a Spark data source, to read and to write.

``register(spark, BamSource)``, then ``spark.read.format("bam").load(path)``.  With an index (``.bai`` or ``.csi``) beside
a file, tasks share the file between the places that it gives; without one, a task looks for the first chain of records that
fit together in its part of the file.  Option ``region`` reads only the blocks that the index's bins give for it; ``bam_pushed`` does so for
filters on contig and ref_start.  Blocks are decompressed one at a time, so memory doesn't grow with the file.

``df.write.format("bam").option("contigs", "chr1:1000,chr2:500").save(path)`` writes a file and its index from each partition,
whose rows must be in the order of contigs and ref_start; they get their names when all are written.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schemas import READS
from .bgzf import Blocks, Writer, exists, files, next_block, open_path
from .binning import Builder, Region, bin_of, pushed_region, read_index, register

__all__ = ["BamSource", "PushedBamSource", "Region", "register"]

#: Fixed values of the format: CIGAR operations and bases by code.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in BASES for b in BASES]
_ARROW = pa.schema([("read_ord", pa.int64()), ("read_name", pa.string()), ("contig", pa.string()), ("ref_start", pa.int32()), ("mapq", pa.int32()), ("flag", pa.int32()), ("cigar", pa.string()), ("seq", pa.string())])


def header(path: str) -> tuple[list[str], int]:
    """The contig names, and the virtual offset of the first record."""
    blocks = Blocks(path)
    if blocks.read(4) != b"BAM\x01":
        raise OSError(f"not a BAM file: {path}")
    blocks.read(blocks.integer())
    names = []
    for _ in range(blocks.integer()):
        names.append(blocks.read(blocks.integer())[:-1].decode())
        blocks.integer()
    return names, blocks.offset


@dataclass
class BamPart(InputPartition):
    path: str
    names: list[str]
    start: int
    stop: int | None
    nth: int
    sorted: bool = False  # by contig and position, as an index requires
    searched: bool = False  # whether the start is only a byte of the file, from which the first record is looked for


#: Records in a row that must fit together for the first of them to count as one.
_CHAIN = 8


def first_record(path: str, start: int, stop: int, contigs: int) -> int | None:
    """The virtual offset of the first record that starts in blocks from byte ``start`` to before ``stop``."""
    at = next_block(path, start)
    if at is None or at >= stop:
        return None
    blocks, plain, places = Blocks(path, at << 16), bytearray(), []

    def have(n: int) -> bool:
        while len(plain) < n:
            if places and not blocks.load() or not blocks.data and places and blocks.at >= blocks.file.size():
                return False
            places.append((len(plain), blocks.start))
            plain.extend(blocks.data)
        return True

    def after(i: int) -> int:
        """The place after the record at i, or 0 if none can be there."""
        if not have(i + 37):
            return 0
        size, ref, pos, name, _, _, ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", plain, i)
        fits = -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and name and length >= 0 and size >= 32 + name + 4 * ops + length + (length + 1) // 2
        if not fits or not have(i + 36 + name):
            return 0
        text = plain[i + 36 : i + 36 + name]
        return i + 4 + size if text[-1] == 0 and all(32 < c < 127 for c in text[:-1]) else 0

    i = 0
    while have(i + 1):
        file_at = next(f for p, f in reversed(places) if p <= i)
        if file_at >= stop:
            return None
        j, n = i, 0
        while n < _CHAIN and (j := after(j)):
            n += 1
            if not have(j + 1):  # the file ends with this record
                n = _CHAIN if len(plain) == j else 0
        if n == _CHAIN:
            return file_at << 16 | i - next(p for p, f in reversed(places) if p <= i)
        i += 1
    return None


#: Fixed values of the format: bytes of a tag's value by its type, and the operations that move along the reference.
_TAG_BYTES, _ON_REFERENCE = dict(zip("AcCsSiIf", (1, 1, 1, 2, 2, 4, 4, 4), strict=True)), (0, 2, 3, 7, 8)


def _long_cigar(data: bytes, at: int) -> tuple[int, ...] | None:
    """The operations in tag CG, which holds those that are too many for a record's own field."""
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            n = struct.unpack_from("<i", data, at + 1)[0]
            if tag == b"CG":
                return struct.unpack_from(f"<{n}I", data, at + 5)
            at += 5 + n * _TAG_BYTES[chr(data[at])]
        else:
            at += _TAG_BYTES[kind]
    return None


def _record(data: bytes, names: list[str], region: Region | None = None) -> tuple | None:
    """The fields of a record, or None if it doesn't overlap the region."""
    ref, pos, name_size, mapq, _, n_ops, flag, length = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + name_size
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    bases = at + 4 * n_ops
    if n_ops == 2 and ops[0] == length << 4 | 4 and ops[1] & 15 == 3:  # a clip of the whole read and a skip stand for a long CIGAR
        ops = _long_cigar(data, bases + (length + 1) // 2 + length) or ops
    if region and pos + sum(x >> 4 for x in ops if x & 15 in _ON_REFERENCE) <= region.start:
        return None
    packed = data[bases : bases + (length + 1) // 2]
    return (
        data[32 : at - 1].decode(), names[ref] if ref >= 0 else None, pos, mapq, flag,
        "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*", "".join(map(_PAIRS.__getitem__, packed))[:length] or "*",
    )


#: Compressed bytes between two spans up to which both are read as one.
_NEAR = 1 << 16


def near_together(spans: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """The spans that an index gives for a region, those that nearly meet made one, so that a task isn't started for each bin; what lies between is of the same contig, and filtered."""
    out: list[tuple[int, int | None]] = []
    for start, stop in sorted(spans, key=lambda x: x[0]):
        if out and out[-1][1] is not None and stop is not None and (start >> 16) - (out[-1][1] >> 16) <= _NEAR:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", 64 << 20))
        self.region = Region.of(options["region"]) if "region" in options else None
        self.starts: Region | None = None  # which contig and starts the query asks for

    def partitions(self) -> list[BamPart]:
        parts: list[BamPart] = []
        wanted = self.region or self.starts
        if self.region and self.starts and self.region.contig == self.starts.contig:
            wanted = Region(self.region.contig, self.region.start, min(self.region.stop, self.starts.stop))
        for path in files(self.path, ".bam"):
            names, first = header(path)
            index = read_index(path, ".bai", ".csi")
            if index is None:
                system, where = open_path(path)
                cuts = [first, *(x << 16 for x in range(self.split_bytes, system.get_file_info(where).size, self.split_bytes) if x > first >> 16)]
                parts += [BamPart(path, names, a, b, len(parts) + i, searched=i > 0) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], None], strict=True))]
                continue
            offsets = index.offsets()
            spans = index.chunks(names.index(wanted.contig) if wanted.contig in names else -1, wanted.start, wanted.stop) if wanted else [(first, None)]
            for start, stop in near_together(spans):
                cuts = [start]
                for offset in offsets:
                    if (offset >> 16) - (cuts[-1] >> 16) >= self.split_bytes and (stop is None or offset < stop):
                        cuts.append(offset)
                parts += [BamPart(path, names, a, b, len(parts) + i, True) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], stop], strict=True))]
        return parts or [BamPart("", [], 0, 0, 0)]

    def records(self, partition: BamPart, blocks: Blocks) -> Iterator[tuple]:
        n, region, starts = 0, self.region, self.starts
        contig = region.contig if region else starts.contig if starts else None
        ref = partition.names.index(contig) if contig in partition.names else -1
        stop = min(region.stop if region else 1 << 62, starts.stop if starts and starts.contig == contig else 1 << 62)
        while partition.stop is None or blocks.offset < partition.stop:
            size = blocks.read(4)
            if len(size) < 4:
                break
            data = blocks.read(struct.unpack("<i", size)[0])
            n += 1
            if contig is not None:
                on, pos = struct.unpack_from("<ii", data)
                if ref < 0 or on != ref or pos >= stop:
                    if partition.sorted:
                        break
                    continue
                if not region and pos < starts.start:
                    continue
            found = _record(data, partition.names, region)
            if found:
                yield (partition.nth << 40 | n - 1, *found)

    def read(self, partition: BamPart) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        start = partition.start
        if partition.searched:
            start = first_record(partition.path, start >> 16, (partition.stop or 1 << 64) >> 16, len(partition.names))
            if start is None:
                return
        rows: list[tuple] = []
        for row in self.records(partition, Blocks(partition.path, start)):
            rows.append(row)
            if len(rows) >= 4096:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PushedBamReader(BamReader):
    def pushFilters(self, filters: list) -> list:
        """Filters on contig and ref_start choose blocks; Spark still applies them all."""
        self.starts = pushed_region(filters, "contig", "ref_start")
        return filters


_CODES = bytes(BASES.index(chr(c).upper()) if chr(c).upper() in BASES else 15 for c in range(256))  # unknown letters are N
_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")


def _packed_record(name: str, ref: int, pos: int, mapq: int, flag: int, cigar: str, seq: str) -> tuple[bytes, int]:
    """A record's bytes, and the position after its last; fields that aren't known get the format's defaults."""
    ops = [int(n) << 4 | OPERATIONS.index(o) for n, o in _OPERATION.findall(cigar)]
    stop, bases = pos + (sum(x >> 4 for x in ops if x & 15 in _ON_REFERENCE) or 1), "" if seq == "*" else seq
    codes = bases.encode("latin-1", "replace").translate(_CODES) + b"\0" * (len(bases) & 1)
    tags, field = b"", ops
    if len(ops) > 0xFFFF:
        tags, field = b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops), [len(bases) << 4 | 4, stop - pos << 4 | 3]
    label = name.encode()[:254] + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(label), mapq, min(bin_of(max(pos, 0), max(stop, 1)), 0xFFFF), len(field), flag, len(bases), -1, -1, 0) + label + struct.pack(f"<{len(field)}I", *field)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(bases) + tags
    return struct.pack("<i", len(body)) + body, stop


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class BamWriter(DataSourceArrowWriter):
    """A task writes its file and index under names of its own; the driver gives them their places when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite
        self.contigs = [(n, int(length)) for n, _, length in (x.strip().rpartition(":") for x in options["contigs"].split(","))]
        if not overwrite and exists(self.path) and files(self.path, ".bam"):
            raise ValueError(f"{self.path} has BAM files already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"{self.path}/_temporary-{self.job}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bam"
        system, where = open_path(name)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        out, index, refs, rows = Writer(name), Builder(len(self.contigs)), {c: i for i, (c, _) in enumerate(self.contigs)}, 0
        text = b"@HD\tVN:1.6\tSO:coordinate\n" + b"".join(f"@SQ\tSN:{c}\tLN:{n}\n".encode() for c, n in self.contigs)
        out.write(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in self.contigs))
        out.flush()
        unplaced = False
        for batch in iterator:
            for r in batch.select([f.name for f in _ARROW if f.name != "read_ord"]).to_pylist():
                rows += 1
                unknown = r["contig"] is None or r["ref_start"] is None or r["ref_start"] < 0
                ref, pos = (-1, -1) if unknown else (refs[r["contig"]], r["ref_start"])
                data, stop = _packed_record(r["read_name"] or "*", ref, pos, 255 if r["mapq"] is None else r["mapq"], r["flag"] or 0, r["cigar"] or "*", r["seq"] or "*")
                if len(out.rest) + len(data) > 65_280:
                    out.flush()
                begin = out.offset
                out.write(data)
                if unknown:
                    unplaced = True
                elif unplaced:
                    raise ValueError("rows without a position must come last")
                else:
                    index.add(ref, pos, stop, begin, out.offset)
        out.close()
        if not rows and task.partitionId():
            return Written([])
        index.write_bai(name + ".bai")
        return Written([name])

    def commit(self, messages: list[Written]) -> None:
        system, where = open_path(self.path)
        if self.overwrite and exists(self.path):
            for old in [*files(self.path, ".bam"), *files(self.path, ".bai")]:
                system.delete_file(open_path(old)[1])
        for name in (x for m in messages if m for x in m.parts):
            place = open_path(name)[1]
            final = f"{where}/{place.rsplit('/', 1)[1].rsplit('-', 1)[0]}.bam"
            system.move(place + ".bai", final + ".bai")
            system.move(place, final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, where = open_path(f"{self.path}/_temporary-{self.job}")
        if exists(f"{self.path}/_temporary-{self.job}"):
            system.delete_dir(where)


class BamSource(DataSource):
    """Options to read: path (a .bam file or a folder of them), splitBytes (compressed bytes per task), region.  To write: path (a folder), contigs (name:length, comma-separated).

    ``region`` is contig:start-stop, 0-based and half-open.  Reads have a read_ord that grows along the files, in the order of their names; where only
    parts of a file are read, it counts in these.  Written reads keep name, contig, start, mapping quality, flag, CIGAR and bases; nulls become the
    format's defaults, and reads without a position come last.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


class PushedBamSource(BamSource):
    """As BamSource, but filters on contig and ref_start choose the blocks that are read.

    Load it anew for each scan: Spark 4.1 keeps the filters that were pushed last with a loaded DataFrame, and would use
    them for its next scan too, in a self-join as in a later query.
    """

    @classmethod
    def name(cls) -> str:
        return "bam_pushed"

    def reader(self, schema) -> PushedBamReader:
        return PushedBamReader(self.options)
