"""Block-compressed VCF files (``.vcf.gz``) as a Spark data source, with their indexes (``.tbi`` or ``.csi``), to read and to write.

``register(spark, VcfSource)``, then ``spark.read.format("vcf").load(path)``; ``text.read_vcf`` reads plain files.  Tasks share a file at its blocks: a line belongs
to the task in whose blocks it starts.  Option ``region`` reads only the blocks that the index's bins give for it; ``vcf_pushed`` does so for filters on contig and pos.

``df.write.format("vcf").save(path)`` writes a file and its ``.tbi`` from each partition, whose rows must be in the order of pos, each contig in one piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bgzf import Blocks, Writer, exists, files, next_block, open_path
from .binning import Builder, Region, pushed_region, read_index, register

__all__ = ["PushedVcfSource", "VcfSource", "register"]

RAW = "rec_ord long, contig string, pos int, ref string, alt string, qual double, filter string, gt string"
_ARROW = pa.schema([("rec_ord", pa.int64()), ("contig", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string()), ("qual", pa.float64()), ("filter", pa.string()), ("gt", pa.string())])


def _fields(line: str) -> tuple:
    """contig, pos, ref, alt, qual, filter, and the genotype's text of the first sample."""
    f = line.split("\t", 10)
    try:
        qual = float(f[5])
    except ValueError:
        qual = None
    gt = None
    if len(f) > 9 and "GT" in (keys := f[8].split(":")):
        values = f[9].split(":")
        gt = values[keys.index("GT")] if keys.index("GT") < len(values) else None
    return f[0], int(f[1]), f[3], f[4], qual, f[6], gt


@dataclass
class VcfPart(InputPartition):
    path: str
    start: int
    stop: int | None  # lines that start before it (``whole``) or up to it are this part's
    nth: int
    whole: bool = True  # whether a line starts at ``start``
    sorted: bool = False


class VcfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", 64 << 20))
        self.region = Region.of(options["region"]) if "region" in options else None
        self.starts: Region | None = None

    def partitions(self) -> list[VcfPart]:
        parts: list[VcfPart] = []
        wanted = self.region or self.starts
        for path in files(self.path, ".vcf.gz", ".vcf.bgz"):
            index = read_index(path, ".tbi", ".csi") if wanted else None
            if index:
                ref = index.names.index(wanted.contig) if wanted.contig in index.names else -1
                parts += [VcfPart(path, a, b, len(parts) + i, sorted=True) for i, (a, b) in enumerate(index.chunks(ref, wanted.start, wanted.stop))]
                continue
            system, where = open_path(path)
            places = (next_block(path, x) for x in range(self.split_bytes, system.get_file_info(where).size, self.split_bytes))
            cuts = [0, *sorted({x << 16 for x in places if x})]
            parts += [VcfPart(path, a, b, len(parts) + i, whole=not i) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], None], strict=True))]
        return parts or [VcfPart("", 0, 0, 0)]

    def records(self, part: VcfPart, blocks: Blocks) -> Iterator[tuple]:
        if not part.whole:
            blocks.line()  # the part before has it
        region, wanted, n = self.region, self.region or self.starts, 0
        while True:
            at = blocks.offset
            if part.stop is not None and (at >= part.stop if part.sorted else at > part.stop):
                return
            line = blocks.line()
            if line is None:
                return
            if not line or line[:1] == b"#":
                continue
            n += 1
            if wanted:
                contig, pos = line.split(b"\t", 2)[:2]
                if contig.decode() != wanted.contig or int(pos) - 1 >= wanted.stop:
                    if part.sorted:
                        return
                    continue
            row = _fields(line.decode())
            if region and row[1] - 1 + len(row[2]) <= region.start:
                continue
            yield (part.nth << 40 | n - 1, *row)

    def read(self, partition: VcfPart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []
        for row in self.records(partition, Blocks(partition.path, partition.start)):
            rows.append(row)
            if len(rows) >= 8192:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PushedVcfReader(VcfReader):
    def pushFilters(self, filters: list) -> list:
        """Filters on contig and pos choose blocks; Spark still applies them all."""
        self.starts = pushed_region(filters, "contig", "pos", offset=1)
        return filters


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class VcfWriter(DataSourceArrowWriter):
    """A task writes its file and index under names of its own; the driver gives them their places when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite
        if not overwrite and exists(self.path) and files(self.path, ".vcf.gz"):
            raise ValueError(f"{self.path} has VCF files already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"{self.path}/_temporary-{self.job}/part-{task.partitionId():05d}-{task.taskAttemptId()}.vcf.gz"
        system, where = open_path(name)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        out, index, names = Writer(name), Builder(), {}
        out.write(b'##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample\n')
        for batch in iterator:
            for r in batch.to_pylist():
                ref = names.setdefault(r["contig"], len(names))
                qual = "." if r.get("qual") is None else f"{r['qual']:g}"
                line = "\t".join((r["contig"], str(r["pos"]), ".", r["ref"], r["alt"] or ".", qual, r["filter"] or ".", ".", "GT", r["gt"] or ".")) + "\n"
                begin = out.offset
                out.write(line.encode())
                index.add(ref, r["pos"] - 1, r["pos"] - 1 + len(r["ref"]), begin, out.offset)
        out.close()
        if not names and task.partitionId():
            return Written([])
        index.write_tbi(name + ".tbi", list(names))
        return Written([name])

    def commit(self, messages: list[Written]) -> None:
        system, where = open_path(self.path)
        if self.overwrite and exists(self.path):
            for old in [*files(self.path, ".vcf.gz"), *files(self.path, ".tbi")]:
                system.delete_file(open_path(old)[1])
        for name in (x for m in messages if m for x in m.parts):
            place = open_path(name)[1]
            final = f"{where}/{place.rsplit('/', 1)[1].rsplit('-', 1)[0]}.vcf.gz"
            system.move(place + ".tbi", final + ".tbi")
            system.move(place, final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, where = open_path(f"{self.path}/_temporary-{self.job}")
        if exists(f"{self.path}/_temporary-{self.job}"):
            system.delete_dir(where)


class VcfSource(DataSource):
    """Options to read: path (a .vcf.gz file or a folder of them), splitBytes (compressed bytes per task), region.  To write: path (a folder).

    ``region`` is contig:start-stop of 0-based positions, half-open; it gives the records whose reference bases overlap it.  rec_ord grows along the
    files, in the order of their names; where only parts are read, it counts in these.
    """

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> VcfReader:
        return VcfReader(self.options)

    def writer(self, schema, overwrite: bool) -> VcfWriter:
        return VcfWriter(self.options, overwrite)


class PushedVcfSource(VcfSource):
    """As VcfSource, but filters on contig and pos choose the blocks that are read; load it anew for each scan, as PushedBamSource."""

    @classmethod
    def name(cls) -> str:
        return "vcf_pushed"

    def reader(self, schema) -> PushedVcfReader:
        return PushedVcfReader(self.options)
