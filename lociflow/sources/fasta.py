"""FASTA files with a ``.fai`` index as a Spark data source.

``spark.dataSource.register(FastaSource)``, then ``spark.read.format("fasta").load(path)``.  The index says where each
base is, so that tasks read their own blocks from the file and nothing is shuffled; option ``region`` reads only the
blocks that a region touches.  ``text.write_fasta_index`` makes the index; ``text.read_fasta`` reads files without one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import REFERENCE
from .bgzf import files, open_path
from .binning import Region


@dataclass(frozen=True)
class Contig:
    """A row of the index: bases of the contig, byte of the first, and bases and bytes of a line."""

    name: str
    length: int
    offset: int
    line_bases: int
    line_bytes: int

    def byte(self, base: int) -> int:
        return self.offset + base // self.line_bases * self.line_bytes + base % self.line_bases


def read_index(path: str) -> list[Contig]:
    system, where = open_path(path + ".fai")
    if system.get_file_info(where).type == fs.FileType.NotFound:
        raise OSError(f"no index beside {path}")
    rows = (line.split("\t") for line in system.open_input_file(where).read().decode().splitlines() if line)
    return [Contig(r[0], *map(int, r[1:5])) for r in rows]


def fasta_files(path: str) -> list[str]:
    """The path itself, or the files of a folder that have an index beside them."""
    return sorted(x.removesuffix(".fai") for x in files(path, ".fai")) if path not in files(path) else [path]


@dataclass
class Blocks(InputPartition):
    path: str
    contig: Contig | None
    first: int
    stop: int


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.per_task = options["path"], int(options.get("blockSize", 65_536)), int(options.get("blocksPerTask", 256))
        self.region = Region.of(options["region"]) if "region" in options else None

    def partitions(self) -> list[Blocks]:
        parts = []
        for path, c in ((p, c) for p in fasta_files(self.path) for c in read_index(p)):
            first, stop = 0, -(-c.length // self.size)
            if self.region:
                if c.name != self.region.contig:
                    continue
                first, stop = max(0, self.region.start) // self.size, min(stop, -(-self.region.stop // self.size))
            parts += [Blocks(path, c, b, min(b + self.per_task, stop)) for b in range(first, stop, self.per_task)]
        return parts or [Blocks("", None, 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        c = partition.contig
        if not c:
            return
        system, where = open_path(partition.path)
        with system.open_input_file(where) as file:
            for b in range(partition.first, partition.stop):
                start, stop = b * self.size, min((b + 1) * self.size, c.length)
                file.seek(c.byte(start))
                bases = file.read(c.byte(stop - 1) + 1 - c.byte(start)).translate(None, b"\r\n").decode().upper()
                yield pa.RecordBatch.from_arrays([pa.array([c.name]), pa.array([b], pa.int32()), pa.array([bases])], ["contig", "block", "seq"])


class FastaSource(DataSource):
    """Options: path (a file with an index beside it, or a folder of them), blockSize (bases), blocksPerTask, region (contig:start-stop, 0-based and half-open)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return REFERENCE

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)
