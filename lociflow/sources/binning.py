"""The binning index of .bai, .tbi and .csi files: a tree of bins of positions with the chunks of a file that hold what lies in each.

A bin of one level is eight of the next.  A row is in the smallest bin that holds all of it, so a region's rows are in the bins, of every level, that touch it.
The linear index has, for each 16,384 positions, where the first row that overlaps them starts; chunks that end before it are left out.
"""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass, field

from .bgzf import Blocks, Writer, exists, open_path

Chunk = tuple[int, int]
#: Chunks whose blocks are no further apart than this many compressed bytes are read as one.
_NEAR = 0


@dataclass(frozen=True)
class Region:
    """Positions [start, stop) of a contig."""

    contig: str
    start: int
    stop: int

    @classmethod
    def of(cls, text: str) -> Region:
        contig, _, span = text.rpartition(":")
        start, _, stop = span.partition("-")
        return cls(contig, int(start), int(stop))


def first_bin(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: int, stop: int, shift: int = 14, depth: int = 5) -> int:
    """The smallest bin that holds [start, stop)."""
    last = max(stop - 1, start)
    for level in range(depth, 0, -1):
        width = shift + 3 * (depth - level)
        if start >> width == last >> width:
            return first_bin(level) + (start >> width)
    return 0


def bins_touching(start: int, stop: int, shift: int = 14, depth: int = 5) -> list[range]:
    """For each level, the bins that touch [start, stop)."""
    out = []
    for level in range(depth + 1):
        width = shift + 3 * (depth - level)
        out.append(range(first_bin(level) + (start >> width), min(first_bin(level) + (stop - 1 >> width), first_bin(level + 1) - 1) + 1))
    return out


@dataclass
class Contig:
    bins: dict[int, list[Chunk]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)
    first: dict[int, int] = field(default_factory=dict)  # of a .csi: where the first row that overlaps a bin starts


@dataclass
class Index:
    contigs: list[Contig]
    names: list[str] = field(default_factory=list)  # of a file of lines
    shift: int = 14
    depth: int = 5

    def offsets(self) -> list[int]:
        """Places in the file at which rows start."""
        return sorted({x for c in self.contigs for x in c.linear if x} | {a for c in self.contigs for chunks in c.bins.values() for a, _ in chunks})

    def chunks(self, ref: int, start: int, stop: int) -> list[Chunk]:
        """The parts of the file that can hold what overlaps [start, stop) of a contig, in order; near ones are one."""
        if not 0 <= ref < len(self.contigs) or stop <= start:
            return []
        start, stop = max(start, 0), min(stop, 1 << self.shift + 3 * self.depth)
        contig, window = self.contigs[ref], start >> self.shift
        least = 0
        if contig.linear:
            least = next((x for x in contig.linear[window:] if x), contig.linear[-1])
        elif contig.first:
            number = first_bin(self.depth) + window
            while number and number not in contig.first:
                number = number - 1 >> 3
            least = contig.first.get(number, 0)
        if not contig.bins:  # an index may have the linear part alone
            first = next((x for x in contig.linear[window:] if x), None)
            return [] if first is None else [(first, min((x for c in self.contigs[ref + 1 :] for x in c.linear if x), default=1 << 63))]
        # rows that start after the region's last window fill its next leaf bins; what comes later in the file starts later too
        after = min((chunks[0][0] for number, chunks in contig.bins.items() if number > first_bin(self.depth) + (stop - 1 >> self.shift)), default=1 << 63)
        found: list[Chunk] = []
        touching = bins_touching(start, stop, self.shift, self.depth)
        mine = (b for b in contig.bins if any(b in level for level in touching)) if sum(map(len, touching)) > len(contig.bins) else (b for level in touching for b in level if b in contig.bins)
        for a, b in sorted((max(a, least), b) for number in mine for a, b in contig.bins[number] if b > least and a < after):
            if found and (a >> 16) - (found[-1][1] >> 16) <= _NEAR:
                found[-1] = (found[-1][0], max(found[-1][1], b))
            else:
                found.append((a, b))
        return found


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, kind: str) -> tuple[int, ...]:
        out = struct.unpack_from(f"<{kind}", self.data, self.at)
        self.at += struct.calcsize(f"<{kind}")
        return out


def read_index(path: str, *endings: str) -> Index | None:
    """The index beside a file, by the first of the endings that there is, .bai, .tbi or .csi; None without one."""
    for name in [path + e for e in endings] + [path.rsplit(".", 1)[0] + e for e in endings]:
        if exists(name):
            break
    else:
        return None
    system, where = open_path(name)
    data = system.open_input_file(where).read()
    data = _Bytes(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    kind, shift, depth, names = data.take("4s")[0], 14, 5, b""
    if kind == b"CSI\x01":
        shift, depth, extra = data.take("iii")
        names = data.data[data.at + 28 : data.at + extra]
        data.at += extra
        n = data.take("i")[0]
    elif kind == b"TBI\x01":
        n, *_, size = data.take("8i")
        names = data.take(f"{size}s")[0]
    else:
        n = data.take("i")[0]
    contigs = []
    for _ in range(n):
        contig = Contig()
        for _ in range(data.take("i")[0]):
            number = data.take("I")[0]
            first = data.take("Q")[0] if kind == b"CSI\x01" else None
            chunks = data.take("2Q" * data.take("i")[0])
            if number < first_bin(depth + 1):  # the bin after the last one has counts
                contig.bins[number] = list(zip(chunks[::2], chunks[1::2], strict=True))
                if first is not None:
                    contig.first[number] = first
        if kind != b"CSI\x01":
            contig.linear = list(data.take(f"{data.take('i')[0]}Q"))
        contigs.append(contig)
    return Index(contigs, [x.decode() for x in names.split(b"\0")[:-1]], shift, depth)


class Builder:
    """Gathers an index while rows are written in order of contig and start."""

    def __init__(self, n: int = 0) -> None:
        self.contigs, self.last = [Contig() for _ in range(n)], (-1, -1)

    def add(self, ref: int, start: int, stop: int, begin: int, end: int) -> None:
        """A row of contig ``ref`` on [start, stop), between the virtual offsets ``begin`` and ``end``."""
        if (ref, start) < self.last:
            raise ValueError("rows aren't in order of contig and position")
        self.last = (ref, start)
        while ref >= len(self.contigs):
            self.contigs.append(Contig())
        contig, number = self.contigs[ref], bin_of(start, stop)
        chunks = contig.bins.setdefault(number, [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1] = (chunks[-1][0], end)
        else:
            chunks.append((begin, end))
        window = max(stop - 1, start) >> 14
        contig.linear += [0] * (window + 1 - len(contig.linear))
        for w in range(start >> 14, window + 1):
            contig.linear[w] = contig.linear[w] or begin

    def _body(self) -> bytes:
        out = b""
        for c in self.contigs:
            out += struct.pack("<i", len(c.bins))
            for number, chunks in sorted(c.bins.items()):
                out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *x) for x in chunks)
            out += struct.pack(f"<i{len(c.linear)}Q", len(c.linear), *c.linear)
        return out

    def write_bai(self, path: str) -> None:
        system, where = open_path(path)
        with system.open_output_stream(where) as file:
            file.write(b"BAI\x01" + struct.pack("<i", len(self.contigs)) + self._body())

    def write_tbi(self, path: str, names: list[str]) -> None:
        """For VCF lines: contig in column 1, position in column 2, header lines with #."""
        joined = b"".join(n.encode() + b"\0" for n in names)
        out = Writer(path)
        data = b"TBI\x01" + struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, len(joined)) + joined + self._body()
        for i in range(0, len(data), 1 << 15):
            out.write(data[i : i + (1 << 15)])
        out.close()


def pushed_region(filters: list, contig: str, position: str, offset: int = 0) -> Region | None:
    """The region that the filters leave of ``contig`` and of starts, ``position`` minus ``offset``; None if they don't name one contig."""
    from pyspark.sql import datasource as D

    name, start, stop = None, 0, 1 << 62
    for f in filters:
        column = getattr(f, "attribute", ())
        if column == (contig,) and isinstance(f, D.EqualTo):
            name = f.value
        elif column == (position,) and isinstance(f, D.EqualTo):
            start, stop = max(start, f.value - offset), min(stop, f.value - offset + 1)
        elif column == (position,) and isinstance(f, D.GreaterThan | D.GreaterThanOrEqual):
            start = max(start, f.value - offset + isinstance(f, D.GreaterThan))
        elif column == (position,) and isinstance(f, D.LessThan | D.LessThanOrEqual):
            stop = min(stop, f.value - offset + isinstance(f, D.LessThanOrEqual))
    return None if name is None else Region(name, start, stop)


def register(spark, *sources: type) -> None:
    """Makes sources known to the session, and lets filters reach those that take them."""
    if any(s.__name__.startswith("Pushed") for s in sources):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in sources:
        spark.dataSource.register(s)


__all__ = ["Blocks", "Builder", "Index", "Region", "pushed_region", "read_index", "register"]
