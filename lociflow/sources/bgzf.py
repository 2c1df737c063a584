"""Block-compressed (BGZF) files: blocks read one at a time from virtual offsets, and written."""

from __future__ import annotations

import struct
import zlib

from pyarrow import fs

#: Fixed values of the format: bytes of plain data in a block at most, and the empty block that ends a file.
BLOCK_BYTES = 65_280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def open_path(path: str):
    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, where


def exists(path: str) -> bool:
    system, where = open_path(path)
    return system.get_file_info(where).type != fs.FileType.NotFound


def files(path: str, *endings: str) -> list[str]:
    """The path itself, or the files of a folder with one of the endings, by name."""
    system, where = open_path(path)
    if system.get_file_info(where).type != fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(where)) if x.base_name.endswith(endings))


class Blocks:
    """Bytes of a BGZF file from a virtual offset on; ``offset`` is that of the next byte, ``loaded`` the compressed bytes read so far."""

    def __init__(self, path: str, offset: int = 0) -> None:
        system, where = open_path(path)
        self.file = system.open_input_file(where)
        self.at, self.data, self.used, self.loaded = offset >> 16, b"", 0, 0
        self.load()
        self.used = offset & 0xFFFF

    def load(self) -> bool:
        self.start = self.at
        self.file.seek(self.at)
        head = self.file.read(18)
        if len(head) < 18:
            self.data, self.used = b"", 0
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, size, i = head[12:18] + self.file.read(extra - 6), 0, 0
        while i < extra:
            if fields[i : i + 2] == b"BC":
                size = struct.unpack_from("<H", fields, i + 4)[0] + 1
            i += 4 + struct.unpack_from("<H", fields, i + 2)[0]
        if head[:2] != b"\x1f\x8b" or not size:
            raise OSError(f"no BGZF block at byte {self.at}")
        self.data, self.used = zlib.decompress(self.file.read(size - 12 - extra), -15), 0
        self.at += size
        self.loaded += size
        return True

    @property
    def offset(self) -> int:
        while self.used >= len(self.data):
            if not self.load():
                return self.at << 16
        return self.start << 16 | self.used

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.used >= len(self.data) and not self.load():
                break
            part = self.data[self.used : self.used + n - len(out)]
            out, self.used = out + part, self.used + len(part)
        return out

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the file."""
        parts = []
        while True:
            if self.used >= len(self.data) and not self.load():
                return b"".join(parts) if parts else None
            end = self.data.find(b"\n", self.used)
            if end >= 0:
                parts.append(self.data[self.used : end])
                self.used = end + 1
                return b"".join(parts)
            parts.append(self.data[self.used :])
            self.used = len(self.data)

    def integer(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def next_block(path: str, at: int) -> int | None:
    """The byte at which the first block from ``at`` on starts: one that another block, or the file's end, follows."""
    system, where = open_path(path)
    file = system.open_input_file(where)
    file.seek(at)
    data, size = file.read(3 << 16), file.size()
    i = data.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        if data[i + 12 : i + 16] == b"BC\x02\0":
            after = i + struct.unpack_from("<H", data, i + 16)[0] + 1
            if at + after == size or data[after : after + 4] == b"\x1f\x8b\x08\x04":
                return at + i
        i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return None


class Writer:
    """Writes BGZF blocks; ``offset`` is the virtual offset of the next byte."""

    def __init__(self, path: str) -> None:
        system, where = open_path(path)
        self.file, self.at, self.rest = system.open_output_stream(where, compression=None), 0, bytearray()  # else a name that ends in .gz is compressed again

    @property
    def offset(self) -> int:
        return self.at << 16 | len(self.rest)

    def write(self, data: bytes) -> None:
        """Data that fit a block stay whole in one."""
        if len(self.rest) + len(data) > BLOCK_BYTES:
            self.flush()
        self.rest += data
        while len(self.rest) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        part, self.rest = bytes(self.rest[:BLOCK_BYTES]), self.rest[BLOCK_BYTES:]
        if not part:
            return
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        self.file.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
        self.at += len(body) + 26

    def close(self) -> None:
        while self.rest:
            self.flush()
        self.file.write(END)
        self.file.close()
