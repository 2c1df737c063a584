"""Byte-level BPE through a table of distinct words.

A word is a run of white space with the run of other characters after it.  The tokenizer's own pre-tokenizer
never joins characters across the start of such a run, so encoding word by word gives the ids of the whole
text.  Documents are packed into compressed blocks of bounded size.  Each block lists its distinct words, dealt
by hash; the task that gets a hash part holds its share of the table of distinct words, encodes each of them
once, and answers every block that asked with the ids in the order of its list.  In a block, words are then
replaced by position.  Texts are shuffled once, and compressed; words and ids travel as lists.

Decoding looks only at ids: each is joined to its piece in the id-to-piece table, whose size the tokenizer
fixes, so that every task has it whole and nothing is shuffled.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, shuffle_partitions, text_bytes

#: The code points of Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"
#: A word with the white space before it, or white space at the end.
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


@functools.lru_cache(2)
def tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_bytes(spec: str) -> dict[int, bytes]:
    """The bytes that each id of the vocabulary stands for."""
    data, of = json.loads(spec), byte_alphabet()
    vocabulary = data["model"]["vocab"] | {t["content"]: t["id"] for t in data["added_tokens"]}
    return {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in vocabulary.items()}


def piece_table(spec: str) -> pa.Array:
    """The id-to-piece table: the piece of id i at place i, and an empty one after the last."""
    pieces = piece_bytes(spec)
    return pa.array([pieces.get(i, b"") for i in range(max(pieces) + 2)], pa.large_binary())


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _pack_words(words: list[str], **more: pa.Array) -> bytes:
    """Words as one string with their lengths, which compresses far better than offsets; each further array is a list beside it."""
    columns = {"text": pa.array(["".join(words)], pa.string()), "sizes": _one_list(pa.array([len(w) for w in words], pa.int32()))} | {k: _one_list(v) for k, v in more.items()}
    return _pack(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _words_of(batch: pa.RecordBatch) -> list[str]:
    text, words, at = batch.column("text")[0].as_py(), [], 0
    for n in batch.column("sizes")[0].as_py():
        words.append(text[at : at + n])
        at += n
    return words


def _packer(block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(2)), dtype=np.int64)
            block = (ends - np.asarray(batch.column(2))) // block_bytes
            starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()] if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                docs = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "text"]).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(docs)], pa.binary())], ["docs"])

    return pack


def _by_part(words, n_parts: int) -> dict[int, list[str]]:
    """The words in order, by hash part."""
    parts = defaultdict(list)
    for w in sorted(words):
        parts[zlib.crc32(w.encode()) % n_parts].append(w)
    return parts


def _lister(n_parts: int):
    """The distinct words of each block, by hash part."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                found: set[str] = set()
                for text in _unpack(docs).column("text").to_pylist():
                    found.update(WORD.findall(text))
                parts = _by_part(found, n_parts)
                packed = [_pack_words(x) for x in parts.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(packed, pa.binary())], ["part", "block", "words"])

    return lists


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these starts and lengths, one after another."""
    return flat[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]


class _Words:
    """A part of the table of distinct words: the ids of each, in the order in which words came."""

    def __init__(self, spec: str) -> None:
        self.made, self.place, self.ids, self.ends = tokenizer(spec), _Numbers(), array("i"), array("q", [0])

    def add(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.place]
        for i in range(0, len(new), 20_000):
            for w, x in zip(new[i : i + 20_000], self.made.encode_batch(new[i : i + 20_000], add_special_tokens=False), strict=True):
                self.place[w]
                self.ids.extend(x.ids)
                self.ends.append(len(self.ids))

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        at, ends = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)), np.frombuffer(self.ends, np.int64)
        counts = ends[at + 1] - ends[at]
        return counts, _gather(np.frombuffer(self.ids, np.int32), ends[at], counts) if len(self.ids) else np.empty(0, np.int32)


def _encoder(spec: str):
    """Answers each list of words with their ids; a task has one part of the table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words(spec)
        for batch in batches:
            for part, block, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "words")), strict=True):
                words = _words_of(_unpack(data))
                table.add(words)
                counts, ids = table.ids_of(words)
                answer = _pack(pa.RecordBatch.from_arrays([_one_list(pa.array(counts, pa.int32())), _one_list(pa.array(ids, pa.int32()))], ["counts", "ids"]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([answer], pa.binary())], ["part", "block", "answer"])

    return encode


def _decoded(lists: pa.ListArray, pieces: pa.Array) -> pa.StringArray:
    """The text of each list of ids, by a join of all ids to their pieces."""
    last = len(pieces) - 1
    lists = lists.fill_null([]) if lists.null_count else lists
    ids = lists.flatten().fill_null(last).to_numpy(zero_copy_only=False)
    joined = pieces.take(pa.array(np.where((ids < 0) | (ids > last), last, ids)))
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[np.cumsum([0, *lists.value_lengths().to_pylist()])]
    whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends)), joined.buffers()[2]])
    try:
        return whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that end inside a character
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def _decoder(pieces: pa.Array):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(batch.column(1), pieces)], ["key", "ids", "decoded"])

    return decode


def _replacer(n_parts: int, pieces: pa.Array | None):
    def replace(packed: pa.Table, answers: pa.Table) -> pa.Table:
        """Ids of each document of a block, by the position of its words; with ``pieces`` also the text they decode to."""
        keys, codes, number = [], [], _Numbers()
        for docs in map(_unpack, packed["docs"].to_pylist()):
            keys.append(docs.column("doc_id"))
            codes += [np.fromiter(map(number.__getitem__, WORD.findall(text)), np.int32) for text in docs.column("text").to_pylist()]
        asked = _by_part(number, n_parts)
        starts, counts, flat, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [np.empty(0, np.int32)], 0
        for part, answer in zip(answers["part"].to_pylist(), map(_unpack, answers["answer"].to_pylist()), strict=True):
            at = np.fromiter(map(number.__getitem__, asked[part]), np.int64)
            counts[at] = found = answer.column("counts").flatten().to_numpy().astype(np.int64)
            starts[at] = size + np.cumsum(found) - found
            flat.append(answer.column("ids").flatten().to_numpy())
            size += len(flat[-1])
        flat = np.concatenate(flat)
        ids = [_gather(flat, starts[c], counts[c]) for c in codes]
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        made = pa.table({"doc_id": pa.chunked_array(keys).combine_chunks(), "ids": lists})
        return made if pieces is None else made.append_column("decoded", _decoded(lists, pieces))

    return replace


def encode(df: DataFrame, spec: str, key: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20, part_words: int = 200_000, with_text: bool = False) -> DataFrame:
    """key, ids (array<int>), one row per input row; other columns are ignored, and an empty table gives no rows.

    ``with_text`` adds decoded, what decode() makes of the ids, in the same tasks.

    ``spec`` is the content of a tokenizers JSON file.  A null text counts as empty: no ids.  Special tokens'
    strings in a text become their ids, as in the library.  Keys may be null or repeat; rows that repeat are
    encoded row by row.  Memory in a task is bounded by ``block_bytes``, or by the longest text, and by its share
    of the distinct words, which are counted first and dealt to as many tasks as ``part_words`` for each needs.
    """
    spark = df.sparkSession
    filled = F.coalesce("text", F.lit(""))
    rows = pick(df, key, text).toDF("doc_id", "text").select("doc_id", filled.alias("text"), F.octet_length(filled).alias("size"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    least = max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    n_blocks = max(math.ceil(text_bytes(rows, "text") / block_bytes), least)
    n_words = rows.select(F.explode(F.split("text", r"\s")).alias("word")).agg(F.approx_count_distinct("word")).first()[0]
    n_parts = max(math.ceil(n_words / part_words), least)
    # a block's id follows from its place in the scan; both uses of the blocks read the same exchange
    blocks = rows.mapInArrow(_packer(block_bytes), "docs binary").withColumn("block", F.monotonically_increasing_id()).repartition(n_blocks, "block")
    asked = blocks.mapInArrow(_lister(n_parts), "part int, block long, words binary").repartitionById(n_parts, "part")
    answers = asked.mapInArrow(_encoder(spec), "part int, block long, answer binary")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_replacer(n_parts, piece_table(spec) if with_text else None), f"doc_id {kind}, ids array<int>" + ", decoded string" * with_text)
    return out.withColumnRenamed("doc_id", key)


def decode(df: DataFrame, spec: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, decoded: any lists of ids through the id-to-piece table, one row per input row; no shuffle.

    Null and empty lists give '', ids that are null or not in the vocabulary give nothing, and bytes that are no
    UTF-8 give U+FFFD, as in the library.
    """
    rows = pick(df, key, ids).toDF("key", "ids")
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(_decoder(piece_table(spec)), f"key {kinds[0]}, ids {kinds[1]}, decoded string").toDF(key, ids, "decoded")


def encode_decode(df: DataFrame, spec: str, key: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """key, ids, decoded: encode() with what decode() makes of its ids."""
    return encode(df, spec, key, text, block_bytes, with_text=True)
