"""Word-wise encoding against the library on whole texts."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociflow.llm import bpe

SPEC = open(public_tokenizers.path("byte_bpe_50k.json")).read()
TEXTS = [
    None, "", " ", "a", "a<|endoftext|> b", "  x  y\x85z \n\n q ", "\t\tI'll  don't<|endoftext|><|endoftext|>", "a\x1cb \x1f c\x00d", "​ x﻿ y", "é \U0001f600\U0001f600 中文 テスト",
    "　　中", "x" * 300_000, "same same same", "same same same", "many words " * 30_000,
]


def test_against_library(spark):
    library = Tokenizer.from_str(SPEC)
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, word int")
    for block in (100_000, 16 << 20):
        got = {r["doc_id"]: r for r in bpe.encode_decode(df, SPEC, block_bytes=block).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            want = library.encode(t or "", add_special_tokens=False).ids
            row = got[i if i != 3 else None]
            assert row["ids"] == want and row["decoded"] == library.decode(want, skip_special_tokens=False) == (t or "")


def test_each_distinct_word_is_encoded_once():
    """A task answers lists of words from its part of the table, to which it adds a word only once."""
    table = bpe._Words(SPEC)
    library = Tokenizer.from_str(SPEC)
    for words in (["a", " b", "  ccc"], [" b", "dd"], [], ["  ccc", "a", "\u00e9"]):
        table.add(words)
        counts, ids = table.ids_of(words)
        want = [library.encode(w, add_special_tokens=False).ids for w in words]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(table.place) == len(table.ends) - 1 == 5


def test_many_parts_of_the_word_table(spark):
    df = spark.createDataFrame([(i, f"w{i} v{i} the") for i in range(200)], "doc_id long, text string").repartition(7)
    got = bpe.decode(bpe.encode(df, SPEC, part_words=3, block_bytes=500), SPEC)
    assert sorted(got.collect()) == sorted(bpe.encode(df, SPEC, with_text=True).collect())
    assert got.where(F.col("decoded") == F.format_string("w%d v%d the", "doc_id", "doc_id")).count() == 200


def test_decode_of_any_ids(spark):
    library = Tokenizer.from_str(SPEC)
    rows = [(1, [464, 3290]), (2, []), (3, None), (4, [50256, 262]), (5, library.encode("é中").ids[:1]), (6, [464] * 100_000)]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), SPEC).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}
    odd = spark.createDataFrame([(None, [464, None, 99_999_999, -1]), (1, [464]), (1, [464])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, SPEC).collect()] == ["The"] * 3 and bpe.decode(odd.limit(0), SPEC).count() == 0


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), SPEC).count() == 0
