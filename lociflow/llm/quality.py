"""Quality rules, line by line first: lines that fail a rule go, and documents that lose too much text with them.

Everything is column expressions over one row at a time, so that nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Fixed values of the base measures: the characters that separate words, and a symbol.
SPACES, SYMBOL = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
#: What stands between the entries of a menu or of a trail of pages, and what prose has little of.
SEPARATOR, MARK = "[|»›•·→]", r"[#*$%&<>{}\\~^=_]"

#: A sentence's end, or a line's that announces something: a mark, then quotes or brackets that close, then space or nothing.
SENTENCE_END = r"[.!?:;…。！？][\"'’”»)\]]*([\x20\x09-\x0D]|$)"
#: Phrases that sites put on their pages, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "cookie settings", "uses cookies", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "lorem ipsum", "skip to content", "skip to main content", "sign up for our newsletter", "licensed under the", "click here to",
)

Rule = Callable[[Column], Column]


def without_spaces(text: Column) -> Column:
    """The text's words, run together; each space is looked for in the bytes, which is cheaper than a pattern that matches often."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def rules() -> dict[str, Rule]:
    """The rules by name: functions of a struct of a line, its lower case, and its numbers of spaces, separators and marks; true for lines that go.

    Lines without words are never asked.  punctuation: no sentence ends in it.  navigation: at least two separators, and one for four spaces.
    symbols: at least two marks, and one for three spaces.  shouting: three spaces, capitals and no small letters.  boilerplate: a phrase of BOILERPLATE.
    """
    return {
        "punctuation": lambda x: ~x["line"].rlike(SENTENCE_END),
        "navigation": lambda x: (x["separators"] >= 2) & (4 * x["separators"] >= x["spaces"]),
        "symbols": lambda x: (x["marks"] >= 2) & (3 * x["marks"] >= x["spaces"]),
        "shouting": lambda x: (x["spaces"] >= 3) & x["line"].rlike(r"\p{Lu}") & ~x["line"].rlike(r"\p{Ll}"),
        "boilerplate": lambda x: reduce(Column.__or__, [F.contains(x["lower"], F.lit(phrase)) for phrase in BOILERPLATE]),
    }


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text, lines (those with a word) and, over the whole text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    ``n_repeat_words``: words inside 3-word windows that the text has more than once.  Hashes of windows, each with its place in the bits that the
    places need, are sorted, so that equal ones are neighbours.  The windows of those are then sorted and compared as text, and the places of the
    equal ones sorted again: each covers the words that the one before it leaves.
    """
    blank = F.col("text")
    for c in SPACES[1:]:
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blank", blank)
    rows = rows.withColumn("words", F.array_remove(F.split("blank", " "), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i: F.get("words", i)
    starts = F.when(F.size("words") > 2, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("bits", F.length(F.bin(F.size("words").cast("long"))))
    key = lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col("bits")).bitwiseOR(i.cast("long"))
    rows = rows.withColumn("keys", F.sort_array(F.transform(starts, key)))
    hashed = lambda x: F.call_function("shiftright", x, F.col("bits"))
    same = lambda x, j: F.coalesce(hashed(F.get("keys", j)) == hashed(x), F.lit(False))
    place = lambda x: (x - F.call_function("shiftleft", hashed(x), F.col("bits"))).cast("int")
    window = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("text"), i.alias("at"))
    rows = rows.withColumn("alike", F.filter("keys", lambda x, j: same(x, j - 1) | same(x, j + 1))).withColumn("alike", F.sort_array(F.transform(F.transform("alike", place), window)))
    equal = lambda x, j: F.coalesce(F.get("alike", j)["text"] == x["text"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("alike", lambda x, j: equal(x, j - 1) | equal(x, j + 1)), lambda x: x["at"]))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(again, none, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return rows.select(
        "doc_id", "text", "lines", F.size("words").cast("long").alias("n_words"), F.length(F.replace("blank", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def clean(docs: DataFrame, line_rules: Mapping[str, Rule] | None = None, most_lost: int = 40) -> DataFrame:
    """doc_id, text, the measures(), lines_failed (a map from rule to how many lines it takes), cleaned, lost_chars, base_failed, kept.

    Each line with a word is asked every rule and goes if any says so; ``cleaned`` is the others, joined again.  A document is rejected if its base
    measures fail or if more than ``most_lost`` percent of the code points of its words were on lines that went.

    A null text is as an empty one: no words, all measures 0, base_failed.  Very long texts are one row's arrays and nothing more.  Repeated rows
    and ids are judged row by row, a null doc_id stays null, an empty table gives no rows, and other columns, whatever their names, aren't looked at.
    """
    line_rules = rules() if line_rules is None else line_rules
    about = lambda x: F.struct(x.alias("line"), F.lower(x).alias("lower"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).alias("spaces"), F.regexp_count(x, F.lit(SEPARATOR)).alias("separators"), F.regexp_count(x, F.lit(MARK)).alias("marks"))
    asked = lambda x: F.struct(x["line"].alias("line"), *[rule(x).alias(name) for name, rule in line_rules.items()])
    judged = measures(docs).withColumn("judged", F.transform(F.transform("lines", about), asked))
    failed = lambda x: F.greatest(*[x[name] for name in line_rules], F.lit(False), F.lit(False))
    kept = judged.withColumn("cleaned", F.array_join(F.transform(F.filter("judged", lambda x: ~failed(x)), lambda x: x["line"]), "\n"))
    count = lambda name: F.size(F.filter("judged", lambda x: x[name]))
    taken = F.map_from_arrays(F.array(*map(F.lit, line_rules)), F.array(*map(count, line_rules))) if line_rules else F.create_map().cast("map<string,int>")
    left = F.length(without_spaces(F.col("cleaned"))).cast("long")
    out = kept.withColumn("lines_failed", taken).withColumn("lost_chars", F.col("word_chars") - left).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars"))).drop("judged", "lines")
