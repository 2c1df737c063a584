"""Quality rules against a plain version, and odd rows."""

import random
import re
from collections import Counter

from lociflow.llm import quality

NAMES = "doc_id long, text string, words int, lines int, keys string, bits int, `_c0` int, kept int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 6) for i, t in rows], NAMES)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if twice[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))

    def goes(x):
        spaces, separators, marks = x.count(" "), len(re.findall("[|»›•·→]", x)), len(re.findall(r"[#*$%&<>{}\\~^=_]", x))
        return (
            not re.search(r"[.!?:;…。！？][\"'’”»)\]]*([\x20\x09-\x0D]|\Z)", x) or (separators >= 2 and 4 * separators >= spaces) or (marks >= 2 and 3 * marks >= spaces)
            or (spaces >= 3 and any(c.isupper() for c in x) and not any(c.islower() for c in x)) or any(p in x.lower() for p in quality.BOILERPLATE)
        )

    cleaned = "\n".join(x for x in lines if not goes(x))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    lost = chars(text) - chars(cleaned)
    return (len(words), chars(text), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), cleaned, lost, failed, not failed and 100 * lost <= 40 * chars(text))


SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "lost_chars", "base_failed", "kept")


def test_by_brute_force(spark):
    rng = random.Random(5)
    kinds = [
        lambda w: " ".join(w) + rng.choice([".", "!", " ", "?\"", ".)  ", ":"]), lambda w: " | ".join(w), lambda w: "### ".join(w) + ".", lambda w: "!! ".join(w).upper() + "!!",
        lambda w: " ".join(w), lambda w: "Click here to " + w[0] + ".", lambda w: "Home » " + " » ".join(w) + ".", lambda w: "\t\x0b ",
    ]
    texts = [None, "", " \n\t\n ", "one", "a b c a b c", "\n".join(["same line."] * 40)]
    for _ in range(150):
        few = [f"w{rng.randrange(rng.choice([6, 400]))}é" for _ in range(400)]
        texts.append("\n".join(rng.choice(kinds if rng.random() < 0.5 else kinds[:1])([rng.choice(few) for _ in range(rng.randrange(1, 25))]) for _ in range(rng.randrange(1, 14))))
    got = {r["doc_id"]: tuple(r[c] for c in SHOWN) for r in quality.clean(table(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)
    assert len({x[-1] for x in got.values()}) == 2


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9973} and." for i in range(150_000))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, None), (2, "")]
    got = quality.clean(table(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "2", "None", "None"]
    assert {tuple(r[c] for c in SHOWN) for r in got if r["n_words"]} == {brute(long)}
    assert quality.clean(table(spark, rows).limit(0)).count() == 0
    both = table(spark, rows[3:]).select("doc_id", "text", "text", "doc_id")
    assert quality.clean(both).where("kept").count() == 0


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    real = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(*c) * 0)
    assert [r["n_repeat_words"] for r in quality.measures(table(spark, [(1, "a b c d e a b c"), (2, "a b c d e f g")])).orderBy("doc_id").collect()] == [6, 0]


def test_rules_and_reasons(spark):
    text = "A sentence of prose that stays.\nHome | News | Sport\nAll rights reserved.\nno end here\n" + " ".join(f"word{i}" for i in range(60)) + "."
    one = quality.clean(table(spark, [(1, text)])).first()
    assert one["lines_failed"] == {"punctuation": 2, "navigation": 1, "symbols": 0, "shouting": 0, "boilerplate": 1} and one["kept"]
    assert quality.clean(table(spark, [(1, text)]), {}).first()["lost_chars"] == 0
    short = quality.clean(table(spark, [(1, text)]), {"short": lambda x: x["spaces"] < 30}, most_lost=10).first()
    assert short["lines_failed"] == {"short": 4} and not short["kept"]
