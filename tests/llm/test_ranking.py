"""Ranked search against a plain version, the packed numbers, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lociflow.llm import ranking


def table(spark, key, rows):
    return spark.createDataFrame([(i, t, *[None] * 5) for i, t in rows], f"{key} long, text string, term string, shard int, n_docs int, block int, `_c0` int")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in wanted.items():
        scores = []
        for i, c, size in held:
            m = 100 - 75 + 75 * size * n // length
            score = sum(times * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in query.items() if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, tmp_path, docs, items, shard_bytes=3000, **options):
    path = str(tmp_path / f"index{random.random()}")
    ranking.build_index(table(spark, "doc_id", docs).repartition(3), path, shard_bytes)
    index = ranking.read_index(spark, path)
    return sorted(map(tuple, ranking.search(index, table(spark, "item_id", items), **options).collect()), key=str), index


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "Ünï", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(rng.randrange(-(2**62), 2**62) if i % 7 else i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randrange(1, 60))).title()) for i in range(400)]
    docs += [(5, "the same text twice w1 w2")] * 12 + [(None, "w3 w30 w31"), (None, "w3 w30 w31"), (6, None), (7, ""), (8, "!! --"), (9, " ".join(f"q{i} w9" for i in range(40_000)))]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(3, "w1 w1 w1"), (None, "w30 W31"), (50, None), (51, ""), (52, "unheard of"), (53, "nowhere"), (54, "q77 w9")]
    return docs, items


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_by_brute_force(spark, tmp_path, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(ranking, "BLOCK", 9)
    monkeypatch.setattr(ranking, "SHARDS_PER_KEY", 4)
    docs, items = corpus()
    got, index = found(spark, tmp_path, docs, items, broadcast_bytes=broadcast_bytes)
    assert got == brute(docs, items)
    assert index.where("term is null").count() > 8
    assert found(spark, tmp_path, docs, items, 16 << 20, k=3)[0] == brute(docs, items, 3)


def test_nothing_to_find(spark, tmp_path):
    docs, items = corpus()
    assert found(spark, tmp_path, [], items)[0] == []
    assert found(spark, tmp_path, docs[:5], [])[0] == []
    assert found(spark, tmp_path, [(1, None), (2, "?")], items)[0] == []
    assert found(spark, tmp_path, docs[:5], [(1, None), (2, "absent")])[0] == []


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**32, 2**63, 2**64 - 1], np.uint64)
    packed, ends = ranking.pack(values)
    assert (ranking.unpack(packed.tobytes()) == values).all() and ends[-1] == len(packed)
    assert len(ranking.unpack(b"")) == 0


def test_lists_that_cannot_matter_are_not_merged():
    rng = random.Random(4)
    for _ in range(200):
        lists = []
        for _ in range(rng.randrange(1, 7)):
            places = sorted(rng.sample(range(80), rng.randrange(1, 70)))
            gains = [rng.randrange(rng.choice([1, 4, 300])) for _ in places]
            lists.append((places, gains, max(gains)))
        total = Counter()
        for places, gains, _ in lists:
            total.update(dict(zip(places, gains, strict=True)))
        want = sorted(((s, p) for p, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:5]
        assert sorted(ranking.best_documents(lists, 5), key=lambda x: (-x[0], x[1])) == want
