"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and brute-force versions."""

import itertools
import random
import string
import zlib

import numpy as np
import pytest


from lociflow.llm import bpe, chat, decontam, htmltext, lzprint, neardup, queries, secrets, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars int, key int, size string, node int, label int, bucket int, spans int, _c0 int, _row int, digest int, tail int"


def clashing(spark, rows):
    """Rows of (doc_id, text) with columns that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[None] * 10) for i, t in rows], NAMES)


@pytest.fixture(scope="module")
def tokenizer():
    ranks = queries.tokenizer_file("byte_bpe_50k.tiktoken").read_bytes()
    return ranks, queries.split_pattern()


def operators(spark, tokenizer):
    """Every operator on documents, as a function of the table."""
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    spec = queries.tokenizer_file("byte_bpe_50k.json").read_text()
    return {
        "sharding": sharding.assign_shards,
        "bpe": lambda d: bpe.encode_decode(d, spec),
        "toxicity": lambda d: toxicity.score(d, weights, 0.0),
        "clean": lambda d: toxicity.keep_clean(d, weights, 0.0, 0.7),
        "near": neardup.near_duplicates,
        "one": neardup.keep_one,
        "secrets": lambda d: secrets.find_secrets(d, *tokenizer),
        "redact": lambda d: secrets.redact_documents(d, *tokenizer),
        "found": lambda d: decontam.find_contamination(d, bench),
        "kept": lambda d: decontam.drop_contaminated(d, bench),
        "prints": lzprint.fingerprints,
        "next": lzprint.compare_with_next,
    }


def test_empty_tables_clashing_columns_and_odd_rows(spark, tokenizer):
    long = " ".join(f"w{i % 700}x{i % 13}" for i in range(150_000))
    rows = [(1, "a b c"), (None, None), (None, ""), (2, "  "), (2, "  "), (3, long), (3, long), (4, "password=aaaaaaaaaa \u00e9"), (None, "a b c")]
    df = clashing(spark, rows)
    dropped = {"one": 1}  # of (3, long) twice, one
    for name, f in operators(spark, tokenizer).items():
        assert f(df.limit(0)).count() == 0, name
        got = f(df)
        assert got.count() == len(rows) - dropped.get(name, 0), name
        assert sorted(map(str, (r["doc_id"] for r in got.select("doc_id").collect()))) == sorted(str(i) for k, (i, _) in enumerate(rows) if name != "one" or k != 6), name


def test_repeated_column_names(spark, tokenizer):
    df = clashing(spark, [(1, "secret=0123456789"), (2, None)]).select("doc_id", "text", "n_chars")
    both = df.toDF("doc_id", "text", "n_chars").crossJoin(spark.createDataFrame([("other", 5)], "text string, n_chars int"))
    bench = spark.createDataFrame([(1, "secret 0123456789")], "item_id long, text string")
    for f, want in (
        (lambda d: toxicity.keep_clean(d, np.zeros(1 << toxicity.BITS, np.float32), 0.0, 0.7), [(1, "secret=0123456789", 17, "other", 5), (2, None, 0, "other", 5)]),
        (lambda d: secrets.redact_documents(d, *tokenizer), [(1, "[SECRET]", 8, "other", 5), (2, None, 0, "other", 5)]),
        (lambda d: decontam.drop_contaminated(d, bench), [(2, None, 0, "other", 5)]),
        (neardup.keep_one, [(1, "secret=0123456789", 17, "other", 5), (2, None, 0, "other", 5)]),
    ):
        got = f(both)
        assert got.columns == both.columns and sorted(map(tuple, got.collect()), key=str) == want


def test_empty_benchmark(spark):
    df = clashing(spark, [(1, "a b c"), (None, None)])
    none = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(None, "a b c"), (1, None), (2, ""), (3, "!")], "item_id long, text string")
    for bench in (none, odd):
        assert sorted(((r["doc_id"], r["n_words"], r["spans"], r["items"]) for r in decontam.find_contamination(df, bench).collect()), key=str) == [(1, 3, [], []), (None, 0, [], [])]
        assert decontam.drop_contaminated(df, bench).count() == 2


def test_shards_are_written_whole(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, *range(3, 200)]), rng.choice([None, "", "x" * rng.randrange(300)])) for _ in range(500)]
    df = clashing(spark, rows).select("doc_id", "text", "size", "key")
    sharding.write_shards(df, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    assert got[0].asDict().keys() == {"doc_id", "text", "size", "key", "shard"}
    count = lambda found: sorted((r["shard"], str(r["doc_id"])) for r in found)
    assert count(got) == count(sharding.assign_shards(df).collect())
    sharding.write_shards(df.limit(0), str(tmp_path / "none"))


def test_sharding_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "\u00e9" * rng.randrange(90)])) for i in rng.sample(range(10_000), 300)]
    size = lambda t: len((t or "").encode()) + 1
    total, at, slots, want = sum(size(t) for _, t in rows), 0, [0] * 8, []
    for i, t in sorted(rows):
        shard = min(7, (2 * at + size(t)) * 8 // (2 * total))
        want.append((i, size(t), zlib.crc32((t or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        at += size(t)
    assert sorted(tuple(r) for r in sharding.assign_shards(clashing(spark, rows)).collect()) == want


def brute_phrases(text):
    """Dictionary phrases by the textbook: the longest known one plus a character."""
    known, at = set(), 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in known:
            end += 1
        known.add(text[at:end])
        at = end
    return known


def test_phrases_by_brute_force():
    rng = random.Random(7)
    for text in ["", "a", "aa", "aaaa", "abab" * 50, "\U0001f600\u00e9" * 9] + ["".join(rng.choice("ab\u00e9 ") for _ in range(rng.randrange(400))) for _ in range(200)]:
        p = lzprint.Phrases()
        p.parse(text)
        hashes = set()
        for x in brute_phrases(text):
            h = 0
            for c in x:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
            hashes.add(h)
        assert set(p.hashes[1:]) == hashes and len(p.hashes) == len(hashes) + 1
        size = len(p.hashes)
        p.parse("qrs", 0)
        p.forget(size)
        assert set(p.hashes[1:]) == hashes == set(p.hashes[1:]) and len(p.nodes) == len(hashes)


def test_next_documents_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choice("ab ") for _ in range(rng.randrange(40)))) for _ in range(120)] + [(7, "long " * 50_000)] * 2
    one = sorted(map(tuple, lzprint.compare_with_next(clashing(spark, rows), 1).collect()), key=str)
    assert len(one) == len(rows)
    for n in (2, 7, 60):
        assert sorted(map(tuple, lzprint.compare_with_next(clashing(spark, rows).repartition(5), n).collect()), key=str) == one


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("table_bytes", [16 << 20, 64, 1])
def test_alignment_by_brute_force(table_bytes, monkeypatch):
    monkeypatch.setattr(htmltext, "TABLE_BYTES", table_bytes)
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randrange(40))] for _ in range(2))
        found = sorted(htmltext.common_lines(a, b))
        at = iter(b)
        assert all(any(a[i] == y for y in at) for i in found) and len(found) == lcs_length(a, b)


def test_alignment_of_very_long_pages():
    rng = random.Random(10)
    a, b = ([str(rng.randrange(9000)) for _ in range(30_000)] for _ in range(2))
    found = sorted(htmltext.common_lines(a, b))
    at = iter(b)
    assert len(found) > 300 and all(any(a[i] == y for y in at) for i in found)


def test_page_text_does_not_depend_on_ranges(spark):
    rng = random.Random(11)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}"
    site = {h: [" ".join(word() for _ in range(9)) for _ in range(3)] for h in "xyz"}
    rows = []
    for i in range(90):
        h = rng.choice("xxxyz")
        own = [" ".join(word() for _ in range(20)) for _ in range(3)]
        rows.append((i if i % 9 else None, f"http://{h}/{rng.choice('ab')}/{i}", "".join(f"<p>{x}</p>" for x in site[h][:2] + own + site[h][2:]), "\n".join(own)))
    rows.append((100, "http://long/", "<div>" + "word " * 400_000 + "</div>", ("word " * 400_000).strip()))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, want string, text int, host int")
    want = sorted((str(r[0]), r[1], r[3]) for r in rows)
    for n in (1, 4, 60):
        assert sorted((str(r["page_id"]), r["url"], r["text"]) for r in htmltext.extract(df.repartition(3), n).collect()) == want
    assert htmltext.extract(df.limit(0)).count() == 0


def known_forms(s):
    """Stretches of a run that are identifiers, by trying every stretch, the first form and the longest one first."""
    import re

    out, at = [], 0
    free = lambda i: not (0 <= i < len(s) and s[i].isalnum())
    while at < len(s):
        found = None
        if free(at - 1):
            found = next((end for form in secrets.FORMS for end in range(len(s), at, -1) if free(end) and re.fullmatch(form, s[at:end])), None)
        if found:
            out.append((at, found))
        at = found or at + 1
    return out


def brute_random(text, taken, encode, ratio=2.2):
    alphabet, found = set(string.ascii_letters + string.digits + "+/_=-"), []
    for inside, group in itertools.groupby(range(len(text)), key=lambda i: text[i] in alphabet):
        group = list(group)
        if not inside or len(group) < 8:
            continue
        s, a = text[group[0] : group[-1] + 1], group[0]
        known = known_forms(s)
        cuts = [0, *(x for k in known for x in k), len(s)]
        for lo, hi in zip(cuts[::2], cuts[1::2], strict=True):
            part = s[lo:hi]
            if known:
                lo += len(part) - len(part.lstrip("+/_=-"))
                part = s[lo:hi].rstrip("+/_=-")
            if len(part) < 8 or not any(c.isalpha() for c in part):
                continue
            digits, mixed = any(c.isdigit() for c in part), any(c.isupper() for c in part[1:]) and any(c.islower() for c in part)
            steps = secrets.LIMITS["digits" if digits else "mixed" if mixed else "single"]
            limit = ratio if len(part) >= 20 else max((n, x) for n, x in steps if n <= len(part))[1]
            span = a + lo, a + lo + len(part)
            if len(part) < limit * len(encode(part)) and not any(x < span[1] and span[0] < y for x, _, y in taken):
                found.append((span[0], 3, span[1]))
    return found


def test_random_spans_by_brute_force(tokenizer):
    encode = secrets.encoding(*tokenizer).encode_ordinary
    rng = random.Random(12)
    digest, uuid = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", "123E4567-e89b-12d3-a456-426614174000"
    odd = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice([7, 8, 12, 20, 32])))
    bits = [lambda: odd(), lambda: digest, lambda: uuid, lambda: "sha256-" + "Ab1/" * 10 + "xyz=", lambda: "ISBN978-3-16-148410-0", lambda: "2026-11-28T04", lambda: "commit", lambda: "international", lambda: "token=" + odd()]
    n = 0
    for _ in range(600):
        text = "".join(rng.choice(bits)() + rng.choice(["/", "_", "=", "-", " ", " ", ", "]) for _ in range(rng.randint(1, 6)))
        base = secrets.base_spans(text)
        want = brute_random(text, base, encode)
        assert secrets.random_spans(text, base, encode, 2.2) == want, text
        n += len(want)
    assert n > 100
    for clean in (f"v1/commit/{digest.upper()}", f"id={uuid}_x", "sha384-" + "Ab1/" * 16, f"https://h/a/{uuid}", "ISBN978-3-16-148410-0/978-0", "2026-11-28T0405Z_x"):
        assert not secrets.random_spans(clean, [], encode, 2.2), clean


def test_scores_by_brute_force(spark):
    rng = random.Random(13)
    words = ["good", "fine", "nice", "awful", "nasty", "vile"]
    rows = [(i, " ".join(rng.choice(words[:3] if i % 2 else words) for _ in range(12))) for i in range(200)] + [(None, "good"), (300, None)]
    df = clashing(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(5, None), (7, 3), (None, 1)], "doc_id long, toxic int")
    weights, bias = toxicity.fit(df, labels, least_count=2, least_z=1.0, steps=50)
    grams = {t: set(toxicity.grams(t).tolist()) for _, t in rows}
    for b in set().union(*grams.values()):
        has = [sum(b in grams[t] for i, t in rows[:200] if i % 2 == k) for k in (0, 1)]
        assert (weights[b] != 0) <= (sum(has) >= 2 and abs(has[0] - has[1]) >= sum(has) ** 0.5 - 1e-6)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, weights, bias).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(bias + sum(float(weights[b]) for b in grams[t])))), abs=1e-5)
    assert got == pytest.approx(refitted(dict(rows[:200]), {i: 1 - i % 2 for i in range(200)}, dict(rows), 2, 1.0, 50), abs=1e-3)
    assert sum(got[i] >= 0.7 for i in range(0, 200, 2)) > 90 and sum(got[i] >= 0.7 for i in range(1, 200, 2)) < 10


def refitted(texts, toxic, every, least_count, least_z, steps):
    """The scores by a plain dense version: ratios counted anew, a regression, and the cut from folds, from texts and labels alone."""
    ids, y = list(texts), np.array([toxic[i] for i in texts], float)
    sets = [set(toxicity.grams(texts[i]).tolist()) for i in ids]
    buckets = sorted(set().union(*sets))
    has = np.array([[b in s for b in buckets] for s in sets], float)

    def ratios(rows, y):
        n1, n0, c1, c0 = y.sum(), (1 - y).sum(), rows[y == 1].sum(0), rows[y == 0].sum(0)
        p, n = n1 / (n1 + n0), c1 + c0
        z = (c1 - n * p) / np.sqrt(n * p * (1 - p) + 1e-9)
        return np.where((n >= least_count) & (abs(z) >= least_z), np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2)), 0)

    def model(rows, y):
        scale = ratios(rows, y)
        x, share = rows * scale, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        w, m, v = np.zeros(x.shape[1] + 1), 0, 0
        for t in range(1, steps + 1):
            e = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
            g = np.append(x.T @ e + 2e-3 * w[:-1], e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w[:-1] * scale, w[-1]

    w, b = model(has, y)
    kept = np.flatnonzero(ratios(has, y))
    fold = np.array([(int(np.flatnonzero(r[kept]).sum()) + int(r[kept].sum())) % 3 for r in has])
    logits = np.zeros(len(y))
    for f in set(fold.tolist()):
        fw, fb = model(has[fold != f][:, kept], y[fold != f])
        logits[fold == f] = has[fold == f][:, kept] @ fw + fb

    def cut(z, y, beta):
        tries = []
        for c in np.unique(z):
            hit, false = y[z >= c].sum(), (1 - y)[z >= c].sum()
            below = z[z < c].max(initial=-np.inf)
            if hit >= false:
                tries.append(((1 + beta**2) * hit / (hit + false + beta**2 * y.sum()), c, c if below == -np.inf else (c + below) / 2))
        return max(tries)[2]

    def agreement(beta):
        called = np.array([logits[i] >= cut(logits[fold != fold[i]], y[fold != fold[i]], beta) for i in range(len(y))])
        return np.corrcoef(called, y)[0, 1]

    b += np.log(0.7 / 0.3) - cut(logits, y, max(toxicity.BETAS, key=lambda x: round(agreement(x), 9)))
    weight = dict(zip(buckets, w, strict=True))
    return {i: 1 / (1 + np.exp(-(b + sum(weight.get(k, 0.0) for k in set(toxicity.grams(t).tolist()))))) for i, t in every.items()}


def test_best_cut():
    y = np.array([1, 1, 0, 1, 0, 0, 0])
    assert toxicity.best_cut(np.array([9.0, 8, 7, 6, 5, 4, 3]), y, 1.0) == 5.5
    assert toxicity.best_cut(np.array([9.0, 8, 7, 6, 5, 4, 3]), y, 10.0) == 7.5
    assert toxicity.best_cut(np.zeros(7), y, 10.0) is None and toxicity.best_cut(np.arange(7.0), y, 10.0) is None


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "x" * 500_000 + "</s>"), (1, 1, "assistant", "</s>" * 50_000), (1, 1, "assistant", "</s>" * 50_000), (None, None, None, None), (2, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, segment int, loss_start int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 400_000), None: (1, 0), 2: (1, 0)}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_shared_passages_ship_each_set_a_few_times(spark):
    """Documents that share a passage without being linked: twice as many ship about twice as much, and none is linked."""

    def shipped():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    bytes_of = {}
    for k in (1000, 2000):
        passage = [f"c{i}" for i in range(60)]
        df = spark.createDataFrame([(i, " ".join(passage + [f"o{i}_{j}" for j in range(30)])) for i in range(k)], "doc_id long, text string")
        before = shipped()
        assert neardup.near_duplicates(df).where("kept").count() == k
        bytes_of[k] = shipped() - before
    assert bytes_of[2000] < 2.3 * bytes_of[1000]


def test_pipeline_row_by_row(spark):
    """Every stage's rows from the operators' own brute-force checked results, and the last one from the library."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in queries.op3_toxicity(spark, SF).collect()}
    left = [i for i in sorted(texts) if not scores[i]]
    sets, parent = {}, {i: i for i in left}
    for i in left:
        w = [x for x in (texts[i] or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).encode().split() if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(left, 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    left = [i for i in left if root(i) == i]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontam.words(r["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for i in left:
        w, hit = decontam.words(texts[i]), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(i)
    encode = secrets.encoding(queries.tokenizer_file("byte_bpe_50k.tiktoken").read_bytes(), queries.split_pattern()).encode_ordinary
    library, want = Tokenizer.from_str(queries.tokenizer_file("byte_bpe_50k.json").read_text()), []
    for i in clean:
        t = texts[i] or ""
        base = secrets.base_spans(t)
        gone = [False] * len(t)
        for a, _, b in base + brute_random(t, base, encode):
            gone[a:b] = [True] * (b - a)
        t = "".join("[SECRET]" if dead else "".join(t[k] for k in ks) for dead, ks in itertools.groupby(range(len(t)), key=gone.__getitem__))
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_empty_tables_and_repeated_names_of_pages_turns_and_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>one</p>", None), (None, None, None, None), (1, "http://h/1", "<p>one</p>", None)], "page_id long, url string, html string, header string")
    twice = pages.select("page_id", "url", "html", "html", "page_id", "header")
    for df, n in ((pages, 3), (twice, 3), (pages.limit(0), 0)):
        assert htmltext.extract(df).count() == n
        path = str(tmp_path / f"archive{n}{len(df.columns)}")
        warc.write_archive(df, path, least_bytes=1)
        found = warc.catalog(warc.read_archive(spark, path))
        assert found.count() == n and found.where("record_id is null").count() == (n > 0)
        warc.export(spark, path, path + "-files")
    turns = spark.createDataFrame([(1, 0, "user", "x", 1), (1, 0, "user", "x", 1), (None, None, "assistant", None, 1), (None, 1, None, "y", 1)], "conv_id long, turn long, role string, text string, segment int")
    both = turns.select("conv_id", "turn", "role", "text", "text", "segment")
    for df in (turns, both):
        got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_turns(df)).collect()}
        assert got == {1: 2, None: 2}
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    sharding.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(map(str, decontam.drop_contaminated(odd, bench).collect())) == sorted(map(str, odd.limit(2).collect()))
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == 5 and decontam.drop_contaminated(odd.limit(0), bench).count() == 0


def test_very_long_pages_through_extract(spark):
    rng = random.Random(31)
    own = [[f"own {k} {i} {rng.random()}" for i in range(40_000)] for k in range(2)]
    site = [f"site line {i}" for i in range(10_000)]
    page = lambda x: "".join(f"<div>{t}</div>" for t in site + x)
    rows = spark.createDataFrame([(k, f"http://h/{k}", page(x)) for k, x in enumerate(own)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.extract(rows).collect()} == {k: "\n".join(x) for k, x in enumerate(own)}
