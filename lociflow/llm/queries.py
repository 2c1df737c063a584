"""The operators as queries over the standard tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontam, htmltext, lzprint, neardup, quality, ranking, secrets, sharding, toxicity, warc
from .common import new_path, pick, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> Path:
    """A vocabulary file of the public tokenizers package; read on the driver only."""
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").read_text())
    return bpe_digests(found)


def bpe_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: A text with this score or more counts as toxic.
TOXIC_FROM = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, weights, bias)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def scan(docs: DataFrame) -> DataFrame:
    return secrets.find_secrets(docs, tokenizer_file("byte_bpe_50k.tiktoken").read_bytes(), split_pattern())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), shown("spans").alias("spans"), of("random").alias("n_random"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), warc.new_path(spark)
    warc.write_archive(pages, path, least_bytes=100)
    return warc.catalog(warc.read_archive(spark, path)).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as long)").alias("refers_to"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontam.find_contamination(docs, benchmark)
    n_hit = decontam.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lzprint.compare_with_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_turns(rows))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clustering.integer_vectors(table(spark, sf_dir, "embeddings"))
    found = clustering.cluster(vectors, clustering.first_by_hash(vectors, 40, "2:"), rounds=5)
    measured = clustering.with_distance(found)
    sums = {r["cluster"]: r["inertia"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    return measured.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "index")
    ranking.build_index(docs, path)
    return ranking.search(ranking.read_index(spark, path), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_bpe, op3_toxicity, op4_near_dedup, op5_secrets, op6_warc, op7_decontamination, op8_html, op9_fingerprints, op10_chat, op11_quality, op12_clusters, op13_search)
}



def cluster_sql(k: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    """Each round as two tables: who is nearest to what, and the centroids that follow."""
    out = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
                        WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dimensions}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS cluster, v FROM x QUALIFY cluster < {k})"""
    for i in range(rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
       FROM (SELECT r, cluster, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM x, c{i} c) GROUP BY r)"""
        if i < rounds:
            out += f""",
m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT cluster, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{i} JOIN x USING (r)) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
    return out + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN c{rounds} c USING (cluster)"""


ORACLE_SQL: dict[str, str] = {
    "op12_clusters": cluster_sql(),
    "op1_sharding": r"""
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
                         UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
p AS (SELECT *, (sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start, (sum(size) OVER ())::BIGINT AS total FROM d),
s AS (SELECT *, least(7, (2 * start + size) * 8 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM s""",
    "op4_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op7_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS t, least(len(w), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes)),
hit AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM spots s JOIN win ON s.t = win.t AND s.n = win.n),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|/?s>|ROLE:|/ROLE\])', '\1\2\\\3', 'g'))
             + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 17 + 2 * length(role) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_quality": r"""
WITH phrases(phrase) AS (VALUES ('all rights reserved'), ('cookie policy'), ('cookie settings'), ('uses cookies'), ('privacy policy'), ('terms of use'), ('terms of service'), ('enable javascript'),
    ('lorem ipsum'), ('skip to content'), ('skip to main content'), ('sign up for our newsletter'), ('licensed under the'), ('click here to')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
spots AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM spots WHERE n > 1) GROUP BY r),
lines AS (SELECT r, x, length(x) - length(replace(x, ' ', '')) AS spaces, len(regexp_extract_all(x, '[|»›•·→]')) AS separators, len(regexp_extract_all(x, '[#*$%&<>{}\\~^=_]')) AS marks
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
asked AS (SELECT *, NOT regexp_matches(x, '[.!?:;…。！？]["''’”»)\]]*([\x20\x09-\x0D]|$)') OR separators >= 2 AND 4 * separators >= spaces OR marks >= 2 AND 3 * marks >= spaces
                 OR spaces >= 3 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}') OR EXISTS (SELECT 1 FROM phrases WHERE contains(lower(x), phrase)) AS goes FROM lines),
by_doc AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines, coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (goes), 0) AS lost_chars FROM asked GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN again USING (r) LEFT JOIN by_doc USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= 40 * word_chars AS kept, lost_chars FROM f""",
    "op13_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term),
g AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))) AS gain FROM t JOIN f USING (term), s),
e AS (SELECT item_id, r, doc_id, sum(times * gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM e WHERE score > 0 QUALIFY rank <= 10""",
}
