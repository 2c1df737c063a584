"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next
one's docs.  Toxic documents go, one of each group of near-duplicates stays, contaminated documents go, secrets
are redacted, and what is left is encoded.  Null and empty texts, ties and repeated rows, empty tables and further
columns are handled as each operator's docstring says; rows that no stage rejects are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import bpe, decontam, neardup, queries, secrets, toxicity
from lociflow.llm.common import pick, shared_dir, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the limit."""
    ship(spark)
    rows = pick(docs, *COLUMNS)
    weights, bias = toxicity.fit(rows, toxicity.training_labels(queries.table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(rows, weights, bias, queries.TOXIC_FROM)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id; a null doc_id stays."""
    ship(spark)
    return neardup.keep_one(pick(docs, *COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    ship(spark)
    return decontam.drop_contaminated(pick(docs, *COLUMNS), queries.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted and n_chars counted anew where a text changed."""
    ship(spark)
    return secrets.redact_documents(pick(docs, *COLUMNS), queries.tokenizer_file("byte_bpe_50k.tiktoken").read_bytes(), queries.split_pattern())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    ship(spark)
    found = bpe.encode_decode(docs, queries.tokenizer_file("byte_bpe_50k.json").read_text(), block_bytes=8 << 20)  # the workers still hold what earlier stages left
    return queries.bpe_digests(found)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
