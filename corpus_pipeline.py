"""A training-data pipeline over ``documents``: every stage works on what the one before it kept.

1. toxicity: documents that the noisy-or model rejects go.
2. exact dedup: of equal texts, the document with the largest id stays.
3. n-gram Jaccard join: of each component of near copies, the document with the smallest id stays.
4. mixing: every source's documents as often as its budget of words takes them whole.
5. BPE: ids of the texts.

Stages return the columns of ``documents``, extra columns included, but for the last, which returns doc_id, n_tokens, ids_sha256 and
decoded_sha256. Null texts count as empty throughout; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabprobe.llm import bpe, exact_dedup, mixing, ngram_jaccard, queries, toxicity
from tabprobe.llm.common import shared_checkpoints


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, fitted on labels outside the held-out third, scores below 0.7. Null texts score like empty ones; repeated rows share their fate."""
    return toxicity.keep_clean(docs, queries.read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z, the row with the largest id. Null and empty texts are equal; of rows that share that id, too, one stays."""
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row with the smallest id. Documents without words are no copies of each other."""
    return ngram_jaccard.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it whole, possibly never. Rows that repeat id and text are taken equally often."""
    return mixing.mixed(docs, queries.read(spark, sf_dir, "labels"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null texts count as empty."""
    return bpe.encode(docs, queries.vocabulary_path(), carry=["doc_id"], digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: The fitted model, the hashed keys and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written to the shared folder as Parquet and read back for the next."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = queries.read(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}-{name}")
        docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return docs
