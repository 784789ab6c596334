"""From raw documents to training order; each stage works on all that the one before kept.

1. quality: rules vote, documents below even odds of being good go.
2. near_duplicates: one document of each group of near copies stays.
3. secrets: secrets in the texts are replaced by a mark; no document goes.
4. mix: documents are repeated or left out until sources have their target weights, in training order.
5. tokens: token ids, their number and the decoded text of every document.

Stages 1 to 4 return the columns of ``documents``. All keep rows with null columns; a null text fails the base quality
rule. ``run`` writes each stage's result to the cluster's shared folder and reads it again, so a lost executor costs one
stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe_trie, minhash_forest, mixing, quality, secrets
from touchline.llm.common import small_batches
from touchline.session import checkpoint_dir

MARK = "<SECRET>"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash_forest.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = secrets.scan(docs, secrets.learn(docs), redact=MARK)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.in_training_order(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    return bpe_trie.encode(docs, public_tokenizers.path(bpe_trie.VOCABULARY), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", training_order),
    ("tokens", to_tokens),
]

#: Expectation-maximisation, a forest and greedy encoding have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
