"""Corpus cleaning over ``documents``: five stages in order, each written as Parquet and read again
before the next, after which the stage before is deleted. All but the last return the columns of the documents they get.

1. quality_rules: texts that fail the repetition rules go.
2. exact_dedup: of texts equal but for the case of A-Z, the row with the largest doc_id stays.
3. near_dedup: of linked documents, the one with the smallest doc_id stays.
4. pii: found spans are replaced by their kind; n_chars follows.
5. packing: the remaining documents as pieces in sequences of at most 2048 tokens.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.scratch import discard
from ledgerloom.llm import exact_dedup, near_dedup, packing, pii, quality
from ledgerloom.llm.common import shared_dir, table
from ledgerloom.llm.registry import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: SQL expresses neither the suffix-array verdict nor the boosted spans nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{number}-{name}")
        docs = spark.read.parquet(f"{at}/{number}-{name}")
        if number:
            discard(spark, f"{at}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
