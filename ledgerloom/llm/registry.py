"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, burst_trie, exact_dedup, html_wrappers, near_dedup, packing, pii, quality, resharding, secrets, token_counts, toxicity, whitening
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf_dir, "documents"))


def op4_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op5_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digest(table(spark, sf_dir, "documents"))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.resolve(table(spark, sf_dir, "documents"))


def op10_inferred_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_burst_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


def op13_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts,
        op2_best_fit_packing,
        op3_exact_dedup,
        op4_suffix_array_quality,
        op5_min_cost_flow_resharding,
        op6_boosted_pii,
        op7_speculative_bpe,
        op8_counterfactual_toxicity,
        op9_circulant_minhash,
        op10_inferred_wrappers,
        op11_polarised_whitening,
        op12_burst_tries,
        op13_linked_secrets,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE}
