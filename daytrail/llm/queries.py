"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from daytrail.llm import (fill_in_middle, html_extraction, lm_scoring, merkle, mixing, near_dedup, packing, quality, suffix_dedup,
                          token_binary, tool_calls, topk, warc)
from daytrail.llm.common import table
from daytrail.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every(table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_binary.token_files(docs, scratch_dir(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lm_scoring.Model(order=6))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_conversations(table(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_warc, op3_html_extraction, op4_quality_rules, op5_top_k_search, op6_source_mixing, op7_near_dedup, op8_lm_scoring, op9_token_binary,
    op10_chat_formatting, op11_fill_in_middle, op12_merkle_manifest, op13_suffix_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op2_warc": warc.ORACLE, "op5_top_k_search": topk.ORACLE, "op7_near_dedup": near_dedup.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE,
                           "op12_merkle_manifest": merkle.ORACLE, "op13_suffix_dedup": suffix_dedup.ORACLE}
