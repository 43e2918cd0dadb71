"""Queries of this subpackage: one ``opN_<name>`` per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import chat, decontamination, fingerprints, html, mixing, neardup, quality, substrings, tokens, toxicity
from weftgraph.llm.shared import table, written


TOKENIZER = "word_bpe_49k.json"


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(written(chat.format_chat(chat.with_probe(table(spark, sf_dir, "conversations"))), "chat"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_html": op2_html, "op3_substrings": op3_substrings, "op4_tokens": op4_tokens, "op5_toxicity": op5_toxicity, "op6_chat": op6_chat, "op7_decontamination": op7_decontamination, "op8_fingerprints": op8_fingerprints, "op9_quality": op9_quality, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.ORACLE, "op10_mixing": mixing.ORACLE}
