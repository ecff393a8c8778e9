"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from phonolake.llm import sql, sql_merkle
from phonolake.llm.context_mixing import score_texts
from phonolake.llm.cube import mix_sources
from phonolake.llm.merkle import FIELDS, build_manifest, fold, leaf_of, leaves, proof_text
from phonolake.llm.quality import score_quality
from phonolake.llm.recompression import dedup_substrings
from phonolake.llm.repair import damage, group_of, repair_conversations
from phonolake.llm.repetition import judge_repetition
from phonolake.llm.reputation import filter_urls
from phonolake.llm.simhash import near_duplicate_report
from phonolake.llm.spaced_seeds import find_leaks
from phonolake.llm.suffixes import remove_repeats
from phonolake.llm.text import public_id
from phonolake.llm.token_files import read_token_files, write_token_files
from phonolake.llm.toxicity import score_toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_substrings(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    out = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select(public_id(), "held_out", "score", "predicted")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    out = score_texts(table(spark, folder, "documents"))
    return out.select(public_id(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_report(table(spark, folder, "documents"), shingle=3, bits=3)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    out = mix_sources(table(spark, folder, "documents"))
    return out.select(public_id(), "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_repetition(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    out = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select(public_id(), "held_out", "score", "predicted")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks: one row per contaminated document and benchmark item."""
    out = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(public_id(), "item_id", "start", "n_tokens", "n_matched")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    out = filter_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, and the root that each document leads to; one in five is tampered with: its A-Z are lower-cased."""
    docs = table(spark, folder, "documents")
    lowered = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    fields = [*[F.col(f"`{c}`") for c in FIELDS if c != "text"], lowered]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(fields))
    out = build_manifest(leaves(docs, changed=tampered))
    folded = fold(F.coalesce("changed", "leaf"))
    return out.select(
        public_id(),
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as read back from the files."""
    files = write_token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_token_files(files).select(public_id(), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and repair of every conversation after damage; one without rows has nothing to repair."""
    conversations = table(spark, folder, "conversations")
    found = repair_conversations(damage(conversations)).drop("conv_id")
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), group_of("conv_id").alias("grp")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.coalesce("audit", F.lit("")).alias("audit")
    text = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return names.join(found, "grp", "left").select("conv_id", *counts, audit, text)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_files": op12_token_files,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL: dict[str, str] = {
    "op1_substring_dedup": sql.OP1,
    "op10_url_filter": sql.OP10,
    "op11_merkle_manifest": sql_merkle.OP11,
}
