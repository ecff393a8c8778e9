"""Cleaning of a document table in five stages, each one of the operators of ``phonolake.llm``.

Every stage takes (spark, docs, folder of tables) and returns the rows it keeps with the
columns of ``documents``; it is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.cube import mix_sources
from phonolake.llm.recompression import without_repeats
from phonolake.llm.simhash import near_duplicates
from phonolake.llm.spaced_seeds import find_leaks
from phonolake.llm.text import id_key
from phonolake.llm.toxicity import score_toxicity
from phonolake.session import materialise

KEY = ["doc", "tag"]


def with_key(docs: DataFrame) -> DataFrame:
    """Each row as a struct beside its key, so that no column of it can clash with the key's."""
    tag = F.hash(F.col("text").cast("string")).alias("tag")
    return docs.select(F.struct("*").alias("row"), id_key("doc_id").alias("doc"), tag)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    scores = score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = scores.filter("predicted = 1").select(*KEY).distinct()
    return with_key(docs).join(toxic.hint("shuffle_hash"), KEY, "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    found = near_duplicates(docs, shingle=3, bits=3)
    lead = found.filter("doc = first.doc AND tag = first.tag").select(*KEY).distinct()
    kept = with_key(docs).join(lead.hint("shuffle_hash"), KEY, "left_semi")
    return kept.dropDuplicates(KEY).select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has go from the texts."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    leaks = find_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).select(*KEY).distinct()
    return with_key(docs).join(leaks.hint("shuffle_hash"), KEY, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole documents, up to three times each, by target weights; ``copy`` (put in place of any) numbers them from 1."""
    taken = mix_sources(docs).filter("repeats > 0").groupBy(*KEY).agg(F.sum("repeats").alias("repeats"))
    rows = with_key(docs).join(taken.hint("shuffle_hash"), KEY).dropDuplicates(KEY)
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy")
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "copy"], copies)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("mix_sources", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
