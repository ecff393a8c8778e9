"""Views that let the test tables stand in for a speech corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import deal

LABEL_SETS = ["quality", "toxic"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def audio_path() -> Column:
    return F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".flac"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as utterances: characters are frames."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("ind"),
        F.col("source").alias("split"),
        audio_path().alias("path"),
        F.col("n_chars").alias("n_frames"),
        F.col("text").alias("tgt_text"),
    )


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token sequences: words are frames."""
    docs = deal(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    return words.withColumn("n_words", F.size("words"))


def line_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Two label sets under each other."""
    rows = F.array(*[F.struct(F.lit(s).alias("label_set"), F.col(s).alias("value")) for s in LABEL_SETS])
    return table(spark, folder, "labels").select(F.col("doc_id").alias("ind"), F.inline(rows))


def as_frames(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.expr("vec_id div 20").alias("utt_id"),
        (F.col("vec_id") % 20).cast("int").alias("frame_idx"),
        F.col("embedding").alias("feat"),
        F.col("label").alias("unit"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as feature frames, twenty to an utterance."""
    return as_frames(table(spark, folder, "embeddings"))


def unit_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Frame labels gathered per utterance; an utterance is twenty frames."""
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", "unit")))
    gathered = frames(spark, folder).groupBy("utt_id").agg(rows.alias("rows"))
    return gathered.select("utt_id", F.transform("rows", lambda r: r["unit"]).alias("units"))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as class scores with their target, mask and padding flags."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("logits"),
        F.col("label").alias("target"),
        (F.get("embedding", F.lit(0)) > 0).alias("masked"),
        (F.col("label") == 9).alias("padded"),
    )


def as_turns(conversations: DataFrame) -> DataFrame:
    """Turns as utterances; a conversation has fewer than a thousand turns."""
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), "role", "text")


def as_hyp_ref(turns: DataFrame) -> DataFrame:
    """Each turn against itself with every 11th word replaced and every 7th dropped."""
    refs = turns.select("utt_id", "role", tokens(F.col("text")).alias("ref"))
    noisy = F.transform("ref", lambda t, i: F.when((i + 1) % 11 == 0, "<x>").otherwise(t))
    return refs.withColumn("hyp", F.filter(noisy, lambda t, i: (i + 1) % 7 != 0))


def hyp_ref(spark: SparkSession, folder: str) -> DataFrame:
    return as_hyp_ref(deal(as_turns(table(spark, folder, "conversations")), "utt_id"))


def to_pieces(words: str) -> Column:
    """Words over three characters in two pieces."""
    cut = F.transform(
        words,
        lambda t: F.when(
            F.length(t) > 3, F.array(F.substring(t, 1, 3), F.concat(F.lit("##"), t.substr(F.lit(4), F.length(t))))
        ).otherwise(F.array(t)),
    )
    return F.flatten(cut)


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Event values as one signal per user."""
    return table(spark, folder, "events").select("user_id", "ts", "event_id", "value")


SIGNAL_ORDER = ("ts", "event_id")


def timings(events: DataFrame) -> DataFrame:
    """One row per sentence: tokens and seconds."""
    return events.select(
        "ts", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("value").alias("seconds")
    )
