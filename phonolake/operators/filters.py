"""Size filters and the label checks that go with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_status(size: Column, min_keep: int | None, max_keep: int | None) -> Column:
    """``short``, ``long`` or ``kept``; bounds are inclusive and short is tested first."""
    status = F.lit("kept")
    if max_keep is not None:
        status = F.when(size > max_keep, "long").otherwise(status)
    if min_keep is not None:
        status = F.when(size < min_keep, "short").otherwise(status)
    return status


def filter_by_size(df: DataFrame, size: str, min_keep: int | None = None, max_keep: int | None = None) -> DataFrame:
    """Keep sizes within the bounds; plain comparisons, so they reach the Parquet scan."""
    if min_keep is not None:
        df = df.where(F.col(size) >= min_keep)
    if max_keep is not None:
        df = df.where(F.col(size) <= max_keep)
    return df


def size_rejects(df: DataFrame, size: str, min_keep: int | None = None, max_keep: int | None = None) -> DataFrame:
    """What ``filter_by_size`` leaves out, with the ``reason``."""
    return df.withColumn("reason", size_status(F.col(size), min_keep, max_keep)).where(F.col("reason") != "kept")


def load_summary(df: DataFrame, size: str, min_keep: int | None = None, max_keep: int | None = None) -> DataFrame:
    """One row: loaded, short, long, longest and shortest kept, total; one pass."""
    status = size_status(F.col(size), min_keep, max_keep)
    kept = F.when(status == "kept", F.col(size))
    return df.agg(
        F.count(kept).alias("loaded"),
        F.count_if(status == "short").alias("n_short"),
        F.count_if(status == "long").alias("n_long"),
        F.max(kept).alias("longest"),
        F.min(kept).alias("shortest"),
        F.count("*").alias("total"),
    )


def drop_null_source(df: DataFrame, source: str) -> DataFrame:
    """Samples without a source do not take part; a batch of none disappears."""
    return df.where(F.col(source).isNotNull())


def align_labels(manifest: DataFrame, labels: DataFrame, on: str = "ind") -> DataFrame:
    """Labels of the kept samples, by line number."""
    return manifest.join(labels, on, "inner")


def multi_label(labels: DataFrame, key: str, label_set: str, value: str, label_sets: list[str]) -> DataFrame:
    """One row per sample with a column per label set."""
    return labels.groupBy(key).pivot(label_set, label_sets).agg(F.first(value))


def label_count_check(manifest: DataFrame, labels: DataFrame, label_set: str = "label_set") -> DataFrame:
    """Per label set: its lines, the manifest's lines, and whether they agree."""
    total = manifest.agg(F.count("*")).scalar()
    lines = labels.groupBy(label_set).agg(F.count("*").alias("n_labels"))
    return lines.withColumn("n_samples", total).withColumn("agrees", F.col("n_labels") == F.col("n_samples"))


def verify_label_lengths(
    df: DataFrame, size: str, sample_rate: float, n_labels: str, label_rate: str, tolerance: float = 0.1
) -> DataFrame:
    """Flag samples whose audio and label durations differ by more than ``tolerance`` seconds.

    Sequence labels (rate -1) have no duration and are never flagged; nothing is dropped.
    """
    gap = F.abs(F.col(size) / sample_rate - F.col(n_labels) / F.col(label_rate))
    timed = F.when(F.col(label_rate) > 0, gap)
    return df.withColumn("gap_s", timed).withColumn("mismatch", F.coalesce(F.col("gap_s") > tolerance, F.lit(False)))


def label_length_summary(verified: DataFrame, label_set: str = "label_set") -> DataFrame:
    """Checked and mismatched samples per label set."""
    return verified.groupBy(label_set).agg(
        F.count("gap_s").alias("n_checked"),
        F.count_if("mismatch").alias("n_mismatch"),
        F.max("gap_s").alias("max_gap_s"),
    )
