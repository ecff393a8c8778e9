"""Picking rows by position within an ordered group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ordered_scan


def get_or_last(df: DataFrame, key: str, order: Sequence[Column], value: str, indexes: Sequence[int]) -> DataFrame:
    """``(key, layer, value)``: per wanted 0-based index the row there, else the key's last row.

    Both are the last row at or before the index, which an aggregate finds
    without gathering a key's rows.
    """
    placed = ordered_scan(df, order, [key], position="_at")
    picks = [
        F.max_by(value, F.when(F.col("_at") <= i, F.col("_at"))).alias(f"at_{i}") for i in indexes
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("layer"), F.col(f"at_{i}").alias(value)) for i in indexes])
    return placed.groupBy(key).agg(*picks).select(key, F.inline(rows))


def collapse_repeats(df: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Keep rows whose value differs from the row before in the group; the tall form of collapsing."""
    marked = ordered_scan(df, order, [key], position="_at", previous={"_before": value})
    kept = marked.where((F.col("_at") == 0) | ~F.col(value).eqNullSafe(F.col("_before")))
    return kept.drop("_at", "_before")
