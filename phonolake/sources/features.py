"""Feature frames and normalisation statistics on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES_SCHEMA = T.StructType(
    [
        T.StructField("utt_id", T.LongType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("feat", T.ArrayType(T.FloatType())),
        T.StructField("unit", T.IntegerType()),
    ]
)

STATS_SCHEMA = T.StructType(
    [
        T.StructField("n_frame", T.LongType()),
        T.StructField("sum", T.ArrayType(T.DoubleType())),
        T.StructField("sumsq", T.ArrayType(T.DoubleType())),
        T.StructField("mean", T.ArrayType(T.FloatType())),
        T.StructField("std", T.ArrayType(T.FloatType())),
    ]
)


def write_frames(frames: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Frames as Parquet, an utterance's frames side by side in one file.

    One table of many utterances per file stands in for one small file per utterance.
    """
    frames.repartitionByRange("utt_id", "frame_idx").sortWithinPartitions("utt_id", "frame_idx").write.partitionBy(
        *partition_by
    ).parquet(path)


def save_frames_table(frames: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Frames as a catalogue table bucketed by utterance: joins and groups on it need no shuffle."""
    writer = frames.repartition(buckets, "utt_id").write.bucketBy(buckets, "utt_id").sortBy("utt_id", "frame_idx")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_frames(spark: SparkSession, path: str, schema: T.StructType = FRAMES_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """The one-row statistics table."""
    stats.coalesce(1).write.parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).parquet(path)


def stats_lines(stats: DataFrame, decimals: int | None = None) -> DataFrame:
    """The text form: frame count, sums, sums of squares, one line each.

    Numbers print in full unless ``decimals`` is given; each is followed by a blank.
    """

    def text(values: str):
        if decimals is None:
            shown = F.transform(values, lambda x: x.cast("string"))
        else:
            shown = F.transform(values, lambda x: F.format_string(f"%.{decimals}f", x))
        return F.concat(F.array_join(shown, " "), F.lit(" "))

    rows = F.array(F.col("n_frame").cast("string"), text("sum"), text("sumsq"))
    return stats.select(F.posexplode(rows).alias("line_no", "line"))
