"""Text lines with their file position, and ordered line output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import line_index
from ..session import materialise


def read_lines(spark: SparkSession, path: str, index: str = "line_no") -> DataFrame:
    """``(value, file, line_no)`` of all lines under ``path``, numbered in (file, offset) order.

    The text is scanned once and written with its blocks: a later scan may cut files into other blocks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return line_index(materialise(lines, "lines"), index)


def write_lines(
    df: DataFrame, line: Column, order: Sequence[Column], path: str, folders: Sequence[str] = ()
) -> None:
    """Write ``line`` as text; file names follow ``order``, so a later scan sees it again.

    ``folders`` are columns that split the output into ``column=value`` folders.
    The line is put together after the sort, which reads its input twice.
    """
    keys = [F.col(c).asc() for c in folders] + list(order)
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.select(*folders, line.alias("value")).write.partitionBy(*folders).text(path)
