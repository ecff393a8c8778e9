"""Audio lists, manifests and line-aligned label files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_stem, strip, tokens
from ..operators.filters import filter_by_size
from ..operators.ordering import file_order, ordered_scan
from .byte_ranges import read_ranges, scan_line_ranges
from .lines import read_lines, write_lines

# The manifest's columns, in file order.
MANIFEST_COLUMNS = ("id", "audio", "n_frames", "tgt_text")


def parse_audio_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """``path transcript`` lines to ``(id, wav_path, tgt_text)``; blank lines have no path."""
    words = lines.select(tokens(F.col(value)).alias("words")).where(F.size("words") > 0)
    path = F.get("words", F.lit(0))
    return words.select(
        path_stem(path).alias("id"),
        path.alias("wav_path"),
        F.array_join(F.slice("words", F.lit(2), F.size("words")), " ").alias("tgt_text"),
    )


def scan_audio_list(spark: SparkSession, path: str) -> DataFrame:
    """Read audio list files."""
    return parse_audio_list(spark.read.text(path))


# The escapes of a field, the backslash first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def escape_field(field: Column) -> Column:
    """Backslash, tab, newline and return as two characters each, so that a field stays on its line."""
    for plain, escaped in ESCAPES:
        field = F.replace(field, F.lit(plain), F.lit(escaped))
    return field


def unescape_field(field: Column) -> Column:
    """The inverse of ``escape_field``."""

    def part(x: Column) -> Column:
        for plain, escaped in ESCAPES[1:]:
            x = F.replace(x, F.lit(escaped), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(field, r"\\\\", -1), part), "\\")


def manifest_line(text: Column | None = None) -> Column:
    """The four manifest fields, escaped and tab-joined; ``text`` replaces ``tgt_text``."""
    values = {c: F.col(c).cast("string") for c in MANIFEST_COLUMNS}
    if text is not None:
        values["tgt_text"] = text
    return F.concat_ws("\t", *[F.coalesce(escape_field(v), F.lit("")) for v in values.values()])


def manifest_lines(manifest: DataFrame, order: str) -> DataFrame:
    """``(order, line)`` of a manifest; the header's ``order`` value is NULL, which sorts lowest."""
    return _with_header(manifest, order).select(order, _line_or_header(order, None).alias("line"))


def _with_header(manifest: DataFrame, order: str) -> DataFrame:
    header = manifest.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in manifest.schema.fields]
    )
    return header.unionByName(manifest)


def _line_or_header(order: str, text: Column | None) -> Column:
    return F.when(F.col(order).isNull(), F.lit("\t".join(MANIFEST_COLUMNS))).otherwise(manifest_line(text))


def write_manifest(manifest: DataFrame, order: str, path: str, text: Column | None = None) -> None:
    """Write a TSV manifest in ``order``, header first."""
    rows = _with_header(manifest, order)
    write_lines(rows, _line_or_header(order, text), [F.col(order).asc_nulls_first()], path)


def scan_manifest(
    spark: SparkSession, path: str, min_keep: int | None = None, max_keep: int | None = None
) -> DataFrame:
    """``(ind, path, n_frames)`` of a manifest.

    The first line is the root and is not a sample. ``ind`` counts the lines
    after it *before* the size filter, because label files align with those.
    """
    lines = read_lines(spark, path).where(F.col("line_no") > 0)
    fields = lines.select("line_no", F.split(strip(F.col("value")), "\t").alias("fields"))
    # Tied to ``line_no``, so that the root line is never read as a sample.
    size = F.when(F.size("fields") < 3, F.raise_error(F.lit("a manifest line has fewer than 3 fields"))).otherwise(
        F.get("fields", F.lit(2)).cast("bigint")
    )
    samples = fields.select(
        (F.col("line_no") - 1).alias("ind"),
        unescape_field(F.get("fields", F.lit(1))).alias("path"),
        F.when(F.col("line_no") > 0, size).alias("n_frames"),
    )
    return filter_by_size(samples, "n_frames", min_keep, max_keep)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(ind, id, audio, n_frames, tgt_text)`` as they were written; NULL texts come back empty."""
    lines = read_lines(spark, path).where(F.col("line_no") > 0)
    fields = F.split("value", "\t")
    return lines.select(
        (F.col("line_no") - 1).alias("ind"),
        *[unescape_field(F.get(fields, F.lit(i))).alias(c) for i, c in enumerate(MANIFEST_COLUMNS)],
    ).withColumn("n_frames", F.col("n_frames").cast("int"))


def scan_labels(
    spark: SparkSession,
    path: str,
    label_set: str,
    label_rate: float,
    process: Callable[[Column], Column] = tokens,
) -> DataFrame:
    """``(label_set, label_rate, ind, tokens)``: line i belongs to manifest sample i.

    ``process`` turns a line into its labels: any column function, a pandas UDF included.
    """
    lines = read_lines(spark, path, "ind")
    return lines.select(
        F.lit(label_set).alias("label_set"),
        F.lit(float(label_rate)).alias("label_rate"),
        "ind",
        process(F.col("value")).alias("tokens"),
    )


def label_offsets(labels: DataFrame, file: str, order: str, line: str) -> DataFrame:
    """Byte ``start`` and ``end`` (without the newline) of every line within its file."""
    sized = labels.withColumn("_bytes", F.octet_length(line).cast("bigint") + 1)
    placed = ordered_scan(sized.drop(line), [F.col(order)], [file], sums={"start": "_bytes"})
    return placed.withColumn("end", F.col("start") + F.col("_bytes") - 1).drop("_bytes")


def scan_label_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(ind, file, start, end)`` of the label files under ``path``: where line i is, without its text."""
    lines = scan_line_ranges(spark, path, text=False).drop("line")
    placed = ordered_scan(lines, [*file_order("file"), F.col("start")], position="ind")
    return placed.select("ind", "file", "start", "end")


def read_labels(
    places: DataFrame,
    label_set: str,
    label_rate: float,
    process: Callable[[Column], Column] = tokens,
) -> DataFrame:
    """``(label_set, label_rate, ind, tokens)`` of the samples in ``places`` ``(ind, file, start, end)``.

    Only the bytes of these lines are read, and small gaps between them.
    """
    lines = read_ranges(places.select("ind", "file", "start", "end"))
    return lines.select(
        F.lit(label_set).alias("label_set"),
        F.lit(float(label_rate)).alias("label_rate"),
        "ind",
        process(F.col("line")).alias("tokens"),
    )
