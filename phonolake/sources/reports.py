"""Hypothesis and reference files, shard merging, error-rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines, write_lines


def hyp_ref_line(text: Column, key: Column) -> Column:
    """Text and sample id; the speaker is not known to the scorer and always reads ``None``."""
    return F.concat(text, F.lit(" (None-"), key.cast("string"), F.lit(")"))


def hyp_ref_lines(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """One row per output kind and sentence: ``(kind, key, line)``.

    ``kinds`` maps an output name to its text column.
    """
    outputs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in kinds.items()])
    rows = df.select(key, F.explode(outputs).alias("o"))
    return rows.select(
        F.col("o.kind").alias("kind"), key, hyp_ref_line(F.col("o.text"), F.col(key)).alias("line")
    )


def write_outputs(df: DataFrame, key: str, kinds: dict[str, str], path: str) -> None:
    """Each output kind of a decoding run as lines in a folder ``kind=...`` of its own, in key order.

    A text with line breaks would be several lines; tokens joined by spaces have none.
    """
    write_lines(hyp_ref_lines(df, key, kinds), F.col("line"), [F.col(key).asc()], path, folders=["kind"])


def read_outputs(spark: SparkSession, path: str, key: str, key_type: str = "bigint") -> DataFrame:
    """``(kind, key, text, line)`` of what ``write_outputs`` wrote."""
    lines = spark.read.schema("value string, kind string").text(path)
    parts = r"^(.*) \(None-(.*)\)$"
    number = F.regexp_extract("value", parts, 2).cast(key_type)
    return lines.select("kind", number.alias(key), F.regexp_extract("value", parts, 1).alias("text"), F.col("value").alias("line"))


def write_shards(rows: DataFrame, line: Column, order: str, path: str, shard: str = "shard") -> None:
    """Each data-parallel shard's lines in a folder of its own."""
    named = rows.withColumn(shard, F.lpad(F.col(shard).cast("string"), 6, "0"))
    write_lines(named, line, [F.col(order).asc()], path, folders=[shard])


def merge_shards(spark: SparkSession, path: str, shard: str = "shard") -> DataFrame:
    """All shards' lines under each other, ``(merged_no, shard, line)``: shard order, then line order."""
    lines = read_lines(spark, path, "merged_no")
    number = F.regexp_extract("file", f"{shard}=(\\d+)", 1).cast("bigint")
    return lines.select("merged_no", number.alias(shard), F.col("value").alias("line"))


def report_text(wer: Column, errors: Column, total: Column, config: Column) -> Column:
    """Text of a report: rate, the two sums, a blank line, the run's configuration."""
    return F.concat(
        F.lit("WER: "),
        F.coalesce(wer.cast("string"), F.lit("nan")),
        F.lit("\nerr / num_ref_words = "),
        errors.cast("string"),
        F.lit(" / "),
        total.cast("string"),
        F.lit("\n\n"),
        config,
    )


def parse_reports(reports: DataFrame, text: str = "value") -> DataFrame:
    """``(wer, err, n_ref, config)`` of report texts."""
    sums = r"(?s)err / num_ref_words = (\d+) / (\d+)"
    body = F.col(text)
    return reports.select(
        *[c for c in reports.columns if c != text],
        F.regexp_extract(body, r"^WER: (\S+)", 1).try_cast("double").alias("wer"),
        F.regexp_extract(body, sums, 1).try_cast("bigint").alias("err"),
        F.regexp_extract(body, sums, 2).try_cast("bigint").alias("n_ref"),
        F.regexp_extract(body, r"(?s)^[^\n]*\n[^\n]*\n\n(.*)$", 1).alias("config"),
    )


def write_reports(reports: DataFrame, path: str, text: str = "value", run: str = "run_id") -> None:
    """One report a run, each a file in a folder ``run=...`` of its own."""
    reports.select(text, run).repartition(run).write.partitionBy(run).text(path)


def read_reports(spark: SparkSession, path: str, text: str = "value", run: str = "run_id", run_type: str = "bigint") -> DataFrame:
    """``(text, run)``: the reports as they were written, without the line break that ends a file."""
    files = spark.read.schema(f"{text} string, {run} {run_type}").text(path, wholetext=True)
    return files.select(F.regexp_replace(text, r"\n\z", "").alias(text), run)


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Read report files whole, one row each."""
    files = spark.read.text(path, wholetext=True)
    return parse_reports(files.select("value", F.col("_metadata.file_path").alias("file")))
