"""Symbol dictionaries: building, reading, encoding, decoding, vocabulary checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import as_lists, kept_sizes, look_up, share_table
from ..operators.ordering import ordered_scan
from .lines import read_lines, write_lines

# Ids of the special symbols, which come before all others.
BOS, PAD, EOS, UNK = 0, 1, 2, 3
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")


def _specials(spark: SparkSession) -> DataFrame:
    rows = spark.range(len(SPECIALS)).select(F.col("id").cast("int").alias("id"))
    symbols = F.array(*[F.lit(s) for s in SPECIALS])
    return rows.select(F.get(symbols, F.col("id")).alias("symbol"), "id", F.lit(0).cast("bigint").alias("n"))


def build_dictionary(df: DataFrame, tokens: str, min_count: int = 1) -> DataFrame:
    """``(symbol, id, n)``: specials, then symbols by falling count and rising symbol."""
    counts = (
        df.select(F.explode(tokens).alias("symbol"))
        .groupBy("symbol")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") >= min_count) & ~F.col("symbol").isin(*SPECIALS))
    )
    placed = ordered_scan(counts, [F.col("n").desc(), F.col("symbol").asc()], position="at")
    ranked = placed.select("symbol", (F.col("at") + len(SPECIALS)).cast("int").alias("id"), "n")
    return _specials(df.sparkSession).unionByName(ranked)


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Read ``symbol count`` lines; ids follow line order after the specials."""
    lines = read_lines(spark, path)
    fields = F.split("value", " ")
    listed = lines.select(
        F.element_at(fields, 1).alias("symbol"),
        (F.col("line_no") + len(SPECIALS)).cast("int").alias("id"),
        F.try_element_at(fields, F.lit(2)).cast("bigint").alias("n"),
    )
    return _specials(spark).unionByName(listed)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Write the symbols after the specials as ``symbol count`` lines."""
    listed = dictionary.where(F.col("id") >= len(SPECIALS))
    write_lines(listed, F.concat_ws(" ", "symbol", "n"), [F.col("id").asc()], path)


def _regrouped(df: DataFrame, key: str, out: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("pos", "found")))
    return df.groupBy(key).agg(F.transform(ordered, lambda p: p["found"]).alias(out))


def _looked_up(df: DataFrame, key: str, values: str, dictionary: DataFrame, on: str) -> DataFrame:
    """Look every array element up; an empty array keeps one row with a NULL element."""
    spread = df.select(key, F.posexplode_outer(values).alias("pos", on))
    return spread.join(dictionary, on, "left")


def _encode_joined(df: DataFrame, key: str, tokens: str, dictionary: DataFrame, out: str) -> DataFrame:
    found = _looked_up(df, key, tokens, dictionary, "symbol")
    coded = found.withColumn("found", F.when(F.col("pos").isNotNull(), F.coalesce("_value", F.lit(UNK))))
    encoded = _regrouped(coded, key, out)
    return encoded.withColumn(out, F.filter(out, lambda i: i.isNotNull()))


def encode_tokens(df: DataFrame, key: str, tokens: str, dictionary: DataFrame, out: str = "ids") -> DataFrame:
    """``(key, out)``: token arrays as ids, unknown tokens as ``<unk>``, no end symbol added; NULL is empty.

    The tasks look distinct tokens up a batch at a time, so nothing is shuffled. Only a dictionary too large to
    send to them is joined, a row a token; that way needs a unique ``key``.
    """
    stored, table = share_table(dictionary, "symbol", "id")
    if table is None:
        return _encode_joined(df, key, tokens, stored, out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, _, ids = look_up(table.value, batch.column(1))
            coded = as_lists(sizes, ids.cast(pa.int32()).fill_null(UNK))
            yield pa.RecordBatch.from_arrays([batch.column(0), coded], [key, out])

    rows = df.select(key, tokens)
    return rows.mapInArrow(task, T.StructType([rows.schema[0], T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _decode_joined(df: DataFrame, key: str, ids: str, dictionary: DataFrame, out: str, skip: Sequence[int]) -> DataFrame:
    found = _looked_up(df, key, ids, dictionary, "id")
    shown = F.col("pos").isNotNull() & ~F.coalesce(F.col("id").isin(*skip), F.lit(False))
    named = found.withColumn("found", F.when(shown, F.coalesce("_value", F.lit(SPECIALS[UNK]))))
    return _regrouped(named, key, out).withColumn(out, F.array_join(out, " "))


def decode_ids(
    df: DataFrame, key: str, ids: str, dictionary: DataFrame, out: str = "units", skip: Sequence[int] = (BOS, EOS)
) -> DataFrame:
    """``(key, out)``: id arrays as space-joined symbols; ``skip`` are left out, ids of no symbol are ``<unk>``.

    NULL gives an empty text. Looked up as in ``encode_tokens``.
    """
    stored, table = share_table(dictionary, "id", "symbol")
    if table is None:
        return _decode_joined(df, key, ids, stored, out, skip)
    left_out = list(skip)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, elements, names = look_up(table.value, batch.column(1))
            shown = ~pc.is_in(elements, value_set=pa.array(left_out, elements.type)).to_numpy(zero_copy_only=False)
            words = names.fill_null(SPECIALS[UNK]).filter(pa.array(shown))
            texts = pc.binary_join(as_lists(kept_sizes(sizes, shown), words), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], [key, out])

    rows = df.select(key, ids)
    return rows.mapInArrow(task, T.StructType([rows.schema[0], T.StructField(out, T.StringType())]))


def _check_joined(df: DataFrame, key: str, hyp: str, ref: str, vocabulary: DataFrame) -> DataFrame:
    both = df.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit("hyp").alias("side"), F.col(hyp).alias("tokens")),
                F.struct(F.lit("ref").alias("side"), F.col(ref).alias("tokens")),
            )
        ).alias("s"),
    )
    spread = both.select(key, "s.side", F.posexplode_outer("s.tokens").alias("pos", "symbol"))
    looked = spread.join(vocabulary.select("symbol", F.lit(True).alias("known")), "symbol", "left")
    is_hyp, is_ref = F.col("side") == "hyp", F.col("side") == "ref"
    missing = F.col("known").isNull() & F.col("pos").isNotNull()
    kept = F.collect_list(F.when(is_hyp & F.col("known"), F.struct("pos", "symbol")))
    return looked.groupBy(key).agg(
        F.transform(F.sort_array(kept), lambda p: p["symbol"]).alias(hyp),
        F.count_if(is_hyp & missing).alias("n_dropped"),
        F.count_if(is_ref & missing).alias("n_ref_missing"),
    )


def check_vocabulary(df: DataFrame, key: str, hyp: str, ref: str, vocabulary: DataFrame) -> DataFrame:
    """Hypothesis tokens outside the vocabulary are dropped, reference tokens only reported.

    Gives ``(key, hyp, n_dropped, n_ref_missing)``. Looked up as in ``encode_tokens``.
    """
    stored, table = share_table(vocabulary, "symbol", "symbol")
    if table is None:
        return _check_joined(df, key, hyp, ref, stored)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, known = look_up(table.value, batch.column(1))
            kept = known.is_valid().to_numpy(zero_copy_only=False)
            left = kept_sizes(sizes, kept)
            ref_sizes, _, ref_known = look_up(table.value, batch.column(2))
            ref_left = kept_sizes(ref_sizes, ref_known.is_valid().to_numpy(zero_copy_only=False))
            columns = [batch.column(0), as_lists(left, words.filter(pa.array(kept)))]
            counts = [pa.array((a - b).astype(np.int64)) for a, b in ((sizes, left), (ref_sizes, ref_left))]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [key, hyp, "n_dropped", "n_ref_missing"])

    rows = df.select(key, F.col(hyp).alias("_hyp"), F.col(ref).alias("_ref"))
    fields = [rows.schema[0], T.StructField(hyp, T.ArrayType(T.StringType()))]
    counts = [T.StructField(c, T.LongType(), False) for c in ("n_dropped", "n_ref_missing")]
    return rows.mapInArrow(task, T.StructType([*fields, *counts]))
