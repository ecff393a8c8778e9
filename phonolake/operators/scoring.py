"""Scoring: edit distance, error rates, masked-prediction sums, throughput."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import argmax, cross_entropy
from .edit_distance import distances


def with_edit_distance(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add unit-cost edit distances; ``pairs`` maps a new column to two token-array columns.

    Arrow batches of the two columns go through a bit-parallel distance over token
    numbers: any token type, any number of distinct tokens, texts of any length. A missing side is an
    empty one, a NULL token a token like others.
    """

    @F.arrow_udf("bigint")
    def edits(left: pa.Array, right: pa.Array) -> pa.Array:
        return distances(left, right)

    return df.select("*", *[edits(left, right).alias(new) for new, (left, right) in pairs.items()])


def error_rate(errors: Column, total: Column) -> Column:
    """Errors per hundred reference tokens; NULL when there is no reference."""
    return F.try_divide(errors * F.lit(100.0), total)


def score_pairs(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Per sentence: ``err`` edits and ``n_ref`` reference tokens."""
    scored = with_edit_distance(df, {"err": (hyp, ref)})
    return scored.withColumn("n_ref", F.coalesce(F.size(ref), F.lit(0)).cast("bigint"))


def corpus_error_rate(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum first, divide once: never a mean of sentence rates."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_sent"),
        F.sum("err").alias("err"),
        F.sum("n_ref").alias("n_ref"),
        error_rate(F.sum("err"), F.sum("n_ref")).alias("wer"),
    )


def error_totals(
    df: DataFrame,
    units: tuple[str, str],
    words: tuple[str, str],
    split: str,
    decoded_words: str | None = None,
) -> DataFrame:
    """Unit and word error sums per split and over all.

    ``units`` and ``words`` are (hypothesis, reference) columns. Where an outer
    decoder gave words of its own they count in ``w_errors``; ``wv_errors``
    always scores the best path.
    """
    pairs = {"c_err": units, "wv_err": words}
    if decoded_words is not None:
        df = df.withColumn("_final", F.coalesce(decoded_words, words[0]))
        pairs["w_err"] = ("_final", words[1])
    scored = with_edit_distance(df, pairs)
    if decoded_words is None:
        scored = scored.withColumn("w_err", F.col("wv_err"))
    sums = scored.select(
        split,
        "c_err",
        F.size(units[1]).cast("bigint").alias("c_len"),
        "w_err",
        F.size(words[1]).cast("bigint").alias("w_len"),
        "wv_err",
    )
    totals = sums.rollup(split).agg(
        F.grouping(split).cast("int").alias("is_total"),
        F.sum("c_err").alias("c_errors"),
        F.sum("c_len").alias("c_total"),
        F.sum("w_err").alias("w_errors"),
        F.sum("w_len").alias("w_total"),
        F.sum("wv_err").alias("wv_errors"),
    )
    return (
        totals.withColumn("uer", error_rate(F.col("c_errors"), F.col("c_total")))
        .withColumn("wer", error_rate(F.col("w_errors"), F.col("w_total")))
        .withColumn("raw_wer", error_rate(F.col("wv_errors"), F.col("w_total")))
    )


def mask_partition(df: DataFrame, padded: str = "padded", masked: str = "masked") -> DataFrame:
    """Name each position's part: ``masked``, ``unmasked`` or ``padding``."""
    part = F.when(F.col(padded), "padding").when(F.col(masked), "masked").otherwise("unmasked")
    return df.withColumn("part", part)


def concat_heads(heads: Sequence[DataFrame]) -> DataFrame:
    """Rows of every prediction head under each other, with a ``head`` number."""
    stacked = heads[0].withColumn("head", F.lit(0))
    for number, head in enumerate(heads[1:], start=1):
        stacked = stacked.unionByName(head.withColumn("head", F.lit(number)))
    return stacked


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every row twice, told apart by ``copy``: the doubled batch of a consistency loss."""
    return df.withColumn("copy", F.lit(0)).unionByName(df.withColumn("copy", F.lit(1)))


def with_frame_loss(df: DataFrame, logits: str, target: str, temperature: float = 1.0) -> DataFrame:
    """Add the cross-entropy ``nll`` and whether the best class is the target, ``hit``."""
    return df.withColumn("nll", cross_entropy(F.col(logits), F.col(target), temperature)).withColumn(
        "hit", (argmax(F.col(logits)) == F.col(target)).cast("int")
    )


def masked_accuracy(df: DataFrame, masked: str = "masked", hit: str = "hit") -> DataFrame:
    """Right and all predictions for masked and unmasked positions."""
    return df.groupBy(masked).agg(
        F.sum(hit).cast("bigint").alias("correct"),
        F.count("*").alias("count"),
        F.try_divide(F.sum(hit), F.count("*")).alias("accuracy"),
    )


def loss_report(
    df: DataFrame,
    masked: str = "masked",
    masked_weight: float = 1.0,
    unmasked_weight: float = 0.0,
    sentence: str | None = None,
    log_keys: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row of masked and unmasked sums and the weighted loss.

    A part with weight 0 is reported but adds nothing to ``loss`` or
    ``sample_size``. ``log_keys`` maps extra numeric columns, where present, to
    ``avg`` or ``sum``.
    """
    inside, outside = F.col(masked), ~F.col(masked)
    sums = [
        F.coalesce(F.sum(F.when(inside, F.col("nll"))), F.lit(0.0)).alias("loss_m"),
        F.coalesce(F.sum(F.when(outside, F.col("nll"))), F.lit(0.0)).alias("loss_u"),
        F.count_if(inside).alias("count_m"),
        F.count_if(outside).alias("count_u"),
        F.count_if(inside & (F.col("hit") == 1)).alias("correct_m"),
        F.count_if(outside & (F.col("hit") == 1)).alias("correct_u"),
    ]
    if sentence is not None:
        sums.append(F.count_distinct(sentence).alias("nsentences"))
    for key, how in (log_keys or {}).items():
        if key in df.columns:
            sums.append({"avg": F.avg, "sum": F.sum}[how](key).alias(key))
    report = df.agg(*sums)
    use_m, use_u = masked_weight > 0, unmasked_weight > 0
    loss = (F.col("loss_m") * masked_weight if use_m else F.lit(0.0)) + (
        F.col("loss_u") * unmasked_weight if use_u else F.lit(0.0)
    )
    size = (F.col("count_m") if use_m else F.lit(0)) + (F.col("count_u") if use_u else F.lit(0))
    return report.withColumn("loss", loss).withColumn("sample_size", size.cast("bigint"))


def throughput(df: DataFrame, tokens: str, seconds: str, by: Sequence[str] = ()) -> DataFrame:
    """Sentences and tokens per second, from one row per sentence."""
    return with_rates(
        df.groupBy(*by).agg(
            F.count("*").alias("sentences"),
            F.sum(tokens).cast("bigint").alias("tokens"),
            F.sum(seconds).alias("seconds"),
        )
    )


def sequence_loss_report(
    df: DataFrame, nll: str, n_tokens: str, sentence_avg: bool, by: Sequence[str] = ()
) -> DataFrame:
    """Summed sequence losses; ``sample_size`` counts sentences if they are averaged, else target tokens."""
    sums = df.groupBy(*by).agg(
        F.coalesce(F.sum(nll), F.lit(0.0)).alias("loss"),
        F.coalesce(F.sum(n_tokens), F.lit(0)).cast("bigint").alias("ntokens"),
        F.count("*").alias("nsentences"),
    )
    return sums.withColumn("sample_size", F.col("nsentences" if sentence_avg else "ntokens"))


def with_rates(sums: DataFrame) -> DataFrame:
    """Rates from the sums. With no token at all the mean time per token is the whole time."""
    seconds = F.col("seconds")
    per_token = F.coalesce(F.try_divide(seconds, F.col("tokens")), seconds)
    return sums.withColumn("sentences_per_s", F.col("sentences") / (seconds + F.lit(1e-6))).withColumn(
        "tokens_per_s", 1 / (per_token + F.lit(1e-6))
    )


def best_hypothesis(df: DataFrame, key: str, score: str, rank: str, keep: Sequence[str]) -> DataFrame:
    """The top of each n-best list: highest score, then lowest rank.

    An aggregate rather than a window, so each task sends on one row per key.
    """
    best = F.max_by(F.struct(score, rank, *keep), F.struct(F.col(score), -F.col(rank)))
    return df.groupBy(key).agg(best.alias("best")).select(key, "best.*")
