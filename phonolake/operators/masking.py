"""Span masks for masked prediction and band masks for augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import permuted, randint, round_keys, uniform


def span_mask(
    df: DataFrame,
    key: str,
    length: str,
    mask_prob: float,
    span: int = 10,
    min_spans: int = 2,
    seed: int = 0,
    epoch: int = 1,
) -> DataFrame:
    """Add ``masked``, the sorted positions under spans that cover about ``mask_prob``.

    The number of spans is rounded up or down by a seeded draw. Their starts are the
    first positions of a keyed permutation, hence without replacement, in about as many steps
    as there are spans; spans may overlap. All within the row: no shuffle.
    """
    base = (seed, epoch, F.col(key))
    n = F.col(length)
    wanted = F.floor(F.lit(mask_prob) * n / span + uniform("spans", *base)).cast("int")
    spans = F.greatest(wanted, F.lit(min_spans))
    # Starts come from the positions where a span fits, or from just enough positions.
    room = F.when(n - span <= spans, spans + 1).otherwise(n - span)
    staged = df.select("*", spans.alias("_spans"), room.cast("bigint").alias("_room"), round_keys("start", *base).alias("_keys"))
    starts = F.sort_array(permuted(F.col("_spans"), F.col("_room"), F.col("_keys")))
    staged = staged.withColumn("_starts", starts)
    # A span ends where the next one starts, so that positions come sorted and once.
    stops = F.transform("_starts", lambda s, i: F.least(s + span, F.coalesce(F.get("_starts", i + 1), s + span), n.cast("bigint")))
    covered = F.zip_with("_starts", stops, lambda s, e: F.when(s < e, F.sequence(s, e - 1)).otherwise(F.array().cast("array<bigint>")))
    return staged.withColumn("masked", F.flatten(covered).cast("array<int>")).drop("_spans", "_room", "_keys", "_starts")


def spec_augment(
    frames: DataFrame,
    key: str,
    frame: str,
    feat: str,
    n_dims: int,
    freq_width: int = 30,
    freq_bands: int = 2,
    time_width: int = 40,
    time_spans: int = 2,
    time_portion: float = 1.0,
    mask_value: float | None = None,
    seed: int = 0,
    epoch: int = 1,
) -> DataFrame:
    """Overwrite drawn dimension bands and frame spans of every utterance.

    Masked cells take ``mask_value``, or the utterance's own mean. A band
    is never wider than the features have dimensions. Length and
    mean are one partial aggregate per utterance, joined back to the frames.
    """
    base = (seed, epoch, F.col(key))
    cells = F.aggregate(feat, F.lit(0.0), lambda acc, x: acc + x)
    per_utt = frames.groupBy(key).agg(
        F.count("*").cast("int").alias("_n"), (F.sum(cells) / (F.count("*") * n_dims)).alias("_mean")
    )
    limit = F.least(F.lit(time_width), F.floor(F.col("_n") * time_portion)).cast("int")

    def drawn(name: str, number: int, width: Column, size: Column) -> Column:
        wide = randint(width, name, "width", number, *base)
        return F.struct(
            randint(size - wide, name, "from", number, *base).alias("first"), wide.alias("wide")
        )

    bands = [drawn("freq", i, F.lit(min(freq_width, n_dims)), F.lit(n_dims)) for i in range(freq_bands)]
    spans = [drawn("time", i, limit, F.col("_n")) for i in range(time_spans)]
    none = F.array().cast("array<struct<first:int,wide:int>>")
    draws = per_utt.select(
        key,
        (F.array(*bands) if bands else none).alias("_bands"),
        (F.array(*spans) if spans else none).alias("_spans"),
        (F.col("_mean") if mask_value is None else F.lit(float(mask_value))).alias("_value"),
    )
    joined = frames.join(draws, key)

    def inside(ranges: str, at: Column) -> Column:
        return F.exists(ranges, lambda r: (at >= r["first"]) & (at < r["first"] + r["wide"]))

    staged = joined.withColumn("_cut", inside("_spans", F.col(frame)))
    masked = F.transform(
        F.col(feat),
        lambda x, i: F.when(F.col("_cut") | inside("_bands", i), F.col("_value")).otherwise(x.cast("double")),
    )
    return staged.withColumn(feat, masked).drop("_bands", "_spans", "_value", "_cut")
