"""Token-budget batches and the per-batch cropping, padding and label collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import crop, pad, padding_mask
from .ordering import ordered_scan

DEFAULT_MAX_TOKENS = 4_000_000


def _limits(max_tokens: int | None, max_sentences: int | None) -> tuple[int | None, int | None]:
    if max_tokens is None and max_sentences is None:
        return DEFAULT_MAX_TOKENS, None
    return max_tokens, max_sentences


def batch_capacity(size: Column, max_tokens: int | None, max_sentences: int | None) -> Column:
    """Samples of ``size`` a batch holds; at least one, so an oversize sample is a batch of its own."""
    parts = []
    if max_tokens is not None:
        parts.append(F.floor(F.lit(max_tokens) / F.greatest(size, F.lit(1))))
    if max_sentences is not None:
        parts.append(F.lit(max_sentences).cast("bigint"))
    least = parts[0] if len(parts) == 1 else F.least(*parts)
    return F.greatest(least, F.lit(1)).cast("bigint")


def whole_batches(capacity: Column, multiple: int) -> Column:
    """A batch's samples: its capacity cut to a multiple, or all of a capacity below one."""
    return F.greatest(F.floor(capacity / multiple) * multiple, capacity % multiple).cast("bigint")


def batch_by_bucket(
    df: DataFrame,
    key: str,
    size: str,
    max_tokens: int | None = None,
    max_sentences: int | None = None,
    width: int = 256,
    multiple: int = 1,
) -> DataFrame:
    """Batches inside length buckets: longest × count stays within ``max_tokens``.

    All batches of a bucket but its last hold its capacity, cut to a multiple of
    ``multiple`` (below one multiple, all of it). A bucket's capacity follows from its upper bound. Sizes beyond the budget
    share the last bucket with capacity one, so there are at most
    ``max_tokens / width + 1`` buckets when a token budget is given.
    """
    max_tokens, max_sentences = _limits(max_tokens, max_sentences)
    bucket = F.greatest(F.ceil(F.col(size) / width), F.lit(1))
    if max_tokens is not None:
        bucket = F.least(bucket, F.lit(max_tokens // width + 1))
    capacity = batch_capacity(F.col("bucket") * width, max_tokens, max_sentences)
    bucketed = df.withColumn("bucket", bucket.cast("bigint"))
    placed = ordered_scan(bucketed, [F.col(size).desc(), F.col(key).desc()], ["bucket"], position="_at")
    placed = placed.withColumn("_capacity", whole_batches(capacity, multiple))
    per_bucket = placed.groupBy("bucket").agg(
        F.ceil(F.count("*") / F.first("_capacity")).cast("bigint").alias("_batches")
    )
    # One row per bucket; shorter buckets come first.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_bucket.select("bucket", F.coalesce(F.sum("_batches").over(earlier), F.lit(0)).alias("_first"))
    if max_tokens is not None:
        firsts = F.broadcast(firsts)
    return (
        placed.join(firsts, "bucket")
        .withColumn("batch_id", (F.col("_first") + F.floor(F.col("_at") / F.col("_capacity"))).cast("bigint"))
        .drop("_at", "_capacity", "_first")
    )


def batch_greedy(
    df: DataFrame,
    key: str,
    size: str,
    max_tokens: int | None = None,
    max_sentences: int | None = None,
    multiple: int = 1,
) -> DataFrame:
    """Exactly the batches of a greedy walk over the samples, longest first.

    Walking down the sizes, a batch is decided by its first sample: it takes
    ``capacity`` samples, cut to a multiple of ``multiple``. Samples of equal
    capacity are a run, and inside a run batches start at even steps. So the
    walk needs one step per run, not per sample; there are at most
    ``min(max_sentences, 2 * sqrt(max_tokens))`` runs, which are walked in one
    row and broadcast back. The samples themselves are only numbered and joined.
    """
    max_tokens, max_sentences = _limits(max_tokens, max_sentences)
    placed = ordered_scan(df, [F.col(size).desc(), F.col(key).desc()], position="pos")
    placed = placed.withColumn("_capacity", batch_capacity(F.col(size), max_tokens, max_sentences))

    runs = placed.groupBy("_capacity").agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end"))
    step = whole_batches(F.col("_capacity"), multiple).alias("step")
    one_row = runs.agg(
        F.sort_array(F.collect_list(F.struct("begin", "end", F.col("_capacity").alias("capacity"), step))).alias("runs"),
        F.max("end").alias("n"),
    )

    walked_type = (
        "struct<start:bigint,batch:bigint,final:bigint,"
        "runs:array<struct<capacity:bigint,step:bigint,first_start:bigint,first_batch:bigint>>>"
    )
    empty = F.expr(
        f"cast(struct(0 as start, 0 as batch, null as final, array() as runs) as {walked_type})"
    )

    def walk(state: Column, run: Column) -> Column:
        start, batch = state["start"], state["batch"]
        begun = F.greatest(F.ceil((run["end"] - start) / run["step"]), F.lit(0)).cast("bigint")
        # The first batch here that would reach the last sample takes all the rest.
        skip = F.greatest(F.ceil((F.col("n") - run["capacity"] - start) / run["step"]), F.lit(0)).cast("bigint")
        final = F.when(skip < begun, batch + skip)
        here = F.struct(
            run["capacity"].alias("capacity"),
            run["step"].alias("step"),
            start.alias("first_start"),
            batch.alias("first_batch"),
        )
        return F.struct(
            (start + begun * run["step"]).cast("bigint").alias("start"),
            (batch + begun).cast("bigint").alias("batch"),
            F.least(state["final"], final).alias("final"),
            F.concat(state["runs"], F.array(here)).alias("runs"),
        ).cast(walked_type)

    walked = one_row.select(F.aggregate("runs", empty, walk).alias("w")).select(
        F.col("w.final").alias("_final"), F.inline("w.runs").alias("_capacity", "_step", "_start", "_batch")
    )
    in_run = F.when(F.col("pos") < F.col("_start"), F.col("_batch") - 1).otherwise(
        F.col("_batch") + F.floor((F.col("pos") - F.col("_start")) / F.col("_step"))
    )
    return (
        placed.join(F.broadcast(walked), "_capacity")
        .withColumn("batch_id", F.least(in_run, F.col("_final")).cast("bigint"))
        .drop("_capacity", "_step", "_start", "_batch", "_final")
    )


def batch_target_size(batched: DataFrame, size: str, max_sample_size: int | None, pad_audio: bool) -> DataFrame:
    """Per batch the common length: its longest if it pads, else its shortest; at most ``max_sample_size``."""
    extreme = F.max(size) if pad_audio else F.min(size)
    if max_sample_size is not None:
        extreme = F.least(extreme, F.lit(max_sample_size))
    return batched.groupBy("batch_id").agg(F.count("*").alias("nsentences"), extreme.alias("target_size"))


def with_target_size(batched: DataFrame, size: str, max_sample_size: int | None, pad_audio: bool) -> DataFrame:
    """Rows with their batch's common length.

    A window per batch is safe: its rows are bounded by the batch's capacity.
    """
    extreme = (F.max(size) if pad_audio else F.min(size)).over(Window.partitionBy("batch_id"))
    if max_sample_size is not None:
        extreme = F.least(extreme, F.lit(max_sample_size))
    return batched.withColumn("target_size", extreme)


def pad_and_mask(df: DataFrame, source: str, target: str, start: Column, filler: Column, pad_audio: bool) -> DataFrame:
    """Bring ``source`` to the target length: crop from ``start`` or, if the batch pads, fill up.

    Adds ``start`` and ``padding_mask``. Without padding no source may be shorter
    than the target; the shortest sets it.
    """
    size = F.size(source)
    began = F.when(size > F.col(target), start).otherwise(F.lit(0)).cast("int")
    staged = df.withColumn("start", began)
    cropped = crop(F.col(source), F.col(target), F.col("start"))
    mask = padding_mask(size, F.col(target))
    if pad_audio:
        return staged.withColumn("padding_mask", mask).withColumn(source, pad(cropped, F.col(target), filler))
    short = F.raise_error(F.lit("a sample is shorter than its batch, which does not pad"))
    return staged.withColumn("padding_mask", mask).withColumn(
        source, F.when(size < F.col(target), short).otherwise(cropped)
    )


def batch_counts(labels: DataFrame, key: str, ids: str = "tokens") -> DataFrame:
    """Per batch and label set: sample ids, token count per sample, their sum."""
    length = F.size(ids).cast("bigint")
    members = F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), length.alias("length"))))
    return labels.groupBy("batch_id", "label_set").agg(
        F.count("*").alias("nsentences"),
        F.sum(length).alias("ntokens"),
        F.transform(members, lambda m: m["id"]).alias("ids"),
        F.transform(members, lambda m: m["length"]).alias("target_lengths"),
    )


def align_frame_labels(
    df: DataFrame,
    labels: str,
    audio_size: str,
    start: str,
    label_rate: float,
    sample_rate: float,
    pad_id: int,
    pad_audio: bool,
) -> DataFrame:
    """Labels that belong to the cropped audio, right-padded to the longest of the batch.

    Rates turn frames into labels, rounding half to even. A batch that does not
    pad is cut to the fewest labels any of its samples has left. A rate of -1
    marks sequence labels, which are only padded.
    """
    in_batch = Window.partitionBy("batch_id")
    if label_rate < 0:
        cut = df.withColumn("label_start", F.lit(0)).withColumn("target", F.col(labels))
    else:
        ratio = label_rate / sample_rate
        placed = df.withColumn("label_start", F.bround(F.col(start) * F.lit(ratio)).cast("int"))
        wanted = F.bround(F.col(audio_size) * F.lit(ratio)).cast("int")
        if not pad_audio:
            wanted = F.least(wanted, F.min(F.size(labels) - F.col("label_start")).over(in_batch))
        cut = placed.withColumn("_wanted", F.greatest(wanted, F.lit(0)))
        cut = cut.withColumn("target", F.slice(labels, F.col("label_start") + 1, F.col("_wanted"))).drop("_wanted")
    sized = cut.withColumn("target_length", F.size("target"))
    padded = sized.withColumn("_longest", F.max("target_length").over(in_batch))
    return padded.withColumn("target", pad(F.col("target"), F.col("_longest"), F.lit(pad_id))).drop("_longest")
