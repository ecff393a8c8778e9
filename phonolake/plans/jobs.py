"""The three end-to-end jobs: feature preparation, training-set assembly, decoding and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import apply_cmvn, argmax, best_path, crop, pad, padding_mask, stride_labels, subsampled_length
from ..functions.text import fingerprint, pieces_to_words, tokens
from ..operators.batching import batch_by_bucket, with_target_size
from ..operators.features import SUMS, Sums, cmvn_of_sums
from ..operators.filters import filter_by_size
from ..operators.masking import span_mask
from ..operators.scoring import corpus_error_rate, score_pairs
from ..operators.signal import CHUNK_HOPS, chunk_frames, chunk_hops, log_mel_matrix, vectors
from ..session import materialise
from ..sources.dictionary import PAD, decode_ids
from ..sources.features import FRAMES_SCHEMA
from ..sources.reports import report_text, write_outputs, write_reports


class Prepared(NamedTuple):
    frames: DataFrame
    stats: DataFrame
    manifest: DataFrame


# What the feature pass writes, by kind: frames, the number of frames of each chunk, and each task's vector sums.
FEATURES_SCHEMA = (
    "utt_id bigint, frame_idx int, feat array<float>, unit int, n_frames bigint, "
    "n array<bigint>, sum array<double>, sumsq array<double>, kind string"
)


def write_features(
    chunks: DataFrame, key: str, path: str, sample_rate: float, width: int, hop: int, n_mels: int, hops: int = CHUNK_HOPS
) -> None:
    """Chunked waveforms to log-mel frames under ``path``, in one pass without a shuffle.

    The frames are in ``kind=frames`` with the columns of ``FRAMES_SCHEMA``. The same pass adds them up in double
    precision, before they are stored in single: one row of sums a task, one row with its number of frames a chunk.
    """
    many = chunk_hops(width, hop, hops)
    fields = [x.split(" ") for x in FEATURES_SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<float>": pa.list_(pa.float32())}
    kinds |= {"array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

    def rows(size: int, label: str, /, **columns: pa.Array) -> pa.RecordBatch:
        given = {**columns, "kind": pa.array([label] * size)}
        made = [given[c].cast(kinds[t]) if c in given else pa.nulls(size, kinds[t]) for c, t in fields]
        return pa.RecordBatch.from_arrays(made, [c for c, _ in fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for k in range(batch.num_rows):
                signal = batch.column(2)[k].values
                stack = chunk_frames(signal.cast(pa.float64()).to_numpy(zero_copy_only=False), width, hop, many)
                if not len(stack):
                    continue
                feats = log_mel_matrix(stack, sample_rate, n_mels)
                sums.add(feats)
                utt = batch.column(0).take(pa.array(np.full(len(stack), k)))
                index = pa.array(batch.column(1)[k].as_py() * many + np.arange(len(stack)))
                yield rows(len(stack), "frames", utt_id=utt, frame_idx=index, feat=vectors(feats.astype(np.float32)))
                yield rows(1, "counts", utt_id=utt.slice(0, 1), n_frames=pa.array([len(stack)]))
        yield rows(1, "sums", **dict(zip(SUMS, sums.row())))

    kept = chunks.where(F.col("samples").isNotNull()).select(F.col(key).cast("bigint"), "chunk", "samples")
    kept.mapInArrow(task, FEATURES_SCHEMA).write.partitionBy("kind").parquet(path)


def read_features(spark: SparkSession, path: str, kind: str, *columns: str) -> DataFrame:
    """One kind of what ``write_features`` wrote."""
    return spark.read.schema(FEATURES_SCHEMA).parquet(path).where(F.col("kind") == kind).select(*columns)


def prepare_features(
    chunks: DataFrame,
    key: str,
    sample_rate: float,
    width: int,
    hop: int,
    n_mels: int,
    utterances: DataFrame,
    path: str,
    hops: int = CHUNK_HOPS,
) -> Prepared:
    """Chunked waveforms (see ``chunk_samples`` and ``chunk_waveforms``) to frames at ``path``, statistics and manifest.

    Frames are written once and not read again: statistics come from the pass's sums, frame counts from
    its rows per chunk. ``utterances`` holds ``(key, audio, tgt_text)``; one too short for a frame is listed with none.
    """
    spark = chunks.sparkSession
    write_features(chunks, key, path, sample_rate, width, hop, n_mels, hops)
    frames = read_features(spark, path, "frames", *FRAMES_SCHEMA.names)
    counts = read_features(spark, path, "counts", "utt_id", "n_frames").groupBy("utt_id").agg(F.sum("n_frames").alias("n_frames"))
    manifest = utterances.join(counts.withColumnRenamed("utt_id", key), key, "left").select(
        key,
        F.col(key).cast("string").alias("id"),
        "audio",
        F.coalesce("n_frames", F.lit(0)).cast("bigint").alias("n_frames"),
        "tgt_text",
    )
    return Prepared(frames, cmvn_of_sums(read_features(spark, path, "sums", *SUMS)), manifest)


class LabelSet(NamedTuple):
    """Labels of one kind: their column, labels a second (-1 for a sequence), every which one a frame takes, and the padding id."""

    column: str
    rate: float
    stride: int = 1
    pad_id: int = PAD


def plan_labels(planned: DataFrame, labels: Mapping[str, LabelSet], sample_rate: float, pad_audio: bool) -> DataFrame:
    """From sizes alone, for each label set: where a sample's labels start, how many it takes, and the batch's most.

    Reads ``batch_id, start, target_size`` and the sizes ``_size_*``. A window holds a batch, which its capacity bounds.
    """
    in_batch = Window.partitionBy("batch_id")
    for name, kind in labels.items():
        size = F.col(f"_size_{name}")
        if kind.rate < 0:
            first, taken = F.lit(0), size
        else:
            ratio = F.lit(kind.rate / sample_rate)
            first = F.bround(F.col("start") * ratio).cast("int")
            wanted = F.bround(F.col("target_size") * ratio).cast("int")
            if not pad_audio:
                wanted = F.least(wanted, F.min(size - first).over(in_batch))
            taken = F.greatest(F.least(wanted, size - first), F.lit(0))
        planned = planned.withColumn(f"_first_{name}", first).withColumn(f"_taken_{name}", taken)
        planned = planned.withColumn(f"_most_{name}", F.max(f"_taken_{name}").over(in_batch))
    return planned


def assemble_training_set(
    samples: DataFrame,
    key: str,
    source: str,
    labels: Mapping[str, LabelSet],
    start: Column,
    sample_rate: float,
    min_keep: int,
    max_sample_size: int,
    max_tokens: int,
    max_sentences: int,
    mask_prob: float,
    stats: DataFrame | None = None,
    pad_audio: bool = False,
    width: int = 64,
    ratio: int = 2,
    seed: int = 0,
) -> DataFrame:
    """Filter, batch, crop or pad to the batch's size, normalise, align and stride labels, draw the span mask.

    Batches, crops and label stretches are planned on keys and sizes alone, written once as planning
    reads them more than once; the arrays join that plan in a single exchange. ``start`` is over ``n``,
    ``target_size`` and the key. With ``stats`` (one row of ``mean`` and ``std``) a source is a list of frames
    that are normalised before padding, and padding is zero frames. Adds ``padding_mask``, ``n_sub``, ``masked``
    and, for each label set, ``target_*`` and its length before padding, ``length_*``.
    """
    sizes = [F.size(kind.column).alias(f"_size_{name}") for name, kind in labels.items()]
    sized = materialise(samples.select(key, F.size(source).alias("n"), *sizes), "sizes")
    planned = batch_by_bucket(filter_by_size(sized, "n", min_keep), key, "n", max_tokens, max_sentences, width).drop("bucket")
    targeted = with_target_size(planned, "n", max_sample_size, pad_audio)
    began = F.when(F.col("n") > F.col("target_size"), start).otherwise(F.lit(0)).cast("int")
    rows = samples.join(plan_labels(targeted.withColumn("start", began), labels, sample_rate, pad_audio), key)

    cut = crop(F.col(source), F.col("target_size"), F.col("start"))
    filler = F.lit(0).cast(samples.schema[source].dataType.elementType) if stats is None else None
    if stats is not None:
        rows = rows.withColumn("_stats", stats.select(F.struct("mean", "std")).limit(1).scalar())
        cut = F.transform(cut, lambda f: apply_cmvn(f, F.col("_stats.mean"), F.col("_stats.std")))
        filler = F.transform("_stats.mean", lambda m: F.lit(0.0).cast("float"))
    mask = padding_mask(F.col("n"), F.col("target_size"))
    rows = rows.withColumn("padding_mask", mask).withColumn(source, pad(cut, F.col("target_size"), filler) if pad_audio else cut)

    frames = subsampled_length(F.col("target_size"), (5,) * (ratio.bit_length() - 1)).cast("int")
    aligned, lengths = [c for c in rows.columns if not c.startswith("_")], [frames]
    for name, kind in labels.items():
        taken = F.slice(kind.column, F.col(f"_first_{name}") + 1, F.col(f"_taken_{name}"))
        padded = pad(taken, F.col(f"_most_{name}"), F.lit(kind.pad_id))
        rows = rows.withColumn(f"target_{name}", padded).withColumn(f"length_{name}", F.col(f"_taken_{name}"))
        if kind.rate >= 0:
            lengths.append(F.floor(F.col(f"_most_{name}") / kind.stride).cast("int"))
            rows = rows.withColumn(f"target_{name}", stride_labels(F.col(f"target_{name}"), frames, kind.stride))
        aligned += [f"target_{name}", f"length_{name}"]
    n_sub = F.least(*lengths) if len(lengths) > 1 else frames
    return span_mask(rows.withColumn("n_sub", n_sub).select(*aligned, "n_sub"), key, "n_sub", mask_prob, seed=seed)


def decode_and_score(
    frames: DataFrame,
    key: str,
    frame: str,
    logits: str,
    dictionary: DataFrame,
    refs: DataFrame,
    blank: int = 0,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Frame scores to best paths, symbols and words, scored per sentence against ``refs`` ``(key, ref)``.

    A reference without hypothesis stays in: all its words are deletions. ``lengths`` ``(key, input_len)`` gives
    the number of frames that count, in frame order; the others are padding. An utterance it doesn't list has no padding.
    """
    best = frames.select(key, frame, argmax(F.col(logits)).alias("_best"))
    paths = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(frame, "_best"))).alias("_rows"))
    used = None
    if lengths is not None:
        used = F.coalesce("input_len", F.size("_rows"))
        paths = paths.join(lengths.select(key, "input_len"), key, "left")
    units = paths.withColumn("_ids", F.transform("_rows", lambda r: r["_best"]))
    ids = units.select(key, best_path(F.col("_ids"), blank, used).alias("ids"))
    hyps = decode_ids(ids, key, "ids", dictionary).withColumn("hyp", tokens(pieces_to_words(F.col("units"))))
    pairs = refs.join(hyps.select(key, "hyp"), key, "left").withColumn(
        "hyp", F.coalesce("hyp", F.array().cast("array<string>"))
    )
    return score_pairs(pairs, "hyp", "ref")


def write_run(scored: DataFrame, key: str, kinds: dict[str, str], config: Column, path: str) -> None:
    """The files of a scored run: each output kind's lines in ``outputs``, the error-rate report in ``reports``.

    ``scored`` has a text column for each of ``kinds`` beside ``err`` and ``n_ref``; it is read twice.
    """
    write_outputs(scored, key, kinds, f"{path}/outputs")
    report = report_text(F.col("wer"), F.col("err"), F.col("n_ref"), config)
    totals = corpus_error_rate(scored).select(report.alias("value"), fingerprint(config).alias("run_id"))
    write_reports(totals, f"{path}/reports")
