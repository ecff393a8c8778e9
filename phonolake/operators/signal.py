"""Signals: framing, regular-grid resampling, log-mel features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import signal_frames
from .ordering import ordered_scan

# Constants of the standard speech filter bank.
PRE_EMPHASIS = 0.97
LOW_FREQUENCY = 20.0
WINDOW_POWER = 0.85
ENERGY_FLOOR = 1.1920928955078125e-07


def spread_to_frames(
    samples: DataFrame, key: str, order: Sequence[Column], width: int, hop: int
) -> DataFrame:
    """Each sample once per frame it falls in: adds ``frame_idx`` and ``offset`` in the frame.

    The tall form of framing. A signal of any length is numbered block by block,
    so one long signal does not end up in one task.
    """
    placed = ordered_scan(samples, order, [key], position="_at")
    first = F.greatest(F.floor((F.col("_at") - width) / hop) + 1, F.lit(0))
    last = F.floor(F.col("_at") / hop)
    # With a hop wider than the frame some samples are in no frame at all.
    inside = F.when(first <= last, F.sequence(first, last))
    spread = placed.withColumn("frame_idx", F.explode(inside))
    return spread.withColumn("offset", (F.col("_at") - F.col("frame_idx") * hop).cast("int")).drop("_at")


def frame_energy(spread: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """Energy per complete frame."""
    return (
        spread.groupBy(key, "frame_idx")
        .agg(F.count("*").alias("_n"), F.sum(F.col(value) * F.col(value)).alias("energy"))
        .where(F.col("_n") == width)
        .drop("_n")
    )


def gather_frames(spread: DataFrame, key: str, value: str, width: int, out: str = "samples") -> DataFrame:
    """Complete frames as arrays of ``width`` samples."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", value)))
    return (
        spread.groupBy(key, "frame_idx")
        .agg(F.transform(ordered, lambda s: s[value]).alias(out))
        .where(F.size(out) == width)
    )


def frame_waveforms(waveforms: DataFrame, key: str, samples: str, width: int, hop: int) -> DataFrame:
    """Frames of signals that are whole arrays, one per row: ``(key, frame_idx, samples)``, no shuffle."""
    frames = F.posexplode(signal_frames(F.col(samples), width, hop)).alias("frame_idx", samples)
    return waveforms.select(key, frames).withColumn("frame_idx", F.col("frame_idx").cast("bigint"))


#: Frames that begin in a chunk of a waveform.
CHUNK_HOPS = 4096


def chunk_hops(width: int, hop: int, hops: int = CHUNK_HOPS) -> int:
    """Hops per chunk, enough for a frame to reach into the next chunk only."""
    return max(hops, -(-(width - hop) // hop), 1)


def chunk_samples(
    samples: DataFrame, key: str, order: Sequence[Column], value: str, width: int, hop: int, hops: int = CHUNK_HOPS
) -> DataFrame:
    """``(key, chunk, samples)`` of signals that are one row per sample.

    A chunk holds a fixed number of hops and, as a halo, the samples after them that its last
    frames reach. A signal of any length is a row per chunk, and each sample is in one array, in
    two where it is in a halo.
    """
    long, halo = chunk_hops(width, hop, hops) * hop, max(width - hop, 0)
    placed = ordered_scan(samples, order, [key], position="_at")
    own = F.floor(F.col("_at") / long).cast("bigint")
    early = (F.col("_at") % long < halo) & (own > 0)
    rows = placed.select(key, value, "_at", F.explode(F.when(early, F.array(own - 1, own)).otherwise(F.array(own))).alias("chunk"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", value)))
    return rows.groupBy(key, "chunk").agg(ordered.alias("_rows")).select(key, "chunk", F.col(f"_rows.{value}").alias("samples"))


def chunk_waveforms(waveforms: DataFrame, key: str, samples: str, width: int, hop: int, hops: int = CHUNK_HOPS) -> DataFrame:
    """``(key, chunk, samples)`` of signals that are whole arrays, one per row: no shuffle."""
    long, halo = chunk_hops(width, hop, hops) * hop, max(width - hop, 0)
    firsts = F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.size(samples) - 1, F.lit(long)))
    cut = F.transform(firsts, lambda at: F.slice(samples, at + 1, F.lit(long + halo)))
    return waveforms.select(key, F.posexplode(cut).alias("chunk", "samples")).withColumn("chunk", F.col("chunk").cast("bigint"))


def chunk_frames(samples: np.ndarray, width: int, hop: int, hops: int) -> np.ndarray:
    """Complete frames that begin in a chunk, one per row."""
    if len(samples) < width:
        return np.zeros((0, width))
    return np.lib.stride_tricks.sliding_window_view(samples, width)[::hop][:hops]


def map_chunks(
    chunks: DataFrame, key: str, make: Callable[[np.ndarray], np.ndarray], width: int, hop: int, hops: int, out: str, kind: str
) -> DataFrame:
    """``(key, frame_idx, out)``: ``make`` of each chunk's stack of frames, one value or vector a frame; no shuffle."""
    many = chunk_hops(width, hop, hops)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                signal = batch.column(2)[k].values
                stack = chunk_frames(signal.cast(pa.float64()).to_numpy(zero_copy_only=False) if signal is not None else np.zeros(0), width, hop, many)
                if len(stack):
                    made = make(stack)
                    index = batch.column(1)[k].as_py() * many + np.arange(len(stack))
                    keys = batch.column(0).take(pa.array(np.full(len(stack), k)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(index), vectors(made)], [key, "frame_idx", out])

    schema = f"{key} {chunks.schema[key].dataType.simpleString()}, frame_idx bigint, {out} {kind}"
    return chunks.select(key, "chunk", "samples").mapInArrow(task, schema)


def vectors(made: np.ndarray) -> pa.Array:
    """One value a row, or one list a row, as an Arrow column."""
    if made.ndim == 1:
        return pa.array(made)
    ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))


def energy_of_chunks(chunks: DataFrame, key: str, width: int, hop: int, hops: int = CHUNK_HOPS) -> DataFrame:
    """``(key, frame_idx, energy)`` of complete frames."""
    return map_chunks(chunks, key, lambda stack: (stack * stack).sum(axis=1), width, hop, hops, "energy", "double")


def log_mel_of_chunks(
    chunks: DataFrame, key: str, sample_rate: float, width: int, hop: int, n_mels: int = 80, hops: int = CHUNK_HOPS
) -> DataFrame:
    """``(key, frame_idx, feat)`` of chunked waveforms: framed and transformed in one pass, no shuffle."""
    return map_chunks(
        chunks, key, lambda stack: log_mel_matrix(stack, sample_rate, n_mels), width, hop, hops, "feat", "array<double>"
    )


def resample_series(
    samples: DataFrame, key: str, at: str, value: str, step: int
) -> DataFrame:
    """Regular grid per key: mean per ``step``, gaps filled on the line between their neighbours.

    ``at`` counts units (seconds, say) and ``step`` is the grid's width in them.
    The means shrink a key to one row per grid point before the window looks at
    the next point, so a window's rows are bounded by the time covered.
    """
    bucket = F.floor(F.col(at) / step).cast("bigint")
    means = samples.groupBy(key, bucket.alias("bucket")).agg(F.avg(value).alias("mean"))
    following = Window.partitionBy(key).orderBy("bucket")
    linked = means.withColumn("_next", F.lead("bucket").over(following)).withColumn(
        "_next_mean", F.lead("mean").over(following)
    )
    until = F.coalesce(F.col("_next") - 1, F.col("bucket"))
    filled = linked.withColumn("grid", F.explode(F.sequence("bucket", until)))
    share = F.try_divide(F.col("grid") - F.col("bucket"), F.col("_next") - F.col("bucket"))
    is_gap = F.col("grid") != F.col("bucket")
    on_line = F.col("mean") + (F.col("_next_mean") - F.col("mean")) * share
    return filled.select(
        key, "grid", F.when(is_gap, on_line).otherwise(F.col("mean")).alias(value), is_gap.alias("is_filled")
    )


def mel_weights(n_mels: int, n_fft: int, sample_rate: float) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, one row per band, one column per FFT bin below Nyquist."""

    def mel(hertz):
        return 1127.0 * np.log1p(np.asarray(hertz) / 700.0)

    edges = np.linspace(mel(LOW_FREQUENCY), mel(sample_rate / 2), n_mels + 2)
    bins = mel(np.arange(n_fft // 2) * sample_rate / n_fft)
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising = (bins - left) / (centre - left)
    falling = (right - bins) / (right - centre)
    return np.maximum(0.0, np.minimum(rising, falling))


def log_mel_matrix(samples: np.ndarray, sample_rate: float, n_mels: int) -> np.ndarray:
    """Log mel energies of a stack of frames, one frame per row."""
    width = samples.shape[1]
    n_fft = 1 << (width - 1).bit_length()
    centred = samples - samples.mean(axis=1, keepdims=True)
    before = np.concatenate([centred[:, :1], centred[:, :-1]], axis=1)
    ramp = np.arange(width) * (2 * np.pi / (width - 1))
    shaped = (centred - PRE_EMPHASIS * before) * (0.5 - 0.5 * np.cos(ramp)) ** WINDOW_POWER
    power = np.abs(np.fft.rfft(shaped, n=n_fft, axis=1)[:, : n_fft // 2]) ** 2
    return np.log(np.maximum(power @ mel_weights(n_mels, n_fft, sample_rate).T, ENERGY_FLOOR))


def log_mel(frames: DataFrame, key: str, samples: str, sample_rate: float, n_mels: int = 80) -> DataFrame:
    """``(key, frame_idx, feat)`` from complete frames; the Fourier step runs in numpy per Arrow batch."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                stacked = np.stack(batch[samples].to_numpy()).astype("float64")
                feats = log_mel_matrix(stacked, sample_rate, n_mels)
                yield pd.DataFrame({key: batch[key], "frame_idx": batch["frame_idx"], "feat": list(feats)})

    schema = f"{key} {frames.schema[key].dataType.simpleString()}, frame_idx bigint, feat array<double>"
    return frames.select(key, "frame_idx", samples).mapInPandas(extract, schema)
