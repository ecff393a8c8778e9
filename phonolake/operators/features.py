"""Normalisation statistics over frames and their use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import apply_cmvn

VARIANCE_FLOOR = 1e-8


class Sums:
    """Frames, sums and sums of squares per dimension, of frames added in stacks."""

    def __init__(self):
        self.n = np.zeros(0, np.int64)
        self.sum = np.zeros(0)
        self.sumsq = np.zeros(0)

    def add(self, stack: np.ndarray) -> None:
        missing = stack.shape[1] - len(self.n)
        if missing > 0:
            self.n, self.sum, self.sumsq = (np.pad(x, (0, missing)) for x in (self.n, self.sum, self.sumsq))
        wide = stack.shape[1]
        self.n[:wide] += len(stack)
        self.sum[:wide] += stack.sum(axis=0)
        self.sumsq[:wide] += np.einsum("ij,ij->j", stack, stack)

    def add_lists(self, feat: pa.ListArray) -> None:
        """Rows of a list column, by their length; a NULL cell adds nothing to the sums."""
        sizes = feat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cells = feat.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for wide in np.unique(sizes[sizes > 0]).tolist():
            first = (ends - sizes)[sizes == wide]
            whole = len(first) == len(sizes)
            self.add(cells.reshape(-1, wide) if whole else cells[first[:, None] + np.arange(wide)])

    def row(self) -> list[pa.Array]:
        return [pa.array([x.tolist()], pa.list_(t)) for x, t in ((self.n, pa.int64()), (self.sum, pa.float64()), (self.sumsq, pa.float64()))]


SUMS = ["n", "sum", "sumsq"]
SUMS_SCHEMA = "n array<bigint>, sum array<double>, sumsq array<double>"


def cmvn_by_dim(frames: DataFrame, feat: str = "feat") -> DataFrame:
    """``(dim, n, sum, sumsq, mean, std)``.

    Each task adds its frames up as vectors and sends on one row. Sums are doubles; the variance is
    the population one with a floor.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            sums.add_lists(batch.column(0))
        yield pa.RecordBatch.from_arrays(sums.row(), SUMS)

    return cmvn_of_sums(frames.select(feat).mapInArrow(task, SUMS_SCHEMA))


def cmvn_of_sums(sums: DataFrame) -> DataFrame:
    """The statistics from rows of vector sums ``(n, sum, sumsq)``, one per task."""
    cells = sums.select(F.posexplode(F.arrays_zip(*SUMS)).alias("dim", "x")).select("dim", "x.*")
    return finalise_cmvn(cells.groupBy("dim").agg(*[F.sum(c).alias(c) for c in SUMS]))


def finalise_cmvn(sums: DataFrame) -> DataFrame:
    """Mean and floored standard deviation from the additive sums."""
    mean = F.col("sum") / F.col("n")
    variance = F.col("sumsq") / F.col("n") - mean * mean
    return sums.withColumn("mean", mean.cast("float")).withColumn(
        "std", F.sqrt(F.greatest(variance, F.lit(VARIANCE_FLOOR))).cast("float")
    )


def cmvn_row(by_dim: DataFrame) -> DataFrame:
    """The one-row form with arrays in dimension order; as many elements as dimensions."""
    rows = F.sort_array(F.collect_list(F.struct("dim", "sum", "sumsq", "mean", "std")))
    gathered = by_dim.agg(F.max("n").alias("n_frame"), rows.alias("rows"))
    # A field of an array of structs is the array of that field.
    return gathered.select("n_frame", *[F.col(f"rows.{c}").alias(c) for c in ("sum", "sumsq", "mean", "std")])


def normalise(frames: DataFrame, stats: DataFrame, feat: str = "feat") -> DataFrame:
    """Every frame against the one statistics row, read as a scalar."""
    one = stats.select(F.struct("mean", "std")).limit(1).scalar()
    placed = frames.withColumn("_stats", one)
    return placed.withColumn(feat, apply_cmvn(F.col(feat), F.col("_stats.mean"), F.col("_stats.std"))).drop("_stats")
