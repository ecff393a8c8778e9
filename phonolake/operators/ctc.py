"""Alignment-free sequence score of targets given frame log-probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Utterances are scored together up to this many padded cells (utterances x frames x classes, or x states).
CELLS = 1 << 22


def score_block(log_probs: Sequence[np.ndarray], targets: Sequence[np.ndarray], blank: int) -> np.ndarray:
    """Scores of several utterances, longest first: one step a frame for all that still have one."""
    frames = np.array([len(x) for x in log_probs])
    n_states = np.array([2 * len(t) + 1 for t in targets])
    states = np.full((len(targets), n_states.max()), blank)
    for row, target in zip(states, targets):
        row[1 : 2 * len(target) : 2] = target
    may_skip = np.zeros(states.shape, dtype=bool)
    may_skip[:, 2:] = (states[:, 2:] != blank) & (states[:, 2:] != states[:, :-2])
    padded = np.full((len(frames), frames.max(), max(x.shape[1] for x in log_probs)), -np.inf)
    for row, x in zip(padded, log_probs):
        row[: len(x), : x.shape[1]] = x
    # Two columns in front stand for the states before the first; those behind a target's last never reach it.
    score = np.full((len(frames), states.shape[1] + 2), -np.inf)
    score[:, 2:4] = np.take_along_axis(padded[:, 0], states[:, :2], axis=1)
    for at in range(1, frames.max()):
        live = int(np.count_nonzero(frames > at))
        jump = np.where(may_skip[:live], score[:live, :-2], -np.inf)
        reached = np.logaddexp(np.logaddexp(score[:live, 2:], score[:live, 1:-1]), jump)
        score[:live, 2:] = reached + np.take_along_axis(padded[:live, at], states[:live], axis=1)
    rows = np.arange(len(frames))
    return -np.logaddexp(score[rows, n_states + 1], score[rows, n_states])


def forward_scores(log_probs: Sequence[np.ndarray], targets: Sequence[np.ndarray], blank: int) -> np.ndarray:
    """Negative log-likelihood of each target over all its alignments; infinite if it cannot fit.

    Utterances of like length go together, as many as ``CELLS`` allows, one at least.
    """
    scores = np.array([0.0 if not len(t) else np.inf for t in targets])
    order = [int(i) for i in np.argsort([-len(x) for x in log_probs], kind="stable") if len(log_probs[i])]
    begun = 0
    while begun < len(order):
        longest, wide, end = len(log_probs[order[begun]]), 0, begun
        while end < len(order):
            wide = max(wide, log_probs[order[end]].shape[1], 2 * len(targets[order[end]]) + 1)
            if end > begun and (end - begun + 1) * longest * wide > CELLS:
                break
            end += 1
        block = order[begun:end]
        scores[block] = score_block([log_probs[i] for i in block], [targets[i] for i in block], blank)
        begun = end
    return scores


def forward_score(log_probs: np.ndarray, target: np.ndarray, blank: int) -> float:
    """The score of one utterance."""
    return float(forward_scores([log_probs], [target], blank)[0])


def matrices(nested: pa.Array) -> list[np.ndarray]:
    """Arrays of equally long frames as matrices; NULL or none is an empty one."""
    counts = pc.fill_null(pc.list_value_length(nested), 0).to_numpy(zero_copy_only=False)
    frames = nested.flatten()
    widths = pc.fill_null(pc.list_value_length(frames), 0).to_numpy(zero_copy_only=False)
    values = frames.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends, cells = np.cumsum(counts), np.concatenate([[0], np.cumsum(widths)])
    return [values[cells[e - n] : cells[e]].reshape(n, -1) if n else np.empty((0, 1)) for n, e in zip(counts, ends)]


def vectors_of(arrays: pa.Array) -> list[np.ndarray]:
    """Arrays of ids; NULL is an empty one."""
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    values = arrays.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def ctc_score(
    utterances: DataFrame,
    key: str,
    log_probs: str,
    target: str,
    blank: int = 0,
    zero_infinity: bool = False,
    length: str | None = None,
) -> DataFrame:
    """``(key, n_tokens, nll)`` for rows with the frames' log-probabilities and the target ids.

    ``length`` names the number of frames that count; those after it are padding. NULL arrays are empty.

    Works in log space, so long inputs neither underflow nor need rescaling, and over blocks of
    utterances, a step a frame for the whole block.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = vectors_of(batch.column(2))
            values = forward_scores(matrices(batch.column(1)), targets, blank)
            if zero_infinity:
                values = np.where(np.isinf(values), 0.0, values)
            sizes = pa.array([len(t) for t in targets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(values)], [key, "n_tokens", "nll"])

    frames = F.col(log_probs)
    if length is not None:
        frames = F.slice(frames, F.lit(1), F.greatest(F.col(length), F.lit(0)).cast("int"))
    rows = utterances.select(key, frames.alias(log_probs), target)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("nll", T.DoubleType())]
    return rows.mapInArrow(score, T.StructType([rows.schema[0], *made]))
