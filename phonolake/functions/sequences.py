"""Array and integer functions over frames, labels and masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int


def _col(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def upto(count: Column) -> Column:
    """``[0, 1, .. count-1]``; empty for 0, where ``sequence`` alone would count down."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def effective_size(n_frames: Column, max_sample_size: int | None, pad_audio: bool) -> Column:
    """Size that counts towards a batch: cropped length unless the batch pads."""
    if pad_audio or max_sample_size is None:
        return n_frames
    return F.least(n_frames, F.lit(max_sample_size))


def subsampled_length(n_frames: Column, kernel_sizes: Sequence[int] = (5, 5)) -> Column:
    """Length after one stride-2 layer per kernel size: floor((L - 1) / 2 + 1) each."""
    length = n_frames
    for _ in kernel_sizes:
        length = F.floor((length + 1) / 2)
    return length.cast("bigint")


def get_or_last(values: Column, index: Number) -> Column:
    """Element at 0-based ``index`` if there is one, else the last element."""
    return F.coalesce(F.get(values, _col(index)), F.try_element_at(values, F.lit(-1)))


def input_length(given: Column, padding_mask: Column, frames: Column) -> Column:
    """Given length, else the number of unpadded positions, else the number of frames.

    The last fallback takes either the frame array's length or a length column.
    """
    unpadded = F.when(padding_mask.isNotNull(), F.size(F.filter(padding_mask, lambda p: ~p)))
    return F.coalesce(given, unpadded, frames)


def strip_ids(ids: Column, *special: int) -> Column:
    """Ids without the special ones (pad, or pad and end of sentence)."""
    return F.filter(ids, lambda i: ~i.isin(*special))


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def collapse_repeats(ids: Column) -> Column:
    """Keep a value where it differs from the one before."""
    return F.filter(ids, lambda x, i: (i == 0) | (x != F.get(ids, i - 1)))


def best_path(ids: Column, blank: int = 0, length: Column | None = None) -> Column:
    """Collapse repeats, then drop blanks; the order of the two matters. Frames from ``length`` on are padding."""
    if length is not None:
        ids = F.slice(ids, F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    return F.filter(collapse_repeats(ids), lambda x: x != blank)


def apply_cmvn(feat: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std per dimension, in single precision like the frames."""
    centred = F.zip_with(feat, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: (x / s).cast("float"))


def crop_start(size: Column, target: Number, key: Column, seed: int | None, epoch: int = 1) -> Column:
    """Start of the crop: 0, or seeded in [0, size - target] when ``seed`` is given."""
    spare = size - _col(target)
    if seed is None:
        return F.lit(0)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), key), F.greatest(spare, F.lit(0)) + 1)
    return F.when(spare > 0, draw).otherwise(F.lit(0)).cast("int")


def crop(values: Column, target: Number, start: Number = 0) -> Column:
    """``target`` elements from ``start``; shorter arrays stay as they are."""
    longer = F.size(values) > _col(target)
    return F.when(
        longer, F.slice(values, (_col(start) + 1).cast("int"), _col(target).cast("int"))
    ).otherwise(values)


def pad(values: Column, target: Number, filler: Column) -> Column:
    """Fillers on the right up to ``target`` elements."""
    missing = F.greatest(_col(target) - F.size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(filler, missing))


def padding_mask(size: Column, target: Number) -> Column:
    """True on the positions that ``pad`` filled."""
    return F.transform(upto(_col(target)), lambda i: i >= size)


def pool_padding_mask(mask: Column, length: Column) -> Column:
    """Down-sample a padding mask to ``length``: a group is padding if all of it is."""
    width = F.floor(F.size(mask) / length).cast("int")
    return F.transform(
        upto(length), lambda i: F.forall(F.slice(mask, i * width + 1, width), lambda p: p)
    )


def stride_labels(labels: Column, length: Number, ratio: int) -> Column:
    """Every ``ratio``-th label, for ``strided_length`` frames."""
    kept = strided_length(labels, length, ratio)
    return F.slice(F.filter(labels, lambda x, i: i % ratio == 0), F.lit(1), kept.cast("int"))


def strided_length(labels: Column, length: Number, ratio: int) -> Column:
    """Frames that have a label: all, or floor(labels / ratio) when labels are short."""
    return F.least(_col(length), F.floor(F.size(labels) / ratio)).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value worked out once rather than per use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(logits: Column, temperature: float = 1.0) -> Column:
    """ln of the summed exponentials of z / t, shifted by the maximum."""

    def shifted(top: Column) -> Column:
        total = F.aggregate(
            logits, F.lit(0.0), lambda acc, z: acc + F.exp((z.cast("double") - top) / temperature)
        )
        return top / temperature + F.ln(total)

    return bound(F.array_max(logits).cast("double"), shifted)


def cross_entropy(logits: Column, target: Column, temperature: float = 1.0) -> Column:
    """logsumexp(z / t) - z[target] / t."""
    return log_sum_exp(logits, temperature) - F.get(logits, target).cast("double") / temperature


def log_softmax(logits: Column) -> Column:
    """Log-probabilities of one frame's scores."""
    return bound(log_sum_exp(logits), lambda norm: F.transform(logits, lambda z: z.cast("double") - norm))


def to_mono(channels: Column) -> Column:
    """Mean over channels, sample by sample."""
    first = F.transform(F.get(channels, F.lit(0)), lambda x: x.cast("double"))
    summed = F.aggregate(
        F.slice(channels, F.lit(2), F.greatest(F.size(channels) - 1, F.lit(0))),
        first,
        lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b),
    )
    return F.transform(summed, lambda x: x / F.size(channels))


def to_16_bit(samples: Column) -> Column:
    """Scale [-1, 1] samples to the 16-bit range."""
    return F.transform(samples, lambda x: x * 32768)


def signal_frames(samples: Column, width: int, hop: int) -> Column:
    """Overlapping frames of one whole signal; an incomplete tail is dropped."""
    count = F.greatest(F.floor((F.size(samples) - width) / hop) + 1, F.lit(0))
    return F.transform(upto(count), lambda i: F.slice(samples, i * hop + 1, width))
