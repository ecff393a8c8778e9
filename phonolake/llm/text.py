"""Whole texts as byte arrays inside Arrow tasks, and helpers that several operators share.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]+``. Separators are ASCII, so
words are cut on UTF-8 bytes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LAST_ID = (1 << 63) - 1
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, nulls as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive whole rows, about ``limit`` bytes at a time.

    A longer text is a chunk of its own, so memory follows the longest text only.
    """
    yield from row_ranges(*raw(column), limit)


def row_ranges(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``chunks``, of rows given by their bytes and offsets."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Byte spans of the words of a chunk; row ``r`` has words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def cut_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def powers(n: int, base: np.uint64 = PRIME) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64 = PRIME) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each of the non-empty, ascending, disjoint spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    sums = np.zeros(hi - lo + 1, np.uint64)
    part = data[lo:hi].astype(np.uint64)
    part += np.uint64(1)
    part *= powers(hi - lo)
    np.cumsum(part, out=sums[1:])
    whole = (sums.take(ends - lo) - sums.take(starts - lo)) * powers(hi - lo, inverse()).take(starts - lo)
    return mix(whole + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def first_seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending position of each distinct key's first occurrence, for each key the index of its own)."""
    _, one, codes = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(one)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return one[order], place[codes]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.back = powers(n + 1, inverse())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.back[start])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every stretch of ``width`` values."""
    low, at, done = values, np.arange(len(values), dtype=np.int64), 1
    while done < width:
        step = min(done, width - done)
        left, right = slice(0, len(low) - step), slice(step, len(low))
        second = low[right] < low[left]
        at = np.where(second, at[right], at[left])
        low = np.where(second, low[right], low[left])
        done += step
    return at


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions below ``size`` inside any of the spans."""
    change = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(change[:size]) > 0


def id_key(doc_id: str) -> Column:
    """The id for comparing; null ids come after all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))


def public_id(doc: str = "doc") -> Column:
    """The id as given, from that of ``id_key``."""
    return F.when(F.col(doc) != LAST_ID, F.col(doc)).alias("doc_id")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc``, ``tag``, ``text``: id and a hash of the text, which tell rows of a repeated id apart."""
    return docs.select(
        id_key(doc_id).alias("doc"),
        F.hash(F.col(text).cast("string")).alias("tag"),
        F.col(text).cast("string").alias("text"),
    )
