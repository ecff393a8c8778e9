"""Unit-cost edit distance between token sequences, bit-parallel.

A column of the dynamic-programming table differs from the one before by -1, 0 or 1
in every cell, so a column is two bit strings, and a token of the shorter side takes it to the next
in a dozen operations on whole bit strings. Python's integers are such strings of any length: they
work in blocks, with the carry running through, so that a pair costs its tokens times the blocks of the
longer side, whatever the number of distinct tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Beyond so many tokens equal ends are cut off and bit strings are packed by numpy.
SHORT = 96


def bits_of(long: Sequence[int], wanted: Sequence[int]) -> dict[int, int]:
    """For every wanted token the bit string of its places in ``long``."""
    if len(long) <= SHORT:
        places: dict[int, int] = {}
        for at, token in enumerate(long):
            places[token] = places.get(token, 0) | 1 << at
        return places
    ids = np.asarray(long, np.int64)
    order = np.argsort(ids, kind="stable")
    ranked, places = ids[order], {}
    cells = np.zeros(len(ids), np.uint8)
    some = np.unique(np.asarray(wanted, np.int64))
    for token, lo, hi in zip(some.tolist(), np.searchsorted(ranked, some), np.searchsorted(ranked, some, "right")):
        if lo < hi:
            cells[order[lo:hi]] = 1
            places[token] = int.from_bytes(np.packbits(cells, bitorder="little").tobytes(), "little")
            cells[order[lo:hi]] = 0
    return places


def without_equal_ends(left: Sequence[int], right: Sequence[int]) -> tuple[Sequence[int], Sequence[int]]:
    a, b = np.asarray(left, np.int64), np.asarray(right, np.int64)
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    lead = int(other[0]) if len(other) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    other = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(other[0]) if len(other) else n
    return a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()


def distance(left: Sequence[int], right: Sequence[int]) -> int:
    """Insertions, deletions and replacements that turn one sequence into the other."""
    if len(left) > SHORT or len(right) > SHORT:
        left, right = without_equal_ends(left, right)
    long, short = (left, right) if len(left) >= len(right) else (right, left)
    if not short:
        return len(long)
    places = bits_of(long, short)
    full = (1 << len(long)) - 1
    last = 1 << (len(long) - 1)
    up, down, score = full, 0, len(long)
    for token in short:
        same = places.get(token, 0)
        flat = same | down
        across = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(across | up))
        fall = up & across
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = rise << 1 | 1
        up = (fall << 1 | (full & ~(flat | rise))) & full
        down = rise & flat
    return score


def token_ids(left: pa.ListArray, right: pa.ListArray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Tokens of two list columns as numbers, joined, and where each row's begin; NULL is a token, a NULL list is empty."""
    parts = [left.flatten(), right.flatten()]
    parts = [parts[0], parts[1].cast(parts[0].type)]
    codes = pa.concat_arrays(parts).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).tolist()
    cuts = [[0, *np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()] for x in (left, right)]
    return codes[: len(parts[0])], codes[len(parts[0]) :], cuts[0], cuts[1]


def distances(left: pa.ListArray, right: pa.ListArray) -> pa.Array:
    """The edit distance of every row."""
    a, b, at, to = token_ids(left, right)
    rows = zip(at[:-1], at[1:], to[:-1], to[1:])
    return pa.array([distance(a[i:j], b[k:m]) for i, j, k, m in rows], pa.int64())
