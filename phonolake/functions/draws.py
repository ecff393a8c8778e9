"""Seeded draws, the same on every run and under every partitioning.

Numbers come from md5 of seed and key. Several distinct positions come from a keyed permutation:
a Feistel network over a grid of rows and columns, in arithmetic that stays below 2**63, so
that the first k of n positions cost about k, not n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw32(*parts: Column | str | int) -> Column:
    """A number in [0, 2**32) from the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def randint(bound: Column, *parts: Column | str | int) -> Column:
    """An integer in [0, bound); 0 for an empty range."""
    return F.when(bound > 0, F.pmod(draw32(*parts), bound)).otherwise(F.lit(0)).cast("int")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return draw32(*parts) / F.lit(4294967296.0)


PRIME = (1 << 31) - 1
ROUNDS = 4


def round_keys(*parts: Column | str | int) -> Column:
    """One number below ``PRIME`` for each round, from the digits of an md5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    digits = F.md5(text)
    return F.array(*[F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") % PRIME for i in range(ROUNDS)])


def permuted(count: Column, room: Column, keys: Column) -> Column:
    """The first ``count`` positions of a keyed permutation of [0, room): distinct, unsorted.

    Positions are cells of a grid just larger than ``room``; fewer than one column of its cells lie
    beyond, so that many more are drawn and those beyond are left out. ``count`` is at most ``room``; ``room`` and
    ``keys`` (see ``round_keys``) should be columns of their own, as they are read in every round.
    """
    wide = F.ceil(F.sqrt(room)).cast("bigint")
    high = F.floor((room + wide - 1) / wide).cast("bigint")
    drawn = F.least(count + wide, wide * high)
    cells = F.transform(
        F.sequence(F.lit(0).cast("bigint"), drawn - 1),
        lambda i: F.struct((i % wide).alias("x"), F.floor(i / wide).cast("bigint").alias("y")),
    )

    def shift(value: Column, number: int) -> Column:
        sum_ = (value + F.get(keys, F.lit(number))) % PRIME
        return sum_ * sum_ % PRIME

    def column_moved(number: int) -> Callable[[Column], Column]:
        return lambda c: F.struct(((c["x"] + shift(c["y"], number)) % wide).alias("x"), c["y"].alias("y"))

    def row_moved(number: int) -> Callable[[Column], Column]:
        return lambda c: F.struct(c["x"].alias("x"), ((c["y"] + shift(c["x"], number)) % high).alias("y"))

    for number in range(ROUNDS):
        cells = F.transform(cells, (row_moved if number % 2 else column_moved)(number))
    places = F.filter(F.transform(cells, lambda c: c["x"] + wide * c["y"]), lambda p: p < room)
    return F.slice(places, F.lit(1), count.cast("int"))
