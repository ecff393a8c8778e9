"""Look-up of array elements in a table of distinct keys inside tasks, without a row per element."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table is sent to the tasks up to this many bytes (keys and 24 more an entry); a larger one is joined.
TABLE_BYTES = 64 << 20

Table = tuple[np.ndarray, pa.Array, pa.Array]


def key_numbers(keys: pa.Array) -> np.ndarray:
    """A 64-bit number for each key: itself if it is one, else a hash of its text."""
    if pa.types.is_integer(keys.type):
        return keys.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return pd.util.hash_array(keys.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def sorted_table(keys: pa.Array, values: pa.Array) -> Table:
    """Numbers of the keys in rising order, with keys and values in that order."""
    numbers = key_numbers(keys)
    order = np.argsort(numbers, kind="stable")
    return numbers[order], keys.take(pa.array(order)), values.take(pa.array(order))


def places(table: Table, wanted: pa.Array) -> np.ndarray:
    """Place of each wanted key in the table, -1 for none. Equal numbers lie side by side and keys decide."""
    numbers, keys, _ = table
    found = np.full(len(wanted), -1)
    asked = key_numbers(wanted)
    at = np.searchsorted(numbers, asked)
    left = np.arange(len(wanted))
    while len(left):
        left = left[at[left] < len(numbers)]
        left = left[numbers[at[left]] == asked[left]]
        if not len(left):
            break
        same = pc.equal(keys.take(pa.array(at[left])), wanted.take(pa.array(left))).to_numpy(zero_copy_only=False)
        found[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    return found


def look_up(table: Table, arrays: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Sizes of the arrays (NULL is empty), their elements one after the other, and each one's value or NULL.

    An element is looked up once for all its occurrences in the batch.
    """
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    elements = arrays.flatten()
    coded = elements.dictionary_encode()
    distinct = coded.dictionary
    at = np.append(places(table, distinct), -1)[pc.fill_null(coded.indices, len(distinct)).to_numpy(zero_copy_only=False)]
    return sizes, elements, table[2].take(pa.array(at, mask=at < 0))


def kept_sizes(sizes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Sizes of the arrays when only the kept elements stay."""
    before = np.concatenate([[0], np.cumsum(kept)])
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


def as_lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    """Values one after the other as arrays of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def share_table(table: DataFrame, key: str, value: str) -> tuple[DataFrame, Broadcast | None]:
    """The ``(key, value)`` to join, and its sorted form in every task if it is within ``TABLE_BYTES``.

    A key listed twice has its least value; NULL keys are left out. The table is read once for its size
    and once for its rows, so hand in one that is stored or cheap.
    """
    spark = table.sparkSession
    rows = table.where(F.col(key).isNotNull()).select(key, F.col(value).alias("_value"))
    size = F.sum(F.octet_length(F.col(key).cast("string")) + F.octet_length(F.col("_value").cast("string")) + 24)
    if (rows.agg(size).first()[0] or 0) > TABLE_BYTES:
        return rows.groupBy(key).agg(F.min("_value").alias("_value")), None
    small = rows.toArrow().sort_by([(key, "ascending"), ("_value", "ascending")])
    return rows, spark.sparkContext.broadcast(sorted_table(*[c.combine_chunks() for c in small.columns]))
