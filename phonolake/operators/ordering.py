"""Positions, running sums and previous values over an order, without one-task windows.

A window with no partition, or partitioned by a key that owns a third of the
rows, runs in one task. ``ordered_scan`` range-partitions on (group, order)
instead, so that a large group spreads over many blocks. Each task scans its block
once, carrying state along, and what the earlier blocks of the same group contribute is added.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def ordered_scan(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    position: str | None = None,
    sums: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan each group of ``df`` in ``order``, which must be total within the group.

    ``position`` names a 0-based position column, ``sums`` maps new columns to
    the columns whose sum over the *earlier* rows they hold, ``previous`` maps
    new columns to the columns whose value on the row before they hold.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    group = list(group)
    sort_keys = [F.col(c).asc() for c in group] + list(order)
    member = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))

    ordered = (
        df.repartitionByRange(*sort_keys)
        .sortWithinPartitions(*sort_keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_block", F.shiftrightunsigned("_row", 33))
    )
    if group or sums or previous:
        scanned = scan_partitions(ordered, group, sums, previous)
    else:  # the row's own number in its block
        scanned = ordered.withColumn("_at", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    scanned = materialise(scanned, "ordered-scan")

    # One row per block: which group it starts and ends with, and the ending group's totals.
    tail = F.struct(
        (F.col("_at") + 1).alias("rows"),
        *[F.col(f"_thru_{new}").alias(f"sum_{new}") for new in sums],
        *[F.col(source).alias(f"last_{new}") for new, source in previous.items()],
    )
    bounds = scanned.groupBy("_block").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    corners = scanned.join(F.broadcast(bounds), "_block").where(F.col("_row").isin(F.col("_first"), F.col("_last")))
    edges = corners.groupBy("_block").agg(
        F.min_by(member, "_row").alias("head"),
        F.max_by(member, "_row").alias("end"),
        F.max_by(tail, "_row").alias("tail"),
    )
    same_end = (
        Window.partitionBy("end").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    blocks = Window.orderBy("_block")  # as many rows as there are blocks
    carried = edges.select(
        "_block",
        "head",
        "end",
        F.struct(
            F.sum("tail.rows").over(same_end).alias("rows"),
            *[F.sum(f"tail.sum_{new}").over(same_end).alias(f"sum_{new}") for new in sums],
            *[F.col(f"tail.last_{new}").alias(f"last_{new}") for new in previous],
        ).alias("run"),
    ).select(
        F.col("_block"),
        F.col("head").alias("_head"),
        F.when(F.lag("end").over(blocks).eqNullSafe(F.col("head")), F.lag("run").over(blocks)).alias("_carry"),
    )
    out = scanned.join(F.broadcast(carried), "_block", "left")
    carry = F.when(member.eqNullSafe(F.col("_head")), F.col("_carry"))
    columns = list(df.columns)
    made = []
    if position:
        made.append((F.col("_at") + F.coalesce(carry["rows"], F.lit(0))).alias(position))
    for new, source in sums.items():
        earlier = F.col(f"_thru_{new}") - F.coalesce(F.col(source), F.lit(0))
        made.append(
            (F.coalesce(earlier, F.lit(0)) + F.coalesce(carry[f"sum_{new}"], F.lit(0))).alias(new)
        )
    for new in previous:
        made.append(F.when(F.col("_at") == 0, carry[f"last_{new}"]).otherwise(F.col(f"_back_{new}")).alias(new))
    return out.select(*columns, *made)


def scan_partitions(
    ordered: DataFrame, group: Sequence[str], sums: Mapping[str, str], previous: Mapping[str, str]
) -> DataFrame:
    """Sorted partitions with ``_at``, ``_thru_*`` and ``_back_*`` within partition and group.

    Each task goes through its rows once, batch by batch, and carries on from batch to batch the last
    row's group, its place, the sums and the values to hand on: no second shuffle.
    """
    names = ordered.columns
    keys = [names.index(c) for c in group]
    added, kinds = [names.index(c) for c in sums.values()], []
    for source in sums.values():
        kind = ordered.schema[source].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            raise TypeError(f"a running sum of {source} needs numbers, not {kind}")
        kinds.append("double" if kind in ("float", "double") else "bigint")
    handed = [names.index(c) for c in previous.values()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        totals = [0.0 if k == "double" else 0 for k in kinds]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for i in keys:
                begins[1:] |= changes(batch.column(i))
            first = tuple(batch.column(i)[0].as_py() for i in keys)
            begins[0] = last is None or first != last[0]
            start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            old = start < 0
            at = np.where(old, np.arange(n) + place, np.arange(n) - start)
            columns = [pa.array(at.astype(np.int64))]
            for k, i in enumerate(added):
                kind = np.float64 if kinds[k] == "double" else np.int64
                column = batch.column(i)
                values = np.nan_to_num(column.cast(pa.float64()).to_numpy(zero_copy_only=False)) if kind is np.float64 and column.null_count else None
                if values is None:
                    values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                if kind is np.float64:
                    thru = grouped_sums(values, np.flatnonzero(begins), totals[k])
                else:
                    run = np.cumsum(values)
                    thru = np.where(old, run + totals[k], run - np.append(0, run)[np.maximum(start, 0)])
                totals[k] = thru[-1]
                columns.append(pa.array(thru))
            for k, i in enumerate(handed):
                column = batch.column(i)
                head = pa.nulls(1, column.type) if begins[0] else last[1][k]
                back = pa.concat_arrays([head, column.slice(0, n - 1)])
                columns.append(pc.if_else(pa.array(begins), pa.scalar(None, column.type), back))
            last = (tuple(batch.column(i)[n - 1].as_py() for i in keys), [batch.column(i).slice(n - 1, 1) for i in handed])
            place = int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *made])

    made = ["_at", *[f"_thru_{c}" for c in sums], *[f"_back_{c}" for c in previous]]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields] + ["_at bigint"]
    types += [f"`_thru_{c}` {k}" for c, k in zip(sums, kinds)]
    types += [f"`_back_{c}` {ordered.schema[source].dataType.simpleString()}" for c, source in previous.items()]
    return ordered.mapInArrow(task, ", ".join(types))


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; NULL equals NULL."""
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values[1:], values)], bool)
    differ = pc.fill_null(pc.not_equal(left, right), False).to_numpy(zero_copy_only=False)
    return differ | (left.is_null().to_numpy(zero_copy_only=False) != right.is_null().to_numpy(zero_copy_only=False))


def grouped_sums(values: np.ndarray, begins: np.ndarray, carried: float) -> np.ndarray:
    """Running sums that start anew at ``begins``; the first stretch goes on from ``carried``."""
    out = np.empty(len(values))
    cuts = np.unique(np.concatenate([[0], begins, [len(values)]]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        out[lo:hi] = np.cumsum(values[lo:hi])
        if lo == 0 and not (len(begins) and begins[0] == 0):
            out[lo:hi] += carried
    return out


def file_order(file: str) -> list[Column]:
    """Folder, part number and name: the order in which Spark wrote the files of a folder."""
    folder = F.regexp_extract(file, "^(.*)/", 1)
    part = F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    return [folder, part, F.col(file)]


def line_index(lines: DataFrame, index: str = "line_no") -> DataFrame:
    """0-based line number over the text files of one scan, in (folder, file, offset) order.

    Files that Spark wrote go by their part number, which outgrows its five digits.

    ``lines`` must carry ``file``, ``block`` and ``row`` from ``read_lines``.
    The scan numbers rows inside each file block; block counts, a table of one
    row per block, are summed up, written, and joined back to the rows. The
    lines are a written table, so that both readings see the same blocks.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
    before = Window.orderBy(*file_order("file"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", "first_row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    start = F.when(F.col("start").isNull(), F.raise_error(F.lit("a line of an unknown block"))).otherwise(F.col("start"))
    return lines.join(materialise(starts, "line-blocks"), ["file", "block"], "left").select(
        *[c for c in lines.columns if c not in ("block", "row")],
        (start + F.col("row") - F.col("first_row")).cast("bigint").alias(index),
    )


def ordered_indices(
    df: DataFrame, key: str, size: str, seed: int | None = None, epoch: int = 1, position: str = "pos"
) -> DataFrame:
    """Longest first. Ties go from the last sample to the first, or in seeded order."""
    if seed is None:
        order = [F.col(size).desc(), F.col(key).desc()]
    else:
        order = [F.col(size).desc(), F.xxhash64(F.lit(seed), F.lit(epoch), key), F.col(key)]
    return ordered_scan(df, order, position=position)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, position: str = "pos") -> DataFrame:
    """Seeded order of an epoch: the same whatever the partitioning."""
    keyed = df.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key))))
    return ordered_scan(keyed, [F.col("_draw"), F.col(key)], position=position).drop("_draw")


def shard_of_batch(batches: DataFrame, num_shards: int, batch: str = "batch_id") -> DataFrame:
    """Deal batches to data-parallel shards in turn: ``shard`` and the ``step`` within it."""
    return batches.withColumn("shard", F.col(batch) % num_shards).withColumn(
        "step", F.expr(f"{batch} div {int(num_shards)}")
    )
