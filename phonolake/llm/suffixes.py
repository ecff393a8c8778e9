"""Exact removal of repeated byte strings with a sparse, range-partitioned suffix array.

Every window of bytes has an anchor: the position, among those in its middle,
whose eight bytes hash lowest. Equal windows have equal anchors at equal offsets,
so the suffixes that start a little before each anchor (at the core, the bytes
common to all windows of the anchor) stand for the suffixes at every byte.

Sampled splitters range-partition these suffixes by leading bytes, then by the
names of core and whole stretch and by place, so even a core with very many rows
is spread out. Each bucket is sorted locally by multikey quicksort (a token at
a time, only what is still tied goes on), neighbours are compared, and the first
and last suffixes of the buckets are compared across boundaries. A stretch equal
to a neighbour's is repeated as a whole. Stretches that share a core but differ
go to a second sort, over the suffixes at each of their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phonolake.llm.recompression import with_spans
from phonolake.llm.text import Rolling, chunks, covered, keyed, leftmost_minimum, mix, public_id
from phonolake.session import materialise

GRAM = 8
#: Part of a window's bytes at either end where its anchor doesn't lie.
MARGIN = 0.12
#: The second sort compares windows by so many tokens.
TOKENS = 5
#: A core with more stretches than this is dealt out by window offset.
SLICE_ROWS = 2000


def reach(window: int) -> tuple[int, int]:
    """Smallest and largest distance of a window's anchor from its start."""
    low = int(window * MARGIN)
    return low, window - GRAM - low


def multikey_order(n: int, tokens) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of ``n`` suffixes by their tokens; equal ones share a group, numbered along the order.

    ``tokens`` are functions from suffix numbers to values. Each goes over the suffixes that all
    tokens before it left tied.
    """
    order, group, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for token in tokens:
        if not len(tied):
            break
        value = token(order[tied])
        put = np.lexsort((value, group[tied]))
        order[tied] = order[tied][put]
        value = value[put]
        step = np.zeros(n, np.int64)
        step[tied[1:]] = value[1:] != value[:-1]
        step[1:] |= group[1:] != group[:-1]
        group = np.cumsum(step)
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
    return order, group


def find_stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The anchors of all windows of the texts of a chunk, by the window stretches they stand for."""
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    if not counts.sum():
        return {k: np.zeros(0, np.int64) for k in ("row", "at", "n", "off", "lead", "core", "whole")}
    low, high = reach(window)
    grams = np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data), 0, (1,))
    best = leftmost_minimum(mix(grams), high - low + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    anchor = best[begin + low]
    fresh = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    n = np.diff(np.append(fresh, len(anchor)))
    a, p, row = anchor[fresh], begin[fresh], row[fresh]
    rolling = Rolling(data.astype(np.uint64) + np.uint64(1))
    shape = mix(((a - p) * (window + 1) + n).astype(np.uint64))
    lead = grams[a - low].byteswap() ^ np.uint64(1 << 63)
    found = {"lead": lead, "core": rolling.of(a - low, window - high + low), "whole": rolling.of(p, window - 1 + n) ^ shape}
    return {"row": row, "at": p - offsets[row], "n": n, "off": a - p} | {k: v.view(np.int64) for k, v in found.items()}


PLACE = "doc long, tag int, at long, n int, off int"


def suffix_rows(docs: DataFrame, window: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                found = find_stretches(data, offsets, window)
                where = pa.array(found["row"] + row)
                out = {"doc": batch.column(0).take(where), "tag": batch.column(1).take(where), "at": found["at"]}
                out |= {k: pa.array(found[k], pa.int32()) for k in ("n", "off")} | {k: found[k] for k in ("lead", "core", "whole")}
                yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(task, f"{PLACE}, lead long, core long, whole long")


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """Each bucket's suffixes that equal a neighbour's stretch (``alike``) or only its core (``kin``), and its ends."""

    def task(batches):
        batches = list(batches)
        if not batches:
            return
        bucket = pa.Table.from_batches(batches).combine_chunks()
        if not len(bucket):
            return
        lead, core, whole = (bucket.column(c).to_numpy() for c in ("lead", "core", "whole"))
        order, group = multikey_order(len(bucket), [lambda i: lead[i], lambda i: core[i], lambda i: whole[i]])
        sorted_core, sorted_lead = core[order], lead[order]
        same = np.append(group[1:] == group[:-1], False)
        near = np.append((sorted_core[1:] == sorted_core[:-1]) & (sorted_lead[1:] == sorted_lead[:-1]), False) & ~same
        alike, kin = same | np.append(False, same[:-1]), near | np.append(False, near[:-1])
        edge = np.zeros(len(order), np.int32)
        edge[0] += 1
        edge[-1] += 2
        keep = alike | kin | (edge > 0)
        out = bucket.take(pa.array(order[keep]))
        for name, value in (("alike", alike), ("kin", kin), ("edge", edge)):
            out = out.append_column(name, pa.array(value[keep]))
        out = out.append_column("bucket", pa.array(np.full(len(out), TaskContext.get().partitionId(), np.int32)))
        yield from out.to_batches(max_chunksize=1 << 16)

    ranged = rows.repartitionByRange("lead", "core", "whole", "doc", "at")
    return ranged.mapInArrow(task, f"{PLACE}, lead long, core long, whole long, alike boolean, kin boolean, edge int, bucket int")


def across_boundaries(found: DataFrame) -> DataFrame:
    """The bucket ends, two rows a bucket at most, with the marks that the neighbouring buckets' ends add."""
    line = Window.orderBy("bucket", "edge")
    ends = found.filter("edge > 0")
    key, core = F.struct("lead", "core", "whole"), F.struct("lead", "core")
    same, near = F.lit(False), F.lit(False)
    for other in (F.lag, F.lead):
        apart = other("bucket").over(line) != F.col("bucket")
        equal = F.coalesce(apart & (other(key).over(line) == key), F.lit(False))
        same = same | equal
        near = near | (F.coalesce(apart & (other(core).over(line) == core), F.lit(False)) & ~equal)
    return ends.select(*found.columns, same.alias("s"), near.alias("k")).withColumns(
        {"alike": F.col("alike") | F.col("s"), "kin": F.col("kin") | F.col("k")}
    ).drop("s", "k")


def stretch_bytes(docs: DataFrame, window: int) -> DataFrame:
    """The bytes of the listed stretches of each text."""

    def task(batches):
        for batch in batches:
            listed = batch.column(3).to_pylist()
            for row, data, offsets in chunks(batch.column(2)):
                body, out = data.tobytes(), []
                for r in range(len(offsets) - 1):
                    for x in listed[row + r]:
                        begin = int(offsets[r]) + x["at"]
                        out.append((row + r, x["at"], x["n"], x["off"], x["core"], x["alike"], x["slices"], body[begin : begin + x["n"] + window - 1]))
                where, *columns = zip(*out) if out else [[]] * 8
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
                rows = pa.array(where, pa.int64())
                arrays = [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "tag", "at", "n", "off", "core", "alike", "slices", "body"])

    return docs.mapInArrow(task, f"{PLACE}, core long, alike boolean, slices int, body binary")


def repeated_windows(stretches: DataFrame, window: int) -> DataFrame:
    """Spans of the windows of stretches that another stretch of the same core has as well.

    ``slice`` of ``slices``: the share of the core's windows, by distance from the anchor, that the row is for.
    """

    def task(batches):
        for part in bounded(batches):
            n, body = part.column("n").to_numpy(), part.column("body").combine_chunks()
            slices, own = part.column("slices").to_numpy(), part.column("slice").to_numpy()
            offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            begin = offsets[:-1] - offsets[0]
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            distance = part.column("off").to_numpy()[which] - step
            mine = distance % slices[which] == own[which]
            which, step = which[mine], step[mine]
            start = begin[which] + step
            rolling, size = Rolling(data.astype(np.uint64) + np.uint64(1)), -(-window // TOKENS)
            cuts = [min(k * size, window - size) for k in range(TOKENS)]
            order, group = multikey_order(len(start), [lambda i, c=c: rolling.of(start[i] + c, size) for c in cuts])
            again = np.zeros(len(start), bool)
            again[order] = np.bincount(group, minlength=1)[group] > 1
            again &= ~part.column("alike").to_numpy(zero_copy_only=False)[which]
            hit = np.flatnonzero(again)
            rows, at = pa.array(which[hit]), part.column("at").to_numpy()[which[hit]] + step[hit]
            run = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (which[hit][1:] != which[hit][:-1]))) if len(hit) else hit
            last = np.append(run[1:], len(at)) - 1 if len(hit) else hit
            doc, tag = (part.column(c).combine_chunks().take(rows).take(pa.array(run)) for c in ("doc", "tag"))
            yield pa.RecordBatch.from_arrays([doc, tag, pa.array(at[run]), pa.array(at[last] + window)], ["doc", "tag", "start", "stop"])

    return stretches.mapInArrow(task, "doc long, tag int, start long, stop long")


def bounded(batches):
    """Tables of whole groups (``core``, ``slice``; rows are sorted), several groups at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.nbytes for t in held) > 1 << 23:
            table = pa.concat_tables(held).combine_chunks()
            core, own = table.column("core").to_numpy(), table.column("slice").to_numpy()
            other = np.flatnonzero((core != core[-1]) | (own != own[-1]))
            if len(other):
                yield table.slice(0, int(other[-1]) + 1)
                table = table.slice(int(other[-1]) + 1)
            held = [table]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def repeated_byte_spans(docs: DataFrame, window: int) -> DataFrame:
    """``doc, tag, start, stop`` of all windows of bytes that occur more than once; ``docs`` is a result of ``keyed``."""
    found = materialise(sorted_buckets(materialise(suffix_rows(docs, window), "suffixes")), "sorted")
    found = found.filter("edge = 0").unionByName(across_boundaries(found)).filter("alike OR kin")
    found = materialise(found, "repeats")
    whole = found.filter("alike").select("doc", "tag", F.col("at").alias("start"), (F.col("at") + F.col("n") + (window - 1)).alias("stop"))
    kin = found.filter("kin")
    many = materialise(kin.groupBy("core").agg(F.count("*").alias("m")), "cores")
    slices = F.least(F.ceil(F.col("m") / SLICE_ROWS), F.lit(window)).cast("int")
    listed = kin.join(many.withColumn("slices", slices), "core").groupBy("doc", "tag")
    listed = listed.agg(F.collect_set(F.struct("at", "n", "off", "core", "alike", "slices")).alias("listed"))
    rows = stretch_bytes(docs.join(listed.hint("shuffle_hash"), ["doc", "tag"]), window)
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.repartition("core", "slice").sortWithinPartitions("core", "slice")
    return whole.unionByName(repeated_windows(rows, window))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts anywhere else, in any text.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` for every row; ``n_spans`` counts maximal removed
    runs and ``kept`` is binary, as a cut may fall inside a character. Matches never cross texts. Null and
    empty texts are zero bytes. Rows of a repeated id are texts of their own, so equal long rows lose
    everything; a null id stays null. Other columns are not read.
    """
    base = keyed(docs, doc_id, text)
    rows = with_spans(base, repeated_byte_spans(base, window), "doc", "text")

    def task(batches):
        for batch in batches:
            starts, stops = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for row, data, offsets in chunks(batch.column(1)):
                for r in range(len(offsets) - 1):
                    body = data[offsets[r] : offsets[r + 1]]
                    if not starts[row + r]:
                        out.append((len(body), 0, 0, body.tobytes()))
                        continue
                    gone = covered(np.array(starts[row + r]), np.array(stops[row + r]), len(body))
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(body), int(gone.sum()), runs, body[~gone].tobytes()))
            columns = zip(*out) if out else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.binary()]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.mapInArrow(task, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(public_id(), "n_bytes", "n_removed", "n_spans", "kept")
