"""SimHash near-dedup by anchor-point covering.

Documents of equal fingerprint are one node. Two fingerprints at most three bits
apart differ in at most one bit of one of their halves. On 31 bits of each half
the codewords of the Hamming code are the anchors: every word has one within
covering radius 1. A fingerprint goes to every anchor within radius 1 plus
threshold 1 of its half, 15.5 on average, so two linked fingerprints meet at the
anchor nearest to one of them. Per anchor they are compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.components import connected, local_stars
from phonolake.llm.text import chunks, cut_words, keyed, lower_ascii, public_id
from phonolake.session import materialise

HASH_SEED = 42
ANCHOR_BITS = 31
SMALL = 32


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is 1 in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        block = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def text_fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    digest, out = xxhash.xxh64_intdigest, []
    for _, data, offsets in chunks(column):
        words = cut_words(lower_ascii(data), offsets)
        size = words.ends - words.starts
        put = np.cumsum(size + 1) - size - 1
        flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
        source = np.repeat(words.starts - put, size) + (where := np.repeat(put, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
        flat[where] = words.data[source]
        joined, begin, end = flat.tobytes(), put.tolist(), (put + size).tolist()
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            step = min(shingle, hi - lo)
            spans = zip(begin[lo : hi - step + 1], end[lo + step - 1 : hi]) if step else ()
            out.append(fingerprint(np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in spans), np.uint64)))
    return np.array(out, np.uint64)


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc, tag`` (see ``keyed``) and ``fp`` of every row."""

    def task(batches):
        for batch in batches:
            fp = pa.array(text_fingerprints(batch.column(2), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fp], ["doc", "tag", "fp"])

    return keyed(docs, doc_id, text).mapInArrow(task, "doc long, tag int, fp long")


def anchors(fp: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fp``, anchor) for all codewords within distance 2 of the 31 bits of that half."""
    word = (fp >> np.uint64(32 * half)) & np.uint64((1 << ANCHOR_BITS) - 1)
    syndrome = np.zeros(len(fp), np.int64)
    for bit in range(ANCHOR_BITS):
        syndrome ^= np.where((word >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
    i = np.arange(ANCHOR_BITS + 1)[:, None]
    j = i ^ syndrome[None, :]
    valid = (i < j) | ((i == 0) & (j == 0))
    flip = np.where(i > 0, np.int64(1) << np.maximum(i - 1, 0), 0) ^ np.where(j > 0, np.int64(1) << np.maximum(j - 1, 0), 0)
    which = np.broadcast_to(np.arange(len(fp)), j.shape)[valid]
    return which, word.view(np.int64)[which] ^ flip[valid]


def replicas(nodes: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 1 << 14):
                part = fp[lo : lo + (1 << 14)]
                for half in (0, 1):
                    which, anchor = anchors(part, half)
                    key = anchor | np.int64(half << ANCHOR_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[which].view(np.int64))], ["anchor", "fp"])

    return nodes.mapInArrow(task, "anchor long, fp long")


def group_links(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of a group within ``bits`` of each other; rows are sorted by group."""
    a, b = [], []
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(edge, len(group)))
    small = np.repeat(size <= SMALL, size)
    for gap in range(1, SMALL):
        i = np.flatnonzero(small[:-gap] & (group[:-gap] == group[gap:])) if gap < len(group) else ()
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + gap]) <= bits]
        a.append(fp[i])
        b.append(fp[i + gap])
    for k in np.flatnonzero(size > SMALL):
        rest = fp[edge[k] : edge[k] + size[k]]
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                one = todo.pop()
                near = np.bitwise_count(rest ^ one) <= bits
                if near.any():
                    todo.extend(found := rest[near])
                    a.append(np.full(len(found), one))
                    b.append(found)
                    rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def anchor_links(copies: DataFrame, bits: int) -> DataFrame:
    """Star links ``u, v`` of the fingerprints that meet at an anchor."""

    def task(batches: Iterator[pa.RecordBatch]):
        keep_g, keep_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(g, f):
            a, b = group_links(g, f, bits)
            child, root = local_stars(a.view(np.int64), b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["u", "v"])

        for batch in batches:
            g = np.concatenate([keep_g, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([keep_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield links(g[:cut], f[:cut])
            keep_g, keep_f = g[cut:], f[cut:]
        if len(keep_g):
            yield links(keep_g, keep_f)

    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(task, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """SimHash components of all rows.

    Returns ``doc, tag`` (see ``keyed``), ``fp``, and ``first``, the smallest ``doc, tag`` that
    chains of fingerprints at most ``bits`` (3 or fewer) apart reach. Null and empty texts have
    fingerprint zero and are linked like others. A repeated id gives a row each; a null id keeps
    its row, and is first only if no other member has an id. Other columns are not read.
    """
    if bits > 3:
        raise ValueError("the two anchor codes cover distances up to 3")
    base = materialise(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = materialise(base.groupBy("fp").agg(F.min(F.struct("doc", "tag")).alias("first")), "nodes")
    links = anchor_links(replicas(nodes.select("fp")), bits)
    roots = connected(links)
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = materialise(joined, "roots")
    lowest = materialise(joined.groupBy("root").agg(F.min("first").alias("first")), "components")
    names = materialise(joined.drop("first").join(lowest, "root").select("fp", "first"), "names")
    return base.join(names, "fp").select("doc", "tag", "fp", "first")


def near_duplicate_report(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` as 16 hex digits, ``component_id``: the smallest id of the component."""
    return near_duplicates(docs, shingle=shingle, bits=bits).select(
        public_id(),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        public_id("first.doc").alias("component_id"),
    )
