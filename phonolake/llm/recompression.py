"""Substring dedup of word sequences by recompression.

In rounds, isolated runs of a symbol and pairs (left symbol, right symbol) get
new names. A name is a hash of what it names, so it is the same in every task of
the cluster without an exchange; left and right are a seeded bit of the name.
Whether two neighbours join depends on them and a bounded number of words
around, so equal stretches of text get equal symbols but for a margin at both
ends. Of the symbols inside a window, the one with the smallest key is the
window's anchor: equal windows, wherever they are, have equal anchors at equal
offsets.

Windows are compared by anchor only. Anchors whose common words (shared by all
their windows) occur in one document alone are done. Where all occurrences
agree on the whole stretch, the smallest doc_id keeps it. Only where stretches
differ are single windows named and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.text import Rolling, chunks, covered, cut_words, hash_spans, id_key, keyed, leftmost_minimum, mix, public_id
from phonolake.session import materialise

#: Naming steps: kind and the longest symbol, in words, that it may make.
STEPS = (("run", 2), ("pair", 3), ("pair", 4))
UNSEEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def margin(steps) -> tuple[int, int]:
    """(words of context that decide a boundary on either side, longest symbol)."""
    context, longest = 0, 1
    for kind, cap in steps:
        context += longest if kind == "pair" else cap // 2 + longest
        longest = max(longest, cap)
    return context, longest


def recompress(names: np.ndarray, head: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after all steps; ``head`` marks the first word of a text."""
    at, size = np.arange(len(names)), np.ones(len(names), np.int64)
    for number, (kind, cap) in enumerate(steps):
        if len(names) < 2:
            break
        fits = ~head[1:] & (size[:-1] + size[1:] <= cap)
        if kind == "run":
            same = (names[:-1] == names[1:]) & ~head[1:]
            join = same & fits
            join[1:] &= ~same[:-1]
            join[:-1] &= ~same[1:]
            made = mix(names[:-1] + np.uint64(2 * number + 1))
        else:
            left = (mix(names ^ np.uint64(0xA5A5_0001 * (number + 1))) & np.uint64(1)).astype(bool)
            join = left[:-1] & ~left[1:] & fits
            made = mix(names[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (names[1:] << np.uint64(1)) + np.uint64(number))
        first = np.flatnonzero(join)
        names = names.copy()
        names[first] = made[first]
        size[first] += size[first + 1]
        keep = np.ones(len(names), bool)
        keep[first + 1] = False
        names, at, size, head = names[keep], at[keep], size[keep], head[keep]
    return names, at


def find_anchors(names: np.ndarray, first: np.ndarray, window: int, steps) -> dict[str, np.ndarray]:
    """The anchors of all windows of the texts; ``first`` are the word offsets of the texts.

    Per anchor: the text's row, the first of its windows, their number, and the
    hashes of the words common to all possible windows (core) and of all words
    of its windows (whole).
    """
    context, longest = margin(steps)
    low, high = context, window - context - longest
    if high - low + 1 < longest:
        raise ValueError(f"a window needs at least {2 * context + 2 * longest} words")
    none = {k: np.zeros(0, np.int64) for k in ("row", "at", "n", "core", "whole")}
    sizes = np.diff(first)
    counts = np.maximum(sizes - window + 1, 0)
    if not counts.sum():
        return none
    head = np.zeros(len(names), bool)
    head[first[:-1][sizes > 0]] = True
    symbols, at = recompress(names, head, steps)
    keys = np.full(len(names), UNSEEN)
    keys[at] = mix(symbols ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
    best = leftmost_minimum(keys, high - low + 1)
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    anchor = best[begin + low]
    fresh = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    n = np.diff(np.append(fresh, len(anchor)))
    a, p, row = anchor[fresh], begin[fresh], row[fresh]
    rolling = Rolling(names)
    core = rolling.of(a - low, window - high + low)
    shape = mix(((a - p) * (window + 1) + n).astype(np.uint64))
    whole = rolling.of(p, window - 1 + n) ^ shape
    return {"row": row, "at": p - first[row], "n": n, "core": core.view(np.int64), "whole": whole.view(np.int64)}


def word_names(data: np.ndarray, offsets: np.ndarray):
    words = cut_words(data, offsets)
    return words, hash_spans(data, words.starts, words.ends)


def anchor_rows(docs: DataFrame, window: int, steps) -> DataFrame:
    def task(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                words, names = word_names(data, offsets)
                found = find_anchors(names, words.first, window, steps)
                where = found.pop("row") + row
                out = {"doc": batch.column(0).take(pa.array(where)), "tag": batch.column(1).take(pa.array(where))}
                out |= {"at": pa.array(found["at"]), "n": pa.array(found["n"], pa.int32())}
                yield pa.RecordBatch.from_pydict(out | {k: pa.array(found[k]) for k in ("core", "whole")})

    return docs.mapInArrow(task, "doc long, tag int, at long, n int, core long, whole long")


def window_rows(docs: DataFrame, window: int) -> DataFrame:
    """One row per window of the listed stretches ``(at, n)`` of each text, with the hash of its words."""

    def task(batches):
        for batch in batches:
            listed = batch.column(3).to_pylist()
            for row, data, offsets in chunks(batch.column(2)):
                words, names = word_names(data, offsets)
                rolling = Rolling(names)
                lists = listed[row : row + len(offsets) - 1]
                where = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                at = np.array([y["at"] for x in lists for y in x], np.int64)
                n = np.array([y["n"] for x in lists for y in x], np.int64)
                total = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                where = np.repeat(where, n)
                key = rolling.of(words.first[where] + total, window)
                rows = pa.array(where + row)
                out = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(total)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(key.view(np.int64))], ["doc", "tag", "at", "key"])

    return docs.mapInArrow(task, "doc long, tag int, at long, key long")


def repeated_spans(docs: DataFrame, window: int = 50, steps=STEPS) -> DataFrame:
    """``doc, tag, start, stop``: word spans whose windows also start in a document with a smaller id.

    ``docs`` is a result of ``keyed``. A document of fewer words than ``window`` has none.
    """
    anchors = materialise(anchor_rows(docs, window, steps), "anchors")
    cores = (
        anchors.groupBy("core")
        .agg(F.min("doc").alias("core_doc"), F.max("doc").alias("last"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
        .filter("core_doc < last")
        .select("core", "core_doc", (F.col("w0") == F.col("w1")).alias("alike"))
    )
    # Written first: a join that reads two tables is dealt anew, and a core with very many rows can be split.
    shared = materialise(anchors.join(materialise(cores, "cores"), "core"), "shared")
    stretch = [F.col("at").alias("start"), (F.col("at") + F.col("n") + (window - 1)).alias("stop")]
    alike = shared.filter("alike AND doc > core_doc").select("doc", "tag", *stretch)
    mixed = shared.filter("NOT alike")
    keepers = mixed.groupBy("core", "whole").agg(F.min("doc").alias("keeper"))
    mixed = mixed.join(materialise(keepers, "keepers"), ["core", "whole"])
    later = mixed.filter("doc > keeper").select("doc", "tag", *stretch)
    open_ = (
        mixed.filter("doc = keeper")
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("at", "n")).alias("listed"))
    )
    windows = materialise(window_rows(docs.join(open_, ["doc", "tag"]), window), "windows")
    owners = windows.groupBy("key").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    single = (
        windows.join(materialise(owners.drop("last"), "owners"), "key")
        .filter("doc > owner")
        .select("doc", "tag", F.col("at").alias("start"), (F.col("at") + window).alias("stop"))
    )
    return alike.unionByName(later).unionByName(single)


def with_spans(docs: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` (with ``doc`` and ``tag``) and the lists of the rows' spans."""
    lists = spans.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return docs.join(lists.hint("shuffle_hash"), ["doc", "tag"], "left").select(*columns, "starts", "stops")


def stays(batch: pa.RecordBatch, text: int):
    """(row, text's bytes, word starts, word ends, mask of the words that stay) of each row of a batch."""
    starts, stops = batch.column("starts").to_pylist(), batch.column("stops").to_pylist()
    for base, data, offsets in chunks(batch.column(text)):
        words, body = cut_words(data, offsets), data.tobytes()
        for r in range(len(offsets) - 1):
            lo, hi = words.first[r], words.first[r + 1]
            stay = np.ones(hi - lo, bool)
            if starts[base + r]:
                stay = ~covered(np.array(starts[base + r]), np.array(stops[base + r]), hi - lo)
            cut = slice(int(offsets[r]), int(offsets[r + 1]))
            yield base + r, body[cut], words.starts[lo:hi] - cut.start, words.ends[lo:hi] - cut.start, stay


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, steps=STEPS) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept`` for every row, ``kept`` being the words that
    stay joined by one space. Windows are judged on the input. Null and empty texts have no
    words and stay as empty texts. Rows that repeat an id are the same document: they lose
    nothing to each other. Rows with a null id come last and lose nothing to each other either.
    Other columns of ``docs`` are not read.
    """
    base = keyed(docs, doc_id, text)
    rows = with_spans(base, repeated_spans(base, window, steps), "doc", "text")

    def task(batches):
        for batch in batches:
            out = []
            for _, body, begin, end, stay in stays(batch, 1):
                kept = b" ".join([body[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist())])
                out.append((len(stay), int((~stay).sum()), kept))
            n, gone, kept = zip(*out) if out else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "kept"])

    out = rows.mapInArrow(task, "doc long, n_words long, n_removed long, kept string")
    return out.select(public_id(), "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, steps=STEPS) -> DataFrame:
    """The rows of ``docs`` with the same words cut out of ``text`` as by ``dedup_substrings``.

    What stays keeps its white space; where words were cut, one space joins the parts.
    A text that loses nothing is unchanged, null included; one that loses all is empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("row"), id_key(doc_id).alias("doc"), F.hash(F.col(text).cast("string")).alias("tag"))
    spans = repeated_spans(keyed(docs, doc_id, text), window, steps)
    rows = with_spans(whole, spans, F.col(f"row.`{text}`").cast("string").alias("text"), "row")
    kind = rows.select("row").schema

    def task(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for r, body, begin, end, stay in stays(batch, 0):
                if not stay.all():
                    texts[r] = cut_out(body, begin, end, stay).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = rows.mapInArrow(task, kind.add("text", "string"))
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def cut_out(body: bytes, begin: np.ndarray, end: np.ndarray, stay: np.ndarray) -> bytes:
    """The text without the other words: runs of words that stay, with their white space, joined by a space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], stay.view(np.int8), [0]])))
    return b" ".join([body[begin[a] : end[b - 1]] for a, b in zip(edge[::2], edge[1::2])])
