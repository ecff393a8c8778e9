"""Benchmark decontamination by spaced-seed hashing.

Tokens are words without ASCII punctuation, A-Z lower-cased. A text leaks an item if some stretch
of at least ``ENOUGH`` tokens, laid along the item, has ``ALIKE`` of them equal; an item of fewer tokens
has to be in the text over its whole length, as much alike.

A mask takes some tokens of a stretch and ignores the others, so a hit survives substitutions
at ignored places. The masks' hashes at every position of every text meet those of the benchmark,
and around each hit, text and item are compared token by token along the hit's diagonal. Masks were
chosen by exhaustive count: whatever substitutions the rule allows, one of them hits. For items of fewer tokens
than ``ENOUGH`` this was counted over their whole length; for all others over lengths 13 to 25, which is enough,
since a longer stretch is cut into parts of such lengths, one of which is as much alike.

The benchmark is read in blocks of bounded size, each sent to all tasks. With more than one block,
a filter of bounded size over the seeds of all picks the texts that can have a hit in one pass over
the texts, and only those meet the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.text import SPACE, chunks, cut_words, hash_spans, keyed, lower_ascii, mix
from phonolake.session import materialise

#: A stretch of so many tokens is a leak; an item of fewer tokens has to match over all of them.
ENOUGH = 13
ALIKE = 0.8
# Masks by the number of tokens of an item; those of ENOUGH hold for all longer ones.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("111111", "1111101", "1111011", "1110111", "1101111", "1011111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111111", "11111011", "11101111", "11011111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11110111", "1100101111", "11011001011", "1111111", "11111101"),
    ENOUGH: ("1111011", "1110100011", "11000011011", "1110111"),
}
#: Bytes of benchmark text in a block, on average.
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22
#: Bits of the filter over all blocks, as a power of two.
ALL_BITS = 26
#: Seeds and tokens compared at once.
SLICE = 1 << 20

PLAIN = np.ones(256, bool)
PLAIN[:128] = [chr(i).isalnum() or bool(SPACE[i]) for i in range(128)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and, per row, the number of its first token."""
    keep = PLAIN[data]
    before = np.append(0, np.cumsum(keep))
    data, offsets = lower_ascii(data[keep]), before[offsets]
    words = cut_words(data, offsets)
    return hash_spans(data, words.starts, words.ends), words.first


def seed_hashes(names: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position with room for it."""
    n = len(names) - len(mask) + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k, take in enumerate(mask):
        if take == "1" and n > 0:
            h = (h + names[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
    return mix(h + np.uint64(int(mask, 2)) * np.uint64(len(mask)))


def masks_of(size: int) -> tuple[str, ...]:
    """The masks for an item of so many tokens."""
    return MASKS.get(min(size, ENOUGH), ())


def needed(size: int) -> int:
    """Equal tokens that make a stretch of ``size`` alike."""
    return -int(-size * 4 // 5)


def item_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of items, and where each begins."""
    names, first = [np.zeros(0, np.uint64)], [0]
    for _, data, offsets in chunks(pa.array(texts, pa.string())):
        part, cut = tokens(data, offsets)
        names.append(part)
        first.extend((cut[1:] + first[-1]).tolist())
    return np.concatenate(names), np.array(first, np.int64)


def item_seeds(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(hash, item, position) of every seed of the items, and the masks in use."""
    key, item, at, masks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
    for k, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        for mask in masks_of(int(hi - lo)):
            h = seed_hashes(names[lo:hi], mask)
            key.append(h)
            item.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
            masks.add(mask)
    return np.concatenate(key), np.concatenate(item), np.concatenate(at), sorted(masks)


def build_block(items: list[tuple[int | None, str | None]]) -> dict:
    """The items' tokens, and their seeds as runs of one hash and one item, sorted by hash. Plain arrays only."""
    names, first = item_tokens([t for _, t in items])
    key, item, at, masks = item_seeds(names, first)
    order = np.lexsort((at, item, key))
    key, item, at = key[order], item[order], at[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))[: len(key)]
    run = np.flatnonzero(fresh)
    run_key = key[run]
    lead = np.flatnonzero(np.append(True, run_key[1:] != run_key[:-1])[: len(run)])
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(run_key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return {
        "ids": [i for i, _ in items],
        "names": names,
        "first": first,
        "masks": masks,
        "filter": seen,
        "key": run_key[lead],
        "runs": np.append(lead, len(run)),
        "item": item[run],
        "from": np.append(run, len(key)),
        "at": at,
    }


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``: so many of each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Ranges of about ``limit`` in sum; a larger one stands alone."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield slice(lo, hi)
        lo = hi


def seeds_met(block: dict, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the texts, number of the hash) of all seeds of the texts that the block has."""
    where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(block["key"]):
        return where[0], which[0]
    for mask in block["masks"]:
        h = seed_hashes(names, mask)
        at = np.flatnonzero(block["filter"][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[at + len(mask) <= first[np.searchsorted(first, at, "right")]]
        found = np.minimum(np.searchsorted(block["key"], h[at]), len(block["key"]) - 1)
        same = block["key"][found] == h[at]
        where.append(at[same])
        which.append(found[same])
    return np.concatenate(where), np.concatenate(which)


def diagonals(block: dict, names: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, diagonal) to compare; a diagonal is the text position less the item position.

    Where a text and an item share so many equal seeds that listing the pairs would be more than
    listing all diagonals, all are given: there are no more than the tokens of both.
    """
    where, which = seeds_met(block, names, first)
    n_items = len(block["ids"])
    for part in slices(block["runs"][which + 1] - block["runs"][which], SLICE):
        lo, n = block["runs"][which[part]], block["runs"][which[part] + 1] - block["runs"][which[part]]
        run, at = ragged(lo, n), np.repeat(where[part], n)
        row, item = np.searchsorted(first, at, "right") - 1, block["item"][run]
        pairs = block["from"][run + 1] - block["from"][run]
        code, place = np.unique(row * n_items + item, return_inverse=True)
        size = (np.diff(first)[code // n_items] + np.diff(block["first"])[code % n_items]).astype(np.int64)
        many = np.bincount(place, pairs, len(code)) > 4 * size
        few = ~many[place]
        for some in slices(pairs[few], SLICE):
            run_, at_, row_, item_, n_ = (x[few][some] for x in (run, at, row, item, pairs))
            d = np.repeat(at_ - first[row_], n_) - block["at"][ragged(block["from"][run_], n_)]
            listed = np.unique(np.stack([np.repeat(row_, n_), np.repeat(item_, n_), d]), axis=1)
            yield listed[0], listed[1], listed[2]
        for some in slices(size[many], SLICE):
            row_, item_ = code[many][some] // n_items, code[many][some] % n_items
            n_ = size[many][some] - 1
            yield np.repeat(row_, n_), np.repeat(item_, n_), ragged(1 - np.diff(block["first"])[item_], n_)


def longest_alike(same: np.ndarray) -> tuple[int, int, int] | None:
    """(first, tokens, equal tokens) of the longest stretch that is alike and long enough.

    With 1 for an equal token and -4 for another, a stretch is alike if its sum is not negative. Of
    equally long ones the more alike counts, then the first.
    """
    total = np.append(0, np.cumsum(np.where(same, 1, -4)))
    highest = np.maximum.accumulate(total[::-1])
    stop = len(same) - np.searchsorted(highest, total)
    size = stop - np.arange(len(total))
    best = int(size.max())
    if best < ENOUGH:
        return None
    starts = np.flatnonzero(size == best)
    equal = (total[stop[starts]] - total[starts] + 4 * best) // 5
    k = int(np.argmax(equal))
    return int(starts[k]), best, int(equal[k])


def compare(block: dict, names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (row, item, start, tokens, equal tokens): for each text and item the longest leak."""
    leaks = [np.zeros((0, 5), np.int64)]
    for row, item, d in diagonals(block, names, first):
        own = np.diff(block["first"])[item]
        lo, hi = np.maximum(0, -d), np.minimum(own, np.diff(first)[row] - d)
        keep = hi - lo >= np.minimum(own, ENOUGH)
        row, item, d, own, lo, size = (x[keep] for x in (row, item, d, own, lo, hi - lo))
        for part in slices(size, 4 * SLICE):
            n = size[part]
            text = ragged(first[row[part]] + d[part] + lo[part], n)
            same = names[text] == block["names"][ragged(block["first"][item[part]] + lo[part], n)]
            cut = np.cumsum(n) - n
            equal = np.add.reduceat(same, cut, dtype=np.int64)
            whole = (own[part] < ENOUGH) | (equal == n)
            good = whole & (5 * equal >= 4 * n)
            found = [x[part][good] for x in (row, item, d + lo, size)]
            leaks.append(np.stack([*found, equal[good]], axis=1))
            for k in np.flatnonzero(~whole & (equal >= needed(ENOUGH))).tolist():
                best = longest_alike(same[cut[k] : cut[k] + n[k]])
                if best:
                    at = part.start + k
                    leaks.append(np.array([[row[at], item[at], d[at] + lo[at] + best[0], best[1], best[2]]]))
    found = np.concatenate(leaks)
    found = found[np.lexsort((found[:, 2], -found[:, 4], -found[:, 3], found[:, 1], found[:, 0]))]
    lead = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]
    return found[lead]


def leaks_of_block(docs: DataFrame, block: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def task(batches):
        block = shared.value
        for batch in batches:
            for base, data, offsets in chunks(batch.column(2)):
                found = compare(block, *tokens(data, offsets))
                where = pa.array(found[:, 0] + base)
                ids = pa.array([block["ids"][i] for i in found[:, 1].tolist()], pa.int64())
                rest = [pa.array(found[:, i]) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), ids, *rest], LEAK)

    return docs.mapInArrow(task, "doc long, tag int, item_id long, start long, n_tokens long, n_matched long")


LEAK = ["doc", "tag", "item_id", "start", "n_tokens", "n_matched"]


def with_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The texts that share a seed with the benchmark, written; a few others can be among them.

    The benchmark's seeds set bits of one filter of fixed size, which is all that comes to the driver.
    """
    shift, masks = np.uint64(64 - ALL_BITS), sorted({m for group in MASKS.values() for m in group})

    def bits(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column(1)):
                key, _, _, used = item_seeds(*tokens(data, offsets))
                at = (key >> shift).astype(np.int64)
                word, place = np.unique(at >> 6, return_inverse=True)
                value = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(value, place, np.uint64(1) << (at & 63).astype(np.uint64))
                use = sum(1 << masks.index(m) for m in used)
                columns = [pa.array(np.append(word, -1)), pa.array(np.append(value.view(np.int64), use))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "bits"])

    rows = items.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, value = rows.column("word").to_numpy(), rows.column("bits").to_numpy()
    filled = np.zeros(1 << (ALL_BITS - 6), np.uint64)
    filled[word[word >= 0]] = value[word >= 0].view(np.uint64)
    use = int(value[word < 0][0]) if (word < 0).any() else 0
    shared = texts.sparkSession.sparkContext.broadcast((filled, [m for k, m in enumerate(masks) if use >> k & 1]))

    def hit(batches):
        filled, used = shared.value
        for batch in batches:
            some = np.zeros(batch.num_rows, bool)
            for base, data, offsets in chunks(batch.column(2)):
                names, first = tokens(data, offsets)
                for mask in used:
                    at = (seed_hashes(names, mask) >> shift).astype(np.int64)
                    met = np.flatnonzero(filled[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                    some[base + np.searchsorted(first, met, "right") - 1] = True
            yield batch.filter(pa.array(some))

    return materialise(texts.mapInArrow(hit, texts.schema), "texts-with-hits")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Stretches of the benchmark in the texts: the longest alike one for every text and item.

    Returns ``doc, tag`` (see ``keyed``), ``item_id, start, n_tokens, n_matched``; positions count tokens.
    Of equally long stretches the more alike counts, then the first. Texts without a leak have no row. Null and
    empty texts and items match nothing; items of fewer than 5 tokens have to be in the text as they are.
    Long texts are compared whole, also repetitive ones: no text and item have more diagonals than tokens.
    Items that share an id are searched one by one and reported under it; a null item id stays null. An empty
    table on either side gives no rows. Other columns are not read.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES) or 1
    texts, found = keyed(docs, doc_id, text), None
    if blocks > 1:
        texts = with_hits(texts, items)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b).collect()
        part = leaks_of_block(texts, build_block([(r.id, r.t) for r in rows]))
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_tokens", "n_matched", (-F.col("start")).alias("s"))).alias("best")
    out = materialise(found, "leaks").groupBy("doc", "tag", "item_id").agg(best)
    return out.select(
        "doc",
        "tag",
        "item_id",
        (-F.col("best.s")).alias("start"),
        F.col("best.n_tokens").alias("n_tokens"),
        F.col("best.n_matched").alias("n_matched"),
    )
