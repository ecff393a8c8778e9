"""Quality rules by suffix-array repetition, one suffix array of words per document.

Suffixes are sorted by prefix doubling, all documents of a chunk at once, with
the ranks of every round kept; the longest common prefixes of neighbours follow
from the ranks. Maximal repeated substrings are the LCP intervals: a word is
inside one of at least L words exactly if a suffix at or before it shares enough
words with a neighbour. The union of their spans and the longest of them are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phonolake.llm.text import chunks, covered, cut_words, hash_spans, keyed, public_id

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Repeats of fewer words count for nothing.
REPEAT_WORDS = 5
#: Most words in hundred that repeats may cover.
MOST_COVERED = 30
#: Longest repeat allowed: so many words, or this share of the text in hundred if that is more.
LONGEST_WORDS = 40
LONGEST_SHARE = 15
BASE_WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def longest_repeats(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the longest match of its text from there with the same text from another word.

    It is the larger of the LCPs with the two neighbours in the text's suffix array.
    """
    n = len(names)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row]
    order = np.lexsort((names, row))
    new = np.append(True, (names[order][1:] != names[order][:-1]) | (row[order][1:] != row[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step = [rank], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        there = tied + step
        after = np.where(there < end[tied], rank[np.minimum(there, n - 1)] + 1, 0)
        put = np.lexsort((after, rank[tied]))
        tied, after = tied[put], after[put]
        old, count = rank[tied], np.arange(len(tied))
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, after[1:] != after[:-1])
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(part, count, 0)) - np.maximum.accumulate(np.where(group, count, 0))
        ranks.append(rank)
        step *= 2
        last = np.append(part[1:], True)
        tied = np.sort(tied[~(part & last)])
    order = np.argsort(rank)
    here, there = order[:-1], order[1:]
    pair = np.flatnonzero(row[here] == row[there])
    a, b, length = here[pair].copy(), there[pair].copy(), np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < end[here[pair]]) & (b < end[there[pair]])
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        same &= (a + (1 << level) <= end[here[pair]]) & (b + (1 << level) <= end[there[pair]])
        jump = np.where(same, 1 << level, 0)
        a, b, length = a + jump, b + jump, length + jump
    best = np.zeros(n, np.int64)
    np.maximum.at(best, here[pair], length)
    np.maximum.at(best, there[pair], length)
    return best


def words_inside(best: np.ndarray, least: int, first: np.ndarray) -> np.ndarray:
    """Per text, the words inside repeats of at least so many words."""
    start = np.flatnonzero(best >= least)
    inside = covered(start, start + best[start], len(best))
    return np.diff(np.append(0, np.cumsum(inside))[first])


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask))[offsets])


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words_before: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    newline = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], newline + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[ends - 1] == 10))
    some = words_before[ends] > words_before[starts]
    starts, ends = starts[some], ends[some]
    row = np.searchsorted(offsets, starts, "right") - 1
    line = hash_spans(data, starts, ends)
    order = np.lexsort((line, row))
    again = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=len(offsets) - 1)


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The columns of COUNTS for each text of a chunk."""
    words = cut_words(data, offsets)
    n_words = np.diff(words.first)
    in_word = covered(words.starts, words.ends, len(data))
    chars = per_row(in_word & ((data & 0xC0) != 0x80), offsets)
    begins = np.zeros(len(data) + 1, np.int64)
    begins[words.starts + 1] = 1
    dup = repeated_lines(data, offsets, np.cumsum(begins)) if len(data) else np.zeros(len(n_words), np.int64)
    if len(words):
        best = longest_repeats(hash_spans(data, words.starts, words.ends), words.first)
    else:
        best = np.zeros(0, np.int64)
    longest = np.zeros(len(n_words), np.int64)
    some = np.flatnonzero(n_words)
    if len(some):
        longest[some] = np.maximum.reduceat(best, words.first[some])
    repeats, inside = words_inside(best, BASE_WINDOW, words.first), words_inside(best, REPEAT_WORDS, words.first)
    return np.stack([n_words, chars, per_row(SYMBOLS[data], offsets), dup, repeats, inside, longest])


def judge_repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict for every row.

    Returns ``doc_id`` and the columns of COUNTS, ``base_failed`` (under 20 words, or over 30 % of them in
    8-word windows that occur twice) and ``kept``: false if base_failed, if repeats of REPEAT_WORDS words or
    more cover over MOST_COVERED % of the words, or if the longest is over the limit. Null and empty texts
    count zero everywhere and fail. Rows of a repeated or null id are judged one by one. Other columns are not read.
    """

    def task(batches):
        for batch in batches:
            parts = [measure(data, offsets) for _, data, offsets in chunks(batch.column(2))]
            counts = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts]], ["doc", *COUNTS])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    out = keyed(docs, doc_id, text).mapInArrow(task, f"doc long, {kinds}")
    failed = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    good = (
        f"NOT ({failed}) AND 100 * n_covered <= {MOST_COVERED} * n_words "
        f"AND longest_repeat <= greatest({LONGEST_WORDS}, {LONGEST_SHARE} * n_words div 100)"
    )
    return out.selectExpr("doc", *COUNTS, f"{failed} AS base_failed", f"{good} AS kept").select(
        public_id(), *COUNTS[:5], "base_failed", "kept", *COUNTS[5:]
    )
