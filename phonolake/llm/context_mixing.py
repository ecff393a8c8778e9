"""Scoring texts by online logistic context mixing.

A text is a sequence of tokens. First, bits say whether a token is the one that the
words before it name (``running_contexts``): hashed contexts of one to three words, mixed.
A token that they don't name is likely by its
count in training texts, less a discount; the mass of all discounts goes to spelling tokens
bit by bit, which any token can be. Each of several hashed contexts (the one to
six bytes before, within the token) predicts the next bit from the counts of the training words.
The predictions are combined in the logistic domain with weights chosen by a
gate, how much the two longest contexts have seen. Weights are learned online,
word by word in small steps, each word being predicted without its own count. A
last table, adaptive too, refines the probability by gate and size. Such a token's
probability also adapts to its own text: it is mixed with the share of the token
among those before it. What the contexts named in vain is left out of the whole. Every bit's two probabilities
sum to one and tokens are spelled prefix-free, so scores are
log probabilities of texts; per byte they are bits per byte.

Counts and statistics cover all training texts. Words are counted first, each where
all its counts meet; those with the highest counts are a table of bounded size, that every
task holds. Every other word is scored once and meets its occurrences in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.llm.running_contexts import OTHER, STEP, Running, Slots, learn_running, run_of
from phonolake.llm.text import PRIME, SPACE, Words, chunks, cut_words, hash_spans, keyed, lower_ascii, mix, public_id, row_ranges
from phonolake.llm.toxicity import held_out
from phonolake.session import materialise

#: Frequent words held by every task, at most.
FREQUENT = 1 << 18
#: Bytes of text, and rows, whose words are counted at once.
COUNT_BYTES, COUNT_ROWS = 1 << 20, 1 << 20
#: Bytes of text scored at once.
SCORE_BYTES = 1 << 18
#: Slots of each context's table, as a power of two.
SLOT_BITS = 18
#: Bytes before, of each context.
ORDERS = (1, 2, 3, 4, 6)
CONTEXTS = len(ORDERS)
#: How much of a count a predictor starts with on either side.
START = 0.3
GATES = 16
CURVE = 33
STEP_BYTES = 1 << 14
#: First bytes of a token that are compared with the token before, and words that a task spells at once.
SHARED, SPELL = 32, 1 << 17
END = b"\n"
#: Weight of a text's own past: grows to MOST with the tokens seen, half of it at HALF.
MOST, HALF = 0.25, 60.0


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens, each word closed by a space, and their offsets."""
    spelled = [w if w == END else w + b" " for w in words]
    offsets = np.cumsum([0] + [len(w) for w in spelled])
    return np.frombuffer(b"".join(spelled), np.uint8), offsets


def context_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of every context at every byte; before a token comes one space and nothing else."""
    n = len(data)
    at = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    past, keys = np.zeros(n, np.uint64), []
    for k in range(max(ORDERS)):
        before = np.zeros(n, np.uint64)
        before[k + 1 :] = data[: max(n - k - 1, 0)]
        before[at <= k] = 0
        before[at == k] = 32
        past = past | (before << np.uint64(8 * k))
        if k + 1 in ORDERS:
            keys.append(mix(past * PRIME + np.uint64(k)))
    return np.stack(keys)


def slots(data: np.ndarray, keys: np.ndarray, bit: int) -> np.ndarray:
    """Table slots of the contexts for one bit of every byte (0 is the highest)."""
    node = (np.uint64(1) << np.uint64(bit)) | (data.astype(np.uint64) >> np.uint64(8 - bit))
    return top_bits(keys + node * PRIME).view(np.int64)


def top_bits(x: np.ndarray) -> np.ndarray:
    """The first SLOT_BITS bits of ``mix(x)``, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x >>= np.uint64(64 - SLOT_BITS)
    return x


def bit_of(data: np.ndarray, bit: int) -> np.ndarray:
    return (data >> np.uint8(7 - bit)) & 1


def pieces(words: list[bytes], limit: int = STEP_BYTES):
    """Ranges of words of about so many bytes."""
    lo, size = 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= limit:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(words):
        yield lo, len(words)


def branches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the bytes to look at, the place among them of each byte's own).

    A byte of a token that is the same as in the token before, up to and with that byte, has the same contexts there;
    tokens in order share most. Only the first SHARED bytes are compared.
    """
    size, count = np.diff(offsets), np.arange(len(offsets) - 1)
    own, same = np.arange(len(data)), count > 0
    for k in range(SHARED):
        longer = size > k
        byte = data.take(np.where(longer, offsets[:-1] + k, 0))
        same[1:] &= longer[1:] & longer[:-1] & (byte[1:] == byte[:-1])
        here = np.flatnonzero(same)
        if not len(here):
            break
        first = np.maximum.accumulate(np.where(same, 0, count))
        own[offsets[here] + k] = offsets[first[here]] + k
    fresh = own == np.arange(len(own))
    return np.flatnonzero(fresh), (np.cumsum(fresh) - 1)[own]


def count_bits(words: list[bytes], table: np.ndarray | None = None) -> np.ndarray:
    """Counts of (context, slot, bit value) over distinct words, added to ``table`` in place if there is one."""
    table = np.zeros((CONTEXTS, 1 << SLOT_BITS, 2)) if table is None else table
    words = sorted(words)
    for lo, hi in pieces(words, 1 << 18):
        data, offsets = spell(words[lo:hi])
        look, own = branches(data, offsets)
        keys, data = context_keys(data, offsets)[:, look], data[look]
        times, code = np.tile(np.bincount(own).astype(float), 8), np.empty((8, len(look)), np.int64)
        for k in range(CONTEXTS):
            for at in range(0, len(look), STEP_BYTES):
                part = slice(at, at + STEP_BYTES)
                for bit in range(8):
                    code[bit, part] = 2 * slots(data[part], keys[k, part], bit) + bit_of(data[part], bit)
            table[k] += np.bincount(code.reshape(-1), times, 2 << SLOT_BITS).reshape(-1, 2)
    return table


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def dots(inputs, weights: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums over the inputs, each weighted by its column of ``weights`` in the position's row."""
    total = 0
    for x, column in zip(inputs, weights.T):
        total = total + np.ascontiguousarray(column).take(row) * x
    return total


@dataclass
class Mixer:
    """``weights``: one row per gate and bit; ``curve``: refined stretch at CURVE points per gate."""

    weights: np.ndarray
    curve: np.ndarray

    @staticmethod
    def start() -> Mixer:
        weights = np.tile(np.append(np.full(CONTEXTS, 0.3), 0.0), (GATES * 8, 1))
        return Mixer(weights, np.tile(np.linspace(-8, 8, CURVE), (GATES, 1)))


def gates(n_longest: np.ndarray, n_before: np.ndarray) -> np.ndarray:
    return levels(n_longest) * 4 + levels(n_before)


def levels(n: np.ndarray) -> np.ndarray:
    """0 for none seen, then by 3 and 20."""
    return (n >= 0.5).astype(np.int64) + (n >= 3) + (n >= 20)


def curve_place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (np.clip(x, -7.999, 7.999) + 8) / 16 * (CURVE - 1)
    lo = x.astype(np.int64)
    return lo, x - lo


def learn_online(counts: np.ndarray, words: list[bytes], rate: float = 0.3):
    """One online pass over distinct words: (mixer weights, curve counts of zeros and ones, words)."""
    mixer = Mixer.start()
    weights = mixer.weights.reshape(GATES, 8, CONTEXTS + 1).astype(np.float32)
    seen = np.zeros((2, GATES, CURVE))
    pairs = [np.ascontiguousarray(x, np.float32).reshape(-1, 2).view(np.float64)[:, 0] for x in counts]
    for lo, hi in pieces(words):
        data, offsets = spell(words[lo:hi])
        keys = context_keys(data, offsets)
        inputs = np.full((CONTEXTS + 1, len(data)), 0.3, np.float32)
        for bit in range(8):
            value, where = bit_of(data, bit), slots(data, keys, bit)
            one = value.astype(np.float32)
            total = []
            for k in range(CONTEXTS):
                n = pairs[k].take(where[k]).view(np.float32)
                ones, zeros = np.maximum(n[1::2] - one, 0), np.maximum(n[::2] - (1 - one), 0)
                np.log((ones + START) / (zeros + START), out=inputs[k])
                total.append(ones + zeros)
            gate = gates(total[-1], total[-2])
            dot = dots(inputs, weights[:, bit], gate)
            p = squash(dot)
            place, part = curve_place(dot)
            code = (value.astype(np.int64) * GATES + gate) * CURVE + place
            seen += (np.bincount(code, 1 - part, seen.size) + np.bincount(code + 1, part, seen.size)).reshape(seen.shape)
            step = np.stack([np.bincount(gate, x, GATES) for x in inputs * (one - p)], axis=1)
            weights[:, bit] += rate * step / (np.bincount(gate, minlength=GATES)[:, None] + 20)
    return weights.reshape(GATES * 8, CONTEXTS + 1).astype(float), seen, float(len(words))


@dataclass
class Model:
    """What scoring needs of the counts, and the mixer."""

    guess: np.ndarray
    level: np.ndarray
    mixer: Mixer

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each token."""
        out, order = np.zeros(len(words)), sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        for lo, hi in pieces(words, 1 << 18):
            data, offsets = spell(words[lo:hi])
            look, own = branches(data, offsets)
            keys, data, total = context_keys(data, offsets)[:, look], data[look], np.ones(len(look))
            for at in range(0, len(look), STEP_BYTES):
                part = slice(at, at + STEP_BYTES)
                self.spelled(data[part], keys[:, part], total[part])
            out[order[lo:hi]] = np.add.reduceat(np.log10(total)[own], offsets[:-1])
        return out

    def spelled(self, data: np.ndarray, keys: np.ndarray, total: np.ndarray) -> None:
        """Multiply ``total`` by the probability of each byte in its contexts."""
        curve = self.mixer.curve.reshape(-1)
        for bit in range(8):
            value, where = bit_of(data, bit), slots(data, keys, bit)
            gate = self.level[-1].take(where[-1]).astype(np.int64) * 4 + self.level[-2].take(where[-2])
            inputs = [*[self.guess[k].take(where[k]) for k in range(CONTEXTS)], 0.3]
            dot = dots(inputs, self.mixer.weights, gate * 8 + bit)
            place, part = curve_place(dot)
            place += gate * CURVE
            refined = curve.take(place) * (1 - part) + curve.take(place + 1) * part
            p = (squash(dot) + squash(refined)) / 2
            total *= np.where(value == 1, p, 1 - p)


def assemble(counts: np.ndarray, learned: list) -> Model:
    """The model from the counts and the online passes of all tasks, weighted by what they saw."""
    mixer = Mixer.start()
    if learned:
        share = np.array([x[2] for x in learned])
        if share.sum() > 0:
            mixer.weights = np.tensordot(share / share.sum(), np.stack([x[0] for x in learned]), 1)
        seen = np.sum([x[1] for x in learned], axis=0)
        start = squash(np.linspace(-8, 8, CURVE))
        mixer.curve = stretch((seen[1] + 4 * start) / (seen.sum(axis=0) + 4))
    guess = np.log((counts[..., 1] + START) / (counts[..., 0] + START)).astype(np.float32)
    return Model(guess, levels(counts[-2:].sum(axis=2)).astype(np.uint8), mixer)


def lowered_words(data: np.ndarray, offsets: np.ndarray):
    data = lower_ascii(data)
    words = cut_words(data, offsets)
    return data, words, hash_spans(data, words.starts, words.ends)


def own_weight(t: np.ndarray) -> np.ndarray:
    return MOST * t / (t + HALF)


def own_past(row: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that brings a text's same words together, place among the same words of the text, odds that the text's past gives to the word).

    The last is for each word in order: w / (1 - w) times its share of the tokens before, w being the past's weight.
    """
    code = mix(key + row.astype(np.uint64) * PRIME)
    order, count = np.argsort(code), np.arange(len(code))
    group = np.cumsum(np.append(False, np.diff(code[order]) != 0)[: len(order)])
    order = np.sort((group << 32) | order) & 0xFFFFFFFF
    named, text = key[order], row[order]
    fresh = np.append(True, (named[1:] != named[:-1]) | (text[1:] != text[:-1]))[: len(order)]
    again = count - np.maximum.accumulate(np.where(fresh, count, 0)) if len(order) else count
    t = (order - first[row[order]]).astype(float)
    w = own_weight(t)
    return order, again, np.where(again > 0, w / (1 - w) * again / np.maximum(t, 1), 0.0)


def heads_of(table: np.ndarray) -> np.ndarray:
    """For ``find``: where in the sorted table the hashes of every first few bits begin."""
    bits = len(table).bit_length()
    return np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)


def find(table: np.ndarray, key: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether the key is there).

    Keys are hashes, so their first bits tell the place but for a few steps.
    """
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(heads.take((key >> np.uint64(64 - len(table).bit_length())).astype(np.int64)), len(table) - 1)
    met = table.take(at)
    known, left = met == key, np.flatnonzero(met < key)
    while len(left):
        at[left] = np.minimum(at[left] + 1, len(table) - 1)
        here = table.take(at[left])
        known[left] = here == key[left]
        left = left[(here < key[left]) & (at[left] < len(table) - 1)]
    return at, known


def common_words(learnt: DataFrame, least: int, left: int) -> Column:
    """Whether a word's count ``c`` is above the least one; of those that have just that, ``left`` are taken in order of a hash."""
    mark = F.xxhash64("word")
    ties = learnt.filter((F.col("c") == least) & (F.col("word") != F.lit(END))).select(mark.alias("mark"))
    cut = ties.orderBy("mark").limit(left).agg(F.max("mark")).first()[0]
    more = F.col("c") > least
    return more if cut is None else more | ((F.col("c") == least) & (mark <= cut))


def spellings(body: np.ndarray, words: Words) -> pa.Array:
    """The words, in order, as one column."""
    ends = np.append(0, np.cumsum(words.ends - words.starts))
    solid = body[~SPACE[body]].tobytes()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(solid)])


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c``: occurrences in training texts of every word of the texts and of the end, counted in all of them."""

    def task(batches):
        parts, rows, ends = [], 0, 0
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            ends += int(learn.sum())
            for base, data, offsets in chunks(batch.column(0), COUNT_BYTES):
                body = lower_ascii(data)
                words = cut_words(body, offsets)
                met = spellings(body, words).dictionary_encode()
                n = np.bincount(met.indices.to_numpy(), learn[base + words.rows()], len(met.dictionary)).astype(np.int64)
                parts.append(pa.table([met.dictionary, pa.array(n)], ["word", "n"]))
                rows += len(n)
                if rows > COUNT_ROWS:
                    parts = [added(parts)]
                    rows = len(parts[0])
                    if rows > COUNT_ROWS // 2:
                        yield from out(parts[0])
                        parts, rows = [], 0
        parts.append(pa.table([pa.array([END], pa.large_binary()), pa.array([ends], pa.int64())], ["word", "n"]))
        yield from out(added(parts))
        del parts
        pa.default_memory_pool().release_unused()

    def added(parts):
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def out(table):
        return table.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches(1 << 16)

    rows = texts.select("text", "learn").mapInArrow(task, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def least_count(kinds: np.ndarray, counts: np.ndarray, most: int) -> int:
    """The least count above which there are at most ``most`` words, where ``kinds`` words have each of the distinct ``counts``."""
    order = np.argsort(-counts)
    over = np.flatnonzero(np.cumsum(kinds[order]) > most)
    return int(counts[order][over[0]]) if len(over) else 0


def gathered(batches, rows: int = SPELL):
    """Consecutive batches as tables of so many rows or more, the last of what is left."""
    parts, size = [], 0
    for batch in batches:
        parts.append(batch)
        size += len(batch)
        if size >= rows:
            yield pa.Table.from_batches(parts)
            parts, size = [], 0
    if size:
        yield pa.Table.from_batches(parts)


def bit_counts(lexicon: DataFrame) -> np.ndarray:
    """The contexts' tables over all training words: summed per task, then by slot."""

    def task(batches):
        total = np.zeros((CONTEXTS, 1 << SLOT_BITS, 2))
        for table in gathered(batches):
            count_bits(table.column(0).to_pylist(), total)
        flat = total.reshape(-1)
        some = np.flatnonzero(flat)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part])], ["slot", "n"])

    rows = lexicon.mapInArrow(task, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CONTEXTS * 2 << SLOT_BITS)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return counts.reshape(CONTEXTS, -1, 2)


def learn_everywhere(lexicon: DataFrame, counts: np.ndarray) -> list:
    """The online passes of all tasks over their own words."""
    shared = lexicon.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def task(batches):
        for table in gathered(batches):
            yield learned(table.column(0).to_pylist())

    def learned(words):
        order = np.random.default_rng(len(words)).permutation(len(words))
        weights, seen, n = learn_online(shared.value, [words[i] for i in order])
        x = pa.array([np.concatenate([weights.reshape(-1), seen.reshape(-1)]) * n], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([x, pa.array([n])], ["x", "n"])

    rows = materialise(lexicon.mapInArrow(task, "x array<double>, n double"), "learned")
    size = GATES * 8 * (CONTEXTS + 1) + 2 * GATES * CURVE
    total = rows.agg(F.sum("n")).first()[0]
    if not total:
        return []
    sums = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(size)
    flat[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    cut = GATES * 8 * (CONTEXTS + 1)
    return [(flat[:cut].reshape(GATES * 8, -1) / total, flat[cut:].reshape(2, GATES, CURVE) / total, total)]


@dataclass
class Counts:
    """Training occurrences, distinct tokens, those seen once and twice."""

    total: int
    kinds: int
    once: int
    twice: int

    @staticmethod
    def of(counts: np.ndarray, kinds: np.ndarray) -> Counts:
        """From the distinct counts and how many tokens have each."""
        return Counts(int(counts @ kinds), int(kinds.sum()), int(kinds[counts == 1].sum()), int(kinds[counts == 2].sum()))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.kinds + 1))

    def token(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log10 probability of tokens seen ``c`` times, from that of their spelling."""
        if not self.total:
            return spelled
        off = (self.once + 0.5) / (self.once + 2 * self.twice + 1)
        share = off * self.kinds / self.total
        known = np.log10(np.maximum(c - off, 0) / self.total + share * 10.0 ** np.maximum(spelled, -300.0))
        return np.where(c > 0, known, np.log10(share) + spelled)


def text_scores(texts: DataFrame, shared, end: np.ndarray) -> DataFrame:
    """Per text: tokens, and the sums over its frequent words and its end, with the bits that the words before all its tokens predict.

    Rows with a ``word`` are the text's other words: how often each is there (``tf``), and the odds that the text's past
    gives to all but the first (``odds``). ``shared`` has the sorted hashes of the frequent words, what an occurrence of
    each adds to known, base and score, and the arrays of ``Running``.
    """

    def task(batches):
        table, gain, cells, *learned = shared.value
        running, heads = Running(Slots(cells), *learned), heads_of(table)
        for batch in batches:
            for base, data, offsets in chunks(batch.column(2), SCORE_BYTES):
                body, words, key = lowered_words(data, offsets)
                row, n = words.rows(), len(offsets) - 1
                order, again, odds = own_past(row, key, words.first)
                at, known = find(table, key, heads)
                token, keys, place = run_of(words, key, np.where(known, at, OTHER), len(table))
                cost, hit, vain = running.code(token, keys)
                size = np.diff(words.first) + 1
                own = own_weight((np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)).astype(float))
                cost += np.where(hit, 0.0, np.log10(1 - own) - np.log10(1 - np.minimum((1 - own) * vain, 0.999)))
                ends = hit[np.cumsum(size) - 1]
                sums = [np.zeros(n) + e for e in end]
                sums[2] += np.bincount(np.repeat(np.arange(n), size), cost, n) - np.where(ends, end[2], 0.0)
                here, part = known[order], order[known[order]]
                if len(part):
                    worth = gain.take(at[part], axis=1)
                    worth[2] = np.where(hit[place[part]], 0.0, np.log10(10.0 ** worth[2] + odds[here]))
                    sums = [x + np.bincount(row[part], w, n) for x, w in zip(sums, worth)]
                columns = [*[c.slice(base, n) for c in (*batch.columns[:2], batch.column(3))], pa.array(size)]
                columns += [*[pa.array(x) for x in sums], *[pa.nulls(n, t) for t in KINDS[-3:]]]
                yield pa.RecordBatch.from_arrays(columns, NAMES)
                here = ~here
                order, again, odds = order[here], again[here], odds[here]
                fresh = np.flatnonzero(again == 0)
                tf, first = np.diff(np.append(fresh, len(order))), order[fresh]
                word = spellings(body, words).take(pa.array(first)).cast(pa.binary())
                where = pa.array(row[first] + base)
                repeats = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf - 1)), pa.int32()), pa.array(odds[again > 0]))
                columns = [batch.column(0).take(where), batch.column(1).take(where), *[pa.nulls(len(tf), t) for t in KINDS[2:-3]]]
                yield pa.RecordBatch.from_arrays([*columns, word, pa.array(tf), repeats], NAMES)

    kinds = ", ".join(f"{c} double" for c in SUMS)
    return texts.mapInArrow(task, f"doc long, tag int, learn boolean, n_tokens long, {kinds}, word binary, tf long, odds array<double>")


SUMS = ["known", "base", "score"]
NAMES = ["doc", "tag", "learn", "n_tokens", *SUMS, "word", "tf", "odds"]
KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), *[pa.float64()] * 3, pa.binary(), pa.int64(), pa.list_(pa.float64())]


def runs_of(shared):
    """Numbers and contexts of the tokens of a column of texts, for ``learn_running``.

    A chunk comes in runs of whole learning steps and a rest, so that only some of its texts are taken apart at a time.
    """

    def runs(column):
        table = shared.value
        heads = heads_of(table)

        def run(data, offsets):
            _, words, key = lowered_words(data, offsets)
            at, known = find(table, key, heads)
            return run_of(words, key, np.where(known, at, OTHER), len(table))[:2]

        for _, data, offsets in chunks(column):
            left = None
            for _, *part in row_ranges(data, offsets, SCORE_BYTES):
                new = run(*part)
                left = new if left is None else [np.concatenate(x, axis=-1) for x in zip(left, new)]
                whole = len(left[0]) // STEP * STEP
                if whole:
                    yield tuple(x[..., :whole] for x in left)
                    left = [x[..., whole:] for x in left]
            if len(left[0]):
                yield tuple(left)

    return runs


def score_words(lexicon: DataFrame, model: Model, seen: Counts) -> DataFrame:
    """``word, c, common, base, score``: log10 probabilities of every distinct word, each spelled once."""
    mixer = model.mixer
    shared = lexicon.sparkSession.sparkContext.broadcast((model.guess, model.level, mixer.weights, mixer.curve))
    sums = (seen.total, seen.kinds, seen.once, seen.twice)

    def task(batches):
        guess, level, weights, curve = shared.value
        model, counts = Model(guess, level, Mixer(weights, curve)), Counts(*sums)
        for table in gathered(batches):
            c = table.column(1).to_numpy()
            score = counts.token(c, model.log10(table.column(0).to_pylist()))
            made = table.append_column("base", pa.array(counts.base(c))).append_column("score", pa.array(score))
            yield from made.to_batches()

    schema = "word binary, c long, common boolean, base double, score double"
    return materialise(lexicon.mapInArrow(task, schema), "word-scores")


def rare_scores(rare: DataFrame, words: DataFrame) -> DataFrame:
    """Per text: the sums over its rare words; adaptive execution splits the occurrences of a hot word."""
    joined = rare.join(words.filter("NOT common"), "word")
    mass = F.pow(F.lit(10.0), F.col("score"))
    own = F.aggregate("odds", F.col("score"), lambda total, x: total + F.log10(mass + x))
    known = F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))
    parts = {"known": known, "base": F.col("tf") * F.col("base"), "score": own}
    rows = joined.select("doc", "tag", *[x.cast("double").alias(c) for c, x in parts.items()])
    return rows.groupBy("doc", "tag").agg(*[F.sum(c).alias(f"rare_{c}") for c in SUMS])


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Score every text; learn from those outside the held-out fold.

    Tokens are words with A-Z lower-cased, then one end. Returns ``doc, tag`` (see ``keyed``), ``held_out,
    n_tokens, n_known, train_tokens``, ``base_score`` (unigrams with one added to every count) and ``score``,
    both log10 probabilities. Null and empty texts are an end alone. A null id is not held out. Rows of a
    repeated id are scored, and learned from, one by one. With nothing to learn from, tokens are spelled
    with even bits. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = keyed(docs, doc_id, text).withColumn("learn", ~held_out(public_id(), folds, fold))
    lexicon = materialise(count_words(texts), "lexicon")
    learnt = lexicon.filter("c > 0")
    every = learnt.groupBy("c").agg(F.count("*").alias("kinds")).toArrow()
    seen = Counts.of(every.column("c").to_numpy(), every.column("kinds").to_numpy())
    least = least_count(every.column("kinds").to_numpy(), every.column("c").to_numpy(), FREQUENT)
    left = FREQUENT - int(every.column("kinds").to_numpy()[every.column("c").to_numpy() > least].sum())
    common = (common_words(learnt, least, left) | (F.col("word") == F.lit(END))).alias("common")
    counts = bit_counts(learnt)
    scored = score_words(lexicon.select("word", "c", common), assemble(counts, learn_everywhere(learnt, counts)), seen)
    few = scored.filter("common").select("word", "c", "base", "score").toArrow()
    words, c = few.column("word").to_pylist(), few.column("c").to_numpy().astype(float)
    worth = np.stack([(c > 0).astype(float), few.column("base").to_numpy(), few.column("score").to_numpy()])
    body = sorted((hash_of(w), k) for k, w in enumerate(words) if w != END)
    table = (np.array([h for h, _ in body], np.uint64), worth[:, np.array([k for _, k in body], np.int64)])
    end = worth[:, words.index(END)] if END in words else np.zeros(3)
    alone = stretch(np.clip(10.0 ** np.append(table[1][2], end[2]), 1e-12, 1 - 1e-12))
    model = learn_running(texts.filter("learn"), runs_of(spark.sparkContext.broadcast(table[0])), alone, seen.total)
    parts = (model.slots.cells, model.weights, model.curve, alone)
    met = materialise(text_scores(texts, spark.sparkContext.broadcast((*table, *parts)), end), "texts")
    known = met.filter("word IS NULL").select("doc", "tag", "learn", "n_tokens", *SUMS)
    rare = rare_scores(met.filter("word IS NOT NULL").select("word", "doc", "tag", "tf", "odds"), scored)
    same = known.groupBy("doc", "tag").agg(F.count("*").alias("rows"))
    rare = materialise(rare.join(same, ["doc", "tag"]), "rare")
    out = known.join(rare, ["doc", "tag"], "left")
    full = {c: F.col(c) + F.coalesce(F.col(f"rare_{c}") / F.col("rows"), F.lit(0.0)) for c in SUMS}
    return out.select(
        "doc",
        "tag",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        F.round(full["known"]).cast("long").alias("n_known"),
        F.lit(seen.total).cast("long").alias("train_tokens"),
        full["base"].alias("base_score"),
        full["score"].alias("score"),
    )


def hash_of(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])
