"""Mixing over running text: the one, two and three words before a token predict it.

A token is coded by yes-or-no bits. The context of three words names the token
that most often came after it, and the first bit says whether that is the token;
if not, the contexts of two words and of one name theirs, each token named once.
Whatever no context names goes on to be coded without the words before. A bit is
predicted by every context that knows something: how often the named token came
and how often another did, or that this context names another; the token's own
frequency predicts too. Predictions are combined in the logistic domain, with
weights chosen by a gate (the naming context, its two counts, whether another
agrees) and learned online, and a table refines the result by gate and size.

Contexts are hashed slots with check bits. A task goes through its training texts
once, each step predicted from what came before it, and keeps in a slot the
context that came most and its commonest token; the slots of all tasks are joined
by the same rule, task by task in a fixed order. Slots grow with the tokens
counted, up to the memory bound of MOST_BITS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from phonolake.llm.text import PRIME, Words, mix

#: Words before, of each context.
DEPTH = 3
#: Slots of each context's table, as a power of two: one per token, from least to most.
LEAST_BITS, MOST_BITS = 12, 20
#: A slot's unit: check bits over the token's number.
TOKEN_BITS = 20
TOKENS, CHECK = (1 << TOKEN_BITS) - 1, (1 << 12) - 1
#: The number of all tokens that contexts can't name.
OTHER = TOKENS
#: Greatest count in a slot, and the logarithms of all counts with START added.
MOST = (1 << 16) - 1
START = 0.3
LOGS = np.log(np.arange(MOST + 1) + START).astype(np.float32)
#: Slots a row of the exchange between tasks.
BLOCK = 1 << 11
INPUTS = DEPTH + 2
GATES = DEPTH * 4 * 3 * 2
CURVE = 33
STEP, BATCH = 1 << 15, 1 << 12
RATE = 0.3
#: Input partitions a learning task goes through.
SPLITS = 4


def slot_bits(tokens: int) -> int:
    return int(np.clip(int(tokens).bit_length(), LEAST_BITS, MOST_BITS))


def run_of(words: Words, key: np.ndarray, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens' numbers with an ``end`` closing each text, hashes of the contexts of each, place of each word among them)."""
    texts = len(words.first) - 1
    size = np.diff(words.first) + 1
    place = np.arange(len(words)) + words.rows()
    n = len(words) + texts
    token, name = np.full(n, end, np.int64), np.zeros(n, np.uint64)
    token[place], name[place] = number, key
    inside = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    past, keys = np.zeros(n, np.uint64), np.zeros((DEPTH, n), np.uint64)
    for k in range(DEPTH):
        before = np.zeros(n, np.uint64)
        before[k + 1 :] = name[: max(n - k - 1, 0)]
        before[inside <= k] = 0
        past = keys[k] = mix(past * PRIME + before + np.uint64(k + 1))
    return token, keys, place


def starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def tally(key: np.ndarray, token: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """``slot, unit, hits, total``: of each slot the context that came most (then the highest check), with its commonest token."""
    check = (key & np.uint64(CHECK)).astype(np.int64)
    code = np.sort(((key >> np.uint64(64 - bits)).astype(np.int64) << 32) | (check << TOKEN_BITS) | token)
    if not len(code):
        return (code,) * 4
    first = starts(code)
    n, code = np.diff(np.append(first, len(code))), code[first]
    name = code & TOKENS
    first = starts(code >> TOKEN_BITS)
    best = np.maximum.reduceat((np.where(name == OTHER, 0, n) << TOKEN_BITS) | (TOKENS - name), first)
    total, group = np.add.reduceat(n, first), code[first] >> TOKEN_BITS
    some = best >> TOKEN_BITS > 0
    best, total, group = best[some], total[some], group[some]
    if not len(best):
        return (best,) * 4
    first = starts(group >> 12)
    at = np.maximum.reduceat((total << 32) | np.arange(len(total)), first) & 0xFFFFFFFF
    unit = ((group[at] & CHECK) << TOKEN_BITS) | (TOKENS - (best[at] & TOKENS))
    return group[at] >> 12, unit, best[at] >> TOKEN_BITS, total[at]


def cells_of(unit: np.ndarray, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Slots as 64 bits: unit, hits, total; counts beyond 16 bits are scaled down together."""
    big = np.flatnonzero(total > MOST)
    if len(big):
        hits, total = hits.copy(), total.copy()
        hits[big] = np.maximum(hits[big] * MOST // total[big], 1)
        total[big] = MOST
    return (unit.astype(np.uint64) << np.uint64(32)) | ((hits << 16) | total).astype(np.uint64)


def parts_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (cells >> np.uint64(32)).astype(np.int64), low >> 16, low & MOST


def join(cells: np.ndarray, unit: np.ndarray, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Slots with more counts: those of the same context add up, of two contexts the one that came most stays."""
    was, had, saw = parts_of(cells)
    known = (was >> TOKEN_BITS == unit >> TOKEN_BITS) & (saw > 0)
    same = known & (was == unit)
    wins = np.where(known, ~same & (hits > had), total > saw)
    had = np.where(same, had + hits, np.where(wins, hits, had))
    return cells_of(np.where(wins, unit, was), had, np.where(known, saw + total, np.where(wins, total, saw)))


@dataclass
class Slots:
    """``cells`` by context and slot."""

    cells: np.ndarray

    @staticmethod
    def empty(bits: int) -> Slots:
        return Slots(np.zeros((DEPTH, 1 << bits), np.uint64))

    @property
    def bits(self) -> int:
        return self.cells.shape[1].bit_length() - 1

    def add(self, keys: np.ndarray, token: np.ndarray) -> None:
        for k in range(DEPTH):
            slot, *counts = tally(keys[k], token, self.bits)
            self.cells[k][slot] = join(self.cells[k].take(slot), *counts)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token named, or -1, its hits, the misses), by context and position."""
        named, hits, misses = (np.empty(keys.shape, np.int64) for _ in range(3))
        for k in range(DEPTH):
            slot = (keys[k] >> np.uint64(64 - self.bits)).astype(np.int64)
            unit, n, total = parts_of(self.cells[k].take(slot))
            knows = (unit >> TOKEN_BITS == (keys[k] & np.uint64(CHECK)).astype(np.int64)) & (n > 0)
            named[k] = np.where(knows, unit & TOKENS, -1)
            hits[k] = n * knows
            misses[k] = (total - n) * knows
        return named, hits, misses


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def curve_place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (np.clip(x, -7.999, 7.999) + 8) / 16 * (CURVE - 1)
    lo = x.astype(np.int64)
    return lo, x - lo


@dataclass
class Bit:
    """One yes-or-no question over the positions ``at``: is it the token ``named``?"""

    at: np.ndarray
    named: np.ndarray
    inputs: np.ndarray
    gate: np.ndarray


def questions(slots: Slots, keys: np.ndarray, token: np.ndarray, alone: np.ndarray):
    """The bits that code the tokens, longest context first; a position drops out once its token is named.

    ``alone`` is the stretched frequency of each token.
    """
    named, hits, misses = slots.look(keys)
    at = np.arange(len(token))
    for k in reversed(range(DEPTH)):
        ask = named[k][at] >= 0
        for j in range(k + 1, DEPTH):
            ask &= named[j][at] != named[k][at]
        here = at[ask]
        want, inputs = named[k][here], np.empty((INPUTS, len(here)), np.float32)
        agrees = np.zeros(len(here), np.int64)
        for j in range(DEPTH):
            other, n, m = named[j][here], hits[j][here], misses[j][here]
            same = other == want
            inputs[j] = np.where(same, LOGS.take(n) - LOGS.take(m), LOGS[0] - LOGS.take(n))
            agrees |= same & (j != k)
        inputs[DEPTH], inputs[DEPTH + 1] = alone[want], START
        n, m = hits[k][here], misses[k][here]
        seen = (n >= 2).astype(np.int64) + (n >= 3) + (n >= 6)
        missed = (m >= 1).astype(np.int64) + (m >= 3)
        yield Bit(here, want, inputs, ((k * 4 + seen) * 3 + missed) * 2 + agrees)
        at = at[~ask | (token[at] != named[k][at])]


def first_weights() -> np.ndarray:
    """By gate and input: mostly the context that names the token."""
    weights = np.full((GATES, INPUTS), 0.15)
    weights[np.arange(GATES), np.arange(GATES) // (GATES // DEPTH)] = 0.6
    weights[:, DEPTH + 1] = 0.0
    return weights


def learn(weights: np.ndarray, seen: np.ndarray, bit: Bit, yes: np.ndarray) -> None:
    """Online steps over one question, in place."""
    for lo in range(0, len(yes), BATCH):
        part = slice(lo, lo + BATCH)
        x, gate, one = bit.inputs[:, part], bit.gate[part], yes[part]
        dot = np.einsum("kn,nk->n", x, weights[gate])
        place, share = curve_place(dot)
        code = (one.astype(np.int64) * GATES + gate) * CURVE + place
        seen += (np.bincount(code, 1 - share, seen.size) + np.bincount(code + 1, share, seen.size)).reshape(seen.shape)
        slope = x * (one - squash(dot))
        n = np.bincount(gate, minlength=GATES)
        for k in range(INPUTS):
            weights[:, k] += RATE * np.bincount(gate, slope[k], GATES) / (n + 20)


@dataclass
class Running:
    """The slots of all tasks, the learned weights and the refining curve; ``alone`` as in ``questions``."""

    slots: Slots
    weights: np.ndarray
    curve: np.ndarray
    alone: np.ndarray

    def yes(self, bit: Bit) -> np.ndarray:
        """Probability that the named token is the one."""
        dot = np.einsum("kn,nk->n", bit.inputs, self.weights[bit.gate])
        place, share = curve_place(dot)
        refined = self.curve[bit.gate, place] * (1 - share) + self.curve[bit.gate, place + 1] * share
        return (squash(dot) + squash(refined)) / 2

    def code(self, token: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By position: (log10 probability of its bits, whether a context named the token, frequency of the tokens named in vain)."""
        cost, hit, vain = np.zeros(len(token)), np.zeros(len(token), bool), np.zeros(len(token))
        for bit in questions(self.slots, keys, token, self.alone):
            p, right = self.yes(bit), token[bit.at] == bit.named
            cost[bit.at] += np.log10(np.where(right, p, 1 - p))
            hit[bit.at] |= right
            vain[bit.at] += squash(self.alone[bit.named])
        return cost, hit, vain


def learn_running(texts: DataFrame, runs, alone: np.ndarray, tokens: int) -> Running:
    """Learn from all training texts: ``runs(column)`` gives (tokens' numbers, context hashes) of a column of texts, chunk by chunk."""
    bits = slot_bits(tokens)
    shared = texts.sparkSession.sparkContext.broadcast(alone)

    def task(batches):
        slots, weights, seen, n = Slots.empty(bits), first_weights(), np.zeros((2, GATES, CURVE)), 0
        for batch in batches:
            for token, keys in runs(batch.column(0)):
                for lo in range(0, len(token), STEP):
                    part = slice(lo, lo + STEP)
                    for bit in questions(slots, keys[:, part], token[part], shared.value):
                        learn(weights, seen, bit, (token[part][bit.at] == bit.named).astype(float))
                        n += len(bit.at)
                    slots.add(keys[:, part], token[part])
        me = TaskContext.get().partitionId()
        yield rows_of([-1], me, [np.concatenate([weights.reshape(-1) * n, seen.reshape(-1), [n]])])
        cells = slots.cells.reshape(-1, min(BLOCK, 1 << bits))
        some = np.flatnonzero(cells.any(axis=1))
        for lo in range(0, len(some), 64):
            yield rows_of(some[lo : lo + 64], me, cells[some[lo : lo + 64]])

    def merge(batches):
        now, sums = None, None
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(2)):
                values = values.as_buffer()
                if block != now:
                    if now is not None:
                        yield rows_of([now], 0, [sums])
                    now, sums = block, np.frombuffer(values, np.float64 if block < 0 else np.uint64)
                elif block < 0:
                    sums = sums + np.frombuffer(values, np.float64)
                else:
                    sums = join(sums, *parts_of(np.frombuffer(values, np.uint64)))
        if now is not None:
            yield rows_of([now], 0, [sums])

    kind = "block int, part int, data binary"
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // SPLITS)
    learnt = texts.select("text").coalesce(tasks).mapInArrow(task, kind)
    rows = learnt.repartition("block").sortWithinPartitions("block", "part").mapInArrow(merge, kind).toArrow()
    model = Running(Slots.empty(bits), first_weights(), np.tile(np.linspace(-8, 8, CURVE), (GATES, 1)), alone)
    cells = model.slots.cells.reshape(-1, min(BLOCK, 1 << bits))
    for block, data in zip(rows.column(0).to_pylist(), rows.column(2)):
        if block >= 0:
            cells[block] = np.frombuffer(data.as_buffer(), np.uint64)
            continue
        flat = np.frombuffer(data.as_buffer(), np.float64)
        cut, n = GATES * INPUTS, flat[-1]
        if n:
            model.weights = flat[:cut].reshape(GATES, INPUTS) / n
        seen, start = flat[cut:-1].reshape(2, GATES, CURVE), squash(np.linspace(-8, 8, CURVE))
        p = (seen[1] + 4 * start) / (seen.sum(axis=0) + 4)
        model.curve = np.log(p / (1 - p))
    return model


def rows_of(blocks, part: int, data) -> pa.RecordBatch:
    columns = [pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([x.tobytes() for x in data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "part", "data"])
