"""Bits predicted by the words before: tables and scores by plain counting, word order counts, a proper distribution."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa

from phonolake.llm import running_contexts as rc
from phonolake.llm.context_mixing import hash_of, lowered_words, runs_of, score_texts
from phonolake.llm.text import chunks


class Shared:
    def __init__(self, value):
        self.value = value


def test_contexts_are_the_words_before_in_the_same_text():
    data = np.frombuffer(b"a b c da b c", np.uint8)
    _, words, key = lowered_words(data, np.array([0, 7, 12, 12]))
    token, keys, place = rc.run_of(words, key, np.arange(len(words)), 99)
    assert token.tolist() == [0, 1, 2, 3, 99, 4, 5, 6, 99, 99]
    assert len(token) == 10 and place.tolist() == [0, 1, 2, 3, 5, 6, 7]
    assert keys[0][0] == keys[0][5] == keys[0][9] and keys[2][3] == keys[2][8] and keys[1][4] != keys[1][8]


def test_tally_by_plain_counting():
    rng = np.random.default_rng(1)
    key = (rng.integers(0, 8, 5000).astype(np.uint64) << np.uint64(61)) | rng.integers(0, 3, 5000).astype(np.uint64)
    token = np.where(rng.random(5000) < 0.2, rc.OTHER, rng.integers(0, 6, 5000))
    want, tables = {}, defaultdict(lambda: defaultdict(Counter))
    for k, t in zip(key.tolist(), token.tolist()):
        tables[k >> 61][k & rc.CHECK][t] += 1
    for slot, contexts in tables.items():
        usable = {c: n for c, n in contexts.items() if any(t != rc.OTHER for t in n)}
        check = max(usable, key=lambda c: (sum(usable[c].values()), c))
        best = min((t for t in usable[check] if t != rc.OTHER), key=lambda t: (-usable[check][t], t))
        want[slot] = ((check << rc.TOKEN_BITS) | best, usable[check][best], sum(usable[check].values()))
    got = rc.tally(key, token, 3)
    assert {s: (u, h, t) for s, u, h, t in zip(*(x.tolist() for x in got))} == want
    assert [len(x) for x in rc.tally(key[:0], token[:0], 3)] == [0, 0, 0, 0]
    assert [len(x) for x in rc.tally(key[:4], np.full(4, rc.OTHER), 3)] == [0, 0, 0, 0]


def model_of(spark, texts, words):
    table = np.sort(np.array([hash_of(w.encode()) for w in words], np.uint64))
    alone = np.full(len(table) + 1, np.log(0.01 / 0.99))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    return rc.learn_running(df, runs_of(Shared(table)), alone, sum(len(t.split()) + 1 for t in texts)), table


def test_slots_of_all_tasks_are_those_of_plain_counting(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(400)]
    model, table = model_of(spark, texts, words)
    number = {w: int(np.searchsorted(table, np.uint64(hash_of(w.encode())))) for w in words}
    after = defaultdict(Counter)
    for t in texts:
        run = t.split()
        for i, w in enumerate([*run, None]):
            after[run[i - 1] if i else None][len(words) if w is None else number[w]] += 1
    probe = ["", *words]
    data, offsets = np.frombuffer("".join(probe).encode(), np.uint8), np.cumsum([0] + [len(p) for p in probe])
    _, found, key = lowered_words(data, offsets)
    token, keys, _ = rc.run_of(found, key, np.zeros(len(found), np.int64), len(words))
    named, hits, misses = model.slots.look(keys)
    last = np.cumsum(np.diff(found.first) + 1) - 1
    clashes = 0
    for w, i in zip([None, *words], last.tolist()):
        n = sum(after[w].values())
        clashes += named[0][i] < 0 or hits[0][i] + misses[0][i] != n
        if named[0][i] >= 0:
            assert hits[0][i] <= after[w][int(named[0][i])]
    assert clashes <= 2


def test_choices_of_a_position_sum_to_one(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    model, table = model_of(spark, [" ".join(rng.choices(words, k=9)) for _ in range(300)], words)
    data = np.frombuffer(b"w1 w2 w3 w4", np.uint8)
    _, found, key = lowered_words(data, np.array([0, len(data)]))
    _, keys, _ = rc.run_of(found, key, np.zeros(len(found), np.int64), len(table))
    for at in range(keys.shape[1]):
        every = np.arange(len(table) + 1)
        cost, hit, _ = model.code(every, np.repeat(keys[:, at : at + 1], len(every), axis=1))
        missed = set(np.round(cost[~hit], 12))
        assert hit.sum() <= rc.DEPTH and len(missed) <= 1
        assert abs((10.0 ** cost[hit]).sum() + 10.0 ** (missed.pop() if missed else -np.inf) - 1) < 1e-9


def test_word_order_counts(spark):
    rng = random.Random(4)
    phrases = [" ".join(f"p{rng.randint(0, 400)}" for _ in range(6)) for _ in range(60)]
    rows = [(d, " ".join(rng.choices(phrases, k=8))) for d in range(400)]
    mixed = [(d, " ".join(rng.sample(t.split(), len(t.split())))) for d, t in rows]
    score = lambda data, extra: score_texts(spark.createDataFrame(data + extra, "doc_id long, text string"))
    held = [(d, t) for d, t in rows if crc32(str(d).encode()) % 7 == 2]
    train = [r for r in rows if r not in held]
    plain = score(train, held).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    shuffled = score(train, [r for r in mixed if r[0] in dict(held)]).filter("held_out").agg({"score": "sum"}).first()
    assert plain["sum(score)"] > 0.6 * plain["sum(base_score)"] and shuffled[0] < 1.5 * plain["sum(score)"]


def test_nothing_learnt_and_a_very_long_text(spark):
    held = next(d for d in range(100) if crc32(str(d).encode()) % 7 == 2)
    alone = score_texts(spark.createDataFrame([(held, "a b c")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].train_tokens == 0 and np.isfinite(alone[0].score) and alone[0].score < 0
    long = "one two three four " * 200_000
    got = score_texts(spark.createDataFrame([(0, long), (1, ""), (1, None), (1, "")], "doc_id long, text string")).collect()
    assert max(r.n_tokens for r in got) == 800_001 and all(np.isfinite(r.score) for r in got)
    assert len(list(chunks(pa.array([long])))) == 1
