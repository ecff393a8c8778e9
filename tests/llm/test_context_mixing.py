"""Language-model scores: counts and base by brute force, a proper distribution, better than unigrams."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from phonolake.llm import context_mixing
from phonolake.llm.context_mixing import END, Counts, assemble, count_bits, context_keys, learn_online, score_texts, spell
from phonolake.llm.running_contexts import OTHER, STEP, run_of
from phonolake.llm.text import chunks, public_id


def plain_tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return lowered.replace("\n", " ").split(" ")


def rows_of():
    rng = random.Random(6)
    parts = ["ka", "lo", "mi", "été", "ru", "so"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = [(d, " ".join(rng.choice([word(), word(), "The", "and"]) for _ in range(rng.randint(0, 60)))) for d in range(300)]
    return rows + [(None, "null id kalo"), (None, None), (900, ""), (901, None), (902, "x" * 5000), (5, rows[5][1]), (5, "other text"), (6, rows[6][1])]


@pytest.mark.parametrize("frequent", [1 << 18, 10, 0])
def test_counts_and_base(spark, monkeypatch, frequent):
    monkeypatch.setattr(context_mixing, "FREQUENT", frequent)
    rows = rows_of()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [([w for w in plain_tokens(t) if w] + [None]) for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, tokens) if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(d, out(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws in zip(rows, tokens)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = score_texts(df).select(public_id(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_frequent_words_are_counted_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "SAMPLE_TEXTS", 5, raising=False)
    monkeypatch.setattr(context_mixing, "FREQUENT", 20)
    learnt, made = context_mixing.learn_running, []
    monkeypatch.setattr(context_mixing, "learn_running", lambda texts, runs, *a: made.append(runs) or learnt(texts, runs, *a))
    rows = [r for r in rows_of() if r[0] is not None and r[0] < 300]
    score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    every = [(d, [w for w in plain_tokens(t) if w]) for d, t in rows]
    c = Counter(w for d, ws in every if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*ws, None])
    least = min(f for f in [0, *c.values()] if sum(n > f for n in c.values()) <= 20)
    named = {w for _, ws in every for w in ws if next(made[0](pa.array([w])))[0][0] != OTHER}
    assert {w for w, n in c.items() if n > least and w} <= named <= {w for w, n in c.items() if n >= least and w}
    assert len(named) == 19


def test_words_are_counted_whole(spark):
    rows = [("Ab ab  été", True), (None, True), ("", False), ("ab zz", False), ("x" * 5000 + " \u00a0y", True)] * 3
    df = spark.createDataFrame(rows, "text string, learn boolean").repartition(2)
    got = {bytes(r.word).decode(): r.c for r in context_mixing.count_words(df).collect()}
    assert got == {"ab": 6, "été": 3, "zz": 0, "x" * 5000: 3, "\u00a0y": 3, "\n": 9}
    least = lambda most: context_mixing.least_count(np.array([3, 1, 2]), np.array([1, 9, 4]), most)
    assert [least(m) for m in (0, 1, 2, 3, 5, 6)] == [9, 4, 4, 1, 1, 0]


def test_shared_beginnings_are_looked_at_once():
    words = [b"the", b"then", b"t", b"there", END, b"x" * 50, b"x" * 50 + b"y", "été".encode(), b"the-", b"a"]
    counts = count_bits(words)
    assert (counts == sum(count_bits([w]) for w in words)).all()
    model = assemble(counts, [learn_online(counts, words)])
    assert np.allclose(model.log10(words), [model.log10([w])[0] for w in words])
    data, offsets = spell([b"the", b"then", b"a"])
    look, own = context_mixing.branches(data, offsets)
    assert look.tolist() == [0, 1, 2, 3, 7, 8, 9, 10] and own.tolist() == [0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7]


def test_tokens_are_a_distribution():
    words = [b"ab", b"abc", b"b", END]
    counts = count_bits(words)
    model = assemble(counts, [learn_online(counts, words)])
    seen = Counts(11, 4, 1, 1)
    first = model.log10([bytes([k]) for k in range(256) if k != 10 and k != 32])
    data, offsets = spell([b"ab"])
    assert 0 < (10.0**first).sum() < 1 and (10.0 ** model.log10(words)).sum() < 1
    assert (10.0 ** seen.token(np.array([5, 2, 1, 3]), model.log10(words))).sum() < 1
    keys = context_keys(data, offsets)
    assert keys.shape == (context_mixing.CONTEXTS, 3)


def test_contexts_do_not_depend_on_neighbouring_words():
    a, x = spell([b"cat", b"the", b"dog"])
    b, y = spell([b"the"])
    assert (context_keys(a, x)[:, x[1] : x[2]] == context_keys(b, y)).all()


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_own_past_against_plain_counting():
    rng = np.random.default_rng(3)
    first = np.array([0, 7, 7, 40])
    row, key = np.repeat([0, 2], [7, 33]), rng.integers(0, 5, 40).astype(np.uint64)
    order, again, odds = context_mixing.own_past(row, key, first)
    for i, k, o in zip(order, again, odds):
        t = i - first[row[i]]
        assert k == (key[first[row[i]] : i] == key[i]).sum()
        w = context_mixing.MOST * t / (t + context_mixing.HALF)
        assert o == pytest.approx(w / (1 - w) * k / t if k else 0)


def plain_bits(run, contexts, named):
    """A token's bits one by one: (log10 probability, named, frequencies of the tokens named in vain)."""
    cost, vain, asked = 0.0, [], []
    found = [tuple(x[0] for x in run.slots.look(contexts[:, None])[i][:, None].T) for i in range(3)]
    known, hits, misses = (np.array(f).reshape(-1) for f in found)
    for k in (2, 1, 0):
        want = known[k]
        if want < 0 or want in asked:
            continue
        asked.append(want)
        x = [math.log((hits[j] + 0.3) / (misses[j] + 0.3)) if known[j] == want else math.log(0.3 / (hits[j] + 0.3)) if known[j] >= 0 else 0.0 for j in range(3)]
        x += [run.alone[int(want)], 0.3]
        seen, missed = sum(hits[k] >= b for b in (2, 3, 6)), sum(misses[k] >= b for b in (1, 3))
        gate = ((k * 4 + seen) * 3 + missed) * 2 + any(known[j] == want for j in range(3) if j != k)
        dot = sum(a * b for a, b in zip(run.weights[gate], x))
        at = (min(max(dot, -7.999), 7.999) + 8) * 2
        lo = int(at)
        refined = run.curve[gate][lo] * (1 - at + lo) + run.curve[gate][lo + 1] * (at - lo)
        p = (1 / (1 + math.exp(-dot)) + 1 / (1 + math.exp(-refined))) / 2
        if want == named:
            return cost + math.log10(p), True, vain
        cost += math.log10(1 - p)
        vain.append(1 / (1 + math.exp(-run.alone[int(want)])))
    return cost, False, vain


@pytest.mark.parametrize("frequent", [1 << 18, 7])
def test_score_by_plain_steps(spark, monkeypatch, frequent):
    """Every token's probability put together one by one, from the model's own spelling, slots and weights."""
    monkeypatch.setattr(context_mixing, "FREQUENT", frequent)
    models, running = [], []
    made, learnt = context_mixing.assemble, context_mixing.learn_running
    monkeypatch.setattr(context_mixing, "assemble", lambda *a: models.append(made(*a)) or models[-1])

    def learn(texts, runs, alone, tokens):
        running.append((learnt(texts, runs, alone, tokens), runs))
        return running[-1][0]

    monkeypatch.setattr(context_mixing, "learn_running", learn)
    rows = [(d, t) for d, t in rows_of()[:60] if d is not None]
    rows += [(1000 + d, t) for d, t in rows[:20]]
    got = {r.doc: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {d: [w.encode() for w in plain_tokens(t) if w] + [END] for d, t in rows}
    c = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, kinds, once, twice = sum(c.values()), len(c), sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    off = (once + 0.5) / (once + 2 * twice + 1)
    named = 0
    for d, ws in tokens.items():
        total = 0.0
        (number, contexts), = running[0][1](pa.array([b" ".join(ws[:-1]).decode()]))
        for t, w in enumerate(ws):
            cost, hit, vain = plain_bits(running[0][0], contexts[:, t], number[t])
            total, named = total + cost, named + hit
            if hit:
                continue
            p = max(c[w] - off, 0) / n + off * kinds / n * 10 ** models[0].log10([w])[0]
            own = context_mixing.MOST * t / (t + context_mixing.HALF)
            p = (1 - own) * p + (own * ws[:t].count(w) / t if t else 0)
            total += math.log10(p) - math.log10(1 - min((1 - own) * sum(vain), 0.999))
        assert got[d] == pytest.approx(total, rel=1e-6)
    assert named > 100 or frequent == 7


def test_certain_bits_stay_finite():
    words = [b"aaaa", b"aaab", END]
    counts = (count_bits(words) * 1e9).astype(np.float32)
    weights, seen, _ = learn_online(counts, words * 50)
    assert np.isfinite(weights).all() and np.isfinite(seen).all()
    assert np.isfinite(assemble(counts, [(weights, seen, 3.0)]).log10(words)).all()


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_takes_little_memory_besides_its_tables():
    rng = np.random.default_rng(5)
    words = [b"%x" % n for n in rng.integers(0, 1 << 60, 1 << 16).tolist()]
    texts = pa.array([b" ".join(words[i] for i in rng.integers(0, 4000, 700)).decode() for _ in range(600)])
    table = np.sort(np.array([context_mixing.hash_of(w) for w in words[:300]], np.uint64))
    runs = context_mixing.runs_of(type("Shared", (), {"value": table}))
    assert texts.nbytes > 5e6
    assert peak_mb(lambda: [None for _ in runs(texts)]) < 40
    assert peak_mb(lambda: count_bits(words)) < 110


def test_runs_keep_the_steps_of_whole_chunks():
    rng = np.random.default_rng(6)
    sizes = [0, 3, *rng.integers(0, 5000, 300).tolist(), 400_000, 1]
    texts = pa.array([None, *[" ".join(map(str, rng.integers(0, 99, n))) for n in sizes]])
    table = np.sort(np.array([context_mixing.hash_of(b"%d" % n) for n in range(50)], np.uint64))
    want = []
    for _, data, offsets in chunks(texts):
        _, words, key = context_mixing.lowered_words(data, offsets)
        at, known = context_mixing.find(table, key, context_mixing.heads_of(table))
        token, keys, _ = run_of(words, key, np.where(known, at, OTHER), len(table))
        want += [(token[lo : lo + STEP], keys[:, lo : lo + STEP]) for lo in range(0, len(token), STEP)]
    got = [
        (token[lo : lo + STEP], keys[:, lo : lo + STEP])
        for token, keys in context_mixing.runs_of(type("Shared", (), {"value": table}))(texts)
        for lo in range(0, len(token), STEP)
    ]
    assert len(got) == len(want) and all((a == b).all() and (x == y).all() for (a, x), (b, y) in zip(got, want))
