"""Substring dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from phonolake.llm.recompression import dedup_substrings, find_anchors, margin
from phonolake.llm.text import hash_spans, leftmost_minimum, mix

STEPS = (("run", 2), ("pair", 3))


def brute(rows, window):
    words = [(d if d is not None else 1 << 63, (t or "").split()) for d, t in rows]
    first = {}
    for d, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, w), (raw, _) in zip(words, rows):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        out.append((raw, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    pool = [[rng.choice("ab" if seed % 2 else "abcdefghij") for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for d in range(80):
        parts = [w for _ in range(rng.randint(0, 6)) for w in rng.choice(pool)]
        for _ in range(rng.randint(0, 3)):
            if parts:
                parts[rng.randrange(len(parts))] = rng.choice("abcz")
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(None, "a b " * 30), (None, "a b " * 30), (500, None), (501, ""), (502, "one"), (7, rows[7][1]), (8, rows[9][1])]
    rows += [(503, "x " * 400), (504, "x " * 100), (505, "é ü " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows, window = made_texts(seed), 20
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, core string")
    got = dedup_substrings(df, window=window, steps=STEPS)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(brute(rows, window), key=key)


def test_production_window(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 150)))) for d in range(40)]
    body = rows[3][1] + " " + rows[4][1]
    rows += [(100 + i, body[i * 2 :] + " q " + body) for i in range(10)]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, 50))


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("alphabet", [2, 3, 50])
def test_equal_windows_have_equal_anchors(alphabet):
    rng = np.random.default_rng(alphabet)
    names = mix(rng.integers(0, alphabet, 4000).astype(np.uint64))
    steps = (("run", 2), ("pair", 3), ("pair", 4))
    window = 2 * sum(margin(steps)) + 6
    piece = names[100:400]
    texts = np.concatenate([names, piece, names[50:500], piece[3:]])
    first = np.cumsum([0, 4000, 300, 450, 297])
    found = find_anchors(texts, first, window, steps)
    seen = {}
    for row, at, n, core in zip(*(found[k].tolist() for k in ("row", "at", "n", "core"))):
        for p in range(at, at + n):
            seen.setdefault(tuple(texts[first[row] + p : first[row] + p + window].tolist()), set()).add(core)
    assert all(len(x) == 1 for x in seen.values())
    assert sum(found["n"]) == sum(max(0, x - window + 1) for x in np.diff(first))


def test_leftmost_minimum():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 7, 33):
        assert leftmost_minimum(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(200 - width + 1)]


def test_hash_spans_depends_on_content_only():
    data = np.frombuffer(b"the cat  the hat cat", np.uint8)
    h = hash_spans(data, np.array([0, 4, 9, 13, 17]), np.array([3, 7, 12, 16, 20]))
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
