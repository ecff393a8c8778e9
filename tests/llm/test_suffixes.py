"""Byte-exact suffix dedup against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from phonolake.llm import suffixes
from phonolake.llm.suffixes import multikey_order, remove_repeats


def brute(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + window] for _, b in texts for p in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept))
    return out


def made(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é\n"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(50, 400))) for _ in range(10)]
    rows = []
    for d in range(70):
        text = list("".join(rng.choice(pool)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 4))))
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice("ZYX")
        rows.append((d, "".join(text)))
    rows += [(100, None), (101, ""), (102, "short"), (None, "n" * 90), (None, "m" * 20), (5, rows[5][1]), (6, rows[8][1])]
    rows += [(103, "ab" * 300), (104, "".join(chr(97 + k % 7) for k in range(900)))]
    return rows


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], bytes(r[4]))
    assert sorted([(*r[:4], bytes(r[4])) for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, many_blocks, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, at int, core int")
    same(remove_repeats(df, window=60).collect(), brute(rows, 60))


def test_production_window(spark):
    rows = made(4)
    same(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows, 200))


def test_cores_with_many_stretches_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_ROWS", 3)
    rows = made(6)
    same(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=60).collect(), brute(rows, 60))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 4, (3, 500))
    order, group = multikey_order(500, [lambda i, t=t: t[i] for t in table])
    rows = [tuple(table[:, i]) for i in order]
    assert rows == sorted(rows)
    assert all((a == b) == (g == h) for a, b, g, h in zip(rows, rows[1:], group, group[1:]))
