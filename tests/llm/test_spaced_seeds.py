"""Decontamination against a plain search along all diagonals."""

from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
import pytest

from phonolake.llm import spaced_seeds
from phonolake.llm.spaced_seeds import ENOUGH, MASKS, build_block, compare, find_leaks, item_tokens, longest_alike, masks_of


def plain_tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.sub(r"[!-/:-@\[-`{-~]", "", lowered).replace("\n", " ").split(" ") if w]


def best_stretch(same, fewest):
    """(length, equal, -start) of the longest stretch that is alike, over all stretches."""
    best = None
    for i in range(len(same)):
        for j in range(i + fewest, len(same) + 1):
            if 5 * sum(same[i:j]) >= 4 * (j - i):
                best = max(best or (0, 0, 0), (j - i, sum(same[i:j]), -i))
    return best


def brute(docs, items):
    """All diagonals, no seeds."""
    out = {}
    for d, t in docs:
        text = plain_tokens(t)
        for i, u in items:
            item = plain_tokens(u)
            for diagonal in range(1 - len(item), len(text)):
                lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
                same = [text[diagonal + x] == item[x] for x in range(lo, hi)]
                if len(same) < min(ENOUGH, len(item)) or 2 * sum(same) < min(ENOUGH, len(item)):
                    continue
                best = best_stretch(same, min(ENOUGH, len(item)))
                if best:
                    have = (best[0], best[1], best[2] - diagonal - lo)
                    out[d, i] = max(out.get((d, i), have), have)
    return {(d, i, -s, n, m) for (d, i), (n, m, s) in out.items()}


def cases():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(200)] + ["Über", "ça"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 14, 20, 30, 40])))) for k in range(45)] + [(99, None), (98, ""), (None, "alpha beta gamma delta epsilon zeta eta theta")]
    docs = []
    for d in range(120):
        text = words(rng.randint(0, 60))
        if d % 2:
            part = (rng.choice(items)[1] or "").split(" ")
            part = part[rng.randint(0, 4) :]
            for _ in range(rng.randint(0, 5) if part else 0):
                part[rng.randrange(len(part))] = "sub"
            text[len(text) // 2 : len(text) // 2] = [p.upper() + rng.choice(["", ",", "."]) for p in part] if d % 5 else part
        docs.append((d, rng.choice([" ", "\n "]).join(text)))
    return docs + [(500, None), (501, ""), (502, "alpha beta gamma delta epsilon zeta eta theta"), (3, docs[3][1])], items


def check(spark):
    docs, items = cases()
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    got = find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc, r.item_id, r.start, r.n_tokens, r.n_matched) for r in got}
    want = brute(docs, items)
    assert len(want) > 20 and got == want


def test_equals_brute_force(spark):
    check(spark)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spaced_seeds, "BLOCK_BYTES", 700)
    check(spark)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).count() == 0
    assert all(m[0] == m[-1] == "1" for group in MASKS.values() for m in group)


def hit(pattern, n, masks):
    """Whether a mask finds all its tokens equal in each of the patterns (bits set where equal)."""
    found = np.zeros(len(pattern), bool)
    for mask in masks:
        taken = int(mask[::-1], 2)
        for k in range(n - len(mask) + 1):
            found |= (pattern >> k) & taken == taken
    return found


@pytest.mark.parametrize("n", range(1, 26))
def test_masks_hit_whatever_the_rule_allows(n):
    """Every pattern of substitutions that leaves 0.8 equal; stretches over 25 are cut into parts of 13 to 25."""
    full = (1 << n) - 1
    patterns = np.array([full - sum(1 << k for k in gone) for gone in itertools.combinations(range(n), n // 5)], np.int64)
    assert hit(patterns, n, masks_of(n)).all()


def leak(text, item):
    """(start, tokens, equal) by the operator, on token lists."""
    names, first = item_tokens([" ".join(text)])
    found = compare(build_block([(1, " ".join(item))]), names, first)
    return [tuple(x[2:]) for x in found.tolist()]


def spoilt(marks, item):
    return [w if m == "=" else f"x{k}" for k, (w, m) in enumerate(zip(item, marks))]


@pytest.mark.parametrize("marks", ["=" * 13 + "x===x==" * 6, "=" * 20 + "===x" * 100, "===x" * 40 + "=" * 30, "=====x" * 100, "===x===x===x==="])
def test_alike_stretches_in_unlike_company(marks):
    item = [f"w{k}" for k in range(len(marks))]
    want = best_stretch([m == "=" for m in marks], ENOUGH)
    assert leak(spoilt(marks, item), item) == [(-want[2], want[0], want[1])]


def test_longest_alike():
    rng = random.Random(6)
    for _ in range(300):
        same = [rng.random() < 0.75 for _ in range(rng.randint(0, 60))]
        want = best_stretch(same, ENOUGH)
        got = longest_alike(np.array(same, bool))
        assert got == (want and (-want[2], want[0], want[1]))


def test_recall_of_long_items():
    """Random substitutions of a fifth of the tokens: all found, also in the middle of other text."""
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(13, 200)
        item = [f"w{rng.randrange(5000)}" for _ in range(n)]
        text = list(item)
        for k in rng.sample(range(n), n // 5):
            text[k] = "sub"
        around = [f"o{k}" for k in range(40)]
        assert leak(around + text + around, item)


def test_repetitive_texts_end():
    begun = time.time()
    assert leak(["a"] * 5000, ["a"] * 2000) == [(0, 2000, 2000)]
    assert leak(["a", "b"] * 10_000, ["b", "a"] * 200) == [(1, 400, 400)]
    assert leak(["a"] * 100_000 + ["c"] * 13, ["c"] * 20) == [(99_997, 16, 13)]
    assert time.time() - begun < 20


def test_long_text_and_clashing_columns(spark):
    text = " ".join(f"t{k}" for k in range(60_000)) + " " + " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, "a", 2, 3)], "doc_id long, text string, item_id string, start int, doc int")
    items = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(30)), "x")], "item_id long, text string, tag string")
    assert [(r.doc, r.item_id, r.start, r.n_tokens) for r in find_leaks(docs, items).collect()] == [(1, 7, 60_000, 30)]
