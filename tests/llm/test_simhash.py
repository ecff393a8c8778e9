"""SimHash components against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from phonolake.llm.components import connected
from phonolake.llm.simhash import anchors, group_links, near_duplicate_report


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for d in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - d, rng.choice([" ", "\n"]).join(words).upper() if d % 7 == 0 else " ".join(words)))
    rows += [(5, None), (3, ""), (None, " \n"), (None, "alone here"), (9, "two words"), (9, "two words"), (8, "Two Words")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = [tuple(r) for r in near_duplicate_report(df).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert near_duplicate_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_cover_distance_one():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    for half in (0, 1):
        for bit in (0, 5, 30, 31):
            y = x ^ np.uint64(1 << (bit + 32 * half))
            wx, ax = anchors(x, half)
            wy, ay = anchors(y, half)
            for i in range(200):
                assert set(ax[wx == i]) & set(ay[wy == i])


def test_large_groups_connect_like_small_ones():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62, 3).astype(np.uint64)
    fp = np.unique(np.array([c ^ (1 << int(a)) ^ (1 << int(b)) for c in centre.tolist() for a, b in rng.integers(0, 60, (40, 2))], np.uint64))
    a, b = group_links(np.zeros(len(fp), np.int64), fp, 3)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    want = {(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3}

    def parts(links):
        root = list(range(len(fp)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in links:
            root[find(i)] = find(j)
        return len({find(i) for i in range(len(fp))})

    at = {int(x): i for i, x in enumerate(fp)}
    assert parts(want) == parts([(at[int(x)], at[int(y)]) for x, y in zip(a, b)])


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(100, 300), (200, 300), (200, 150)] + [(1000, x) for x in range(1001, 1200)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 150: 100, 200: 100, 300: 100, **{x: 1000 for x in range(1001, 1200)}}
