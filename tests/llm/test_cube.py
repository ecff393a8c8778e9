"""Source mixing: targets against step-by-step sharing, balance, whole documents."""

from __future__ import annotations

import random

import pytest

from phonolake.llm.cube import fly, mix_sources


def shared_targets(sizes):
    """Share by weight, cut at three times the size, share the excess again, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left, rest = {}, float(sum(sizes.values())), set(names)
    while rest:
        want = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if want[s] > 3 * sizes[s]]
        if not over:
            return full | want
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]
            rest.discard(s)
    return full


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(6000):
        source = "hot" if d % 3 == 0 else rng.choice(["a", "b", "é", "Z", "tiny", None])
        if source == "tiny" and d > 200:
            source = "b"
        rows.append((d, rng.choice([None, "", "x " * rng.randint(1, 5), "y\n" * rng.randint(1, 200)]), source, 1.0))
    rows += [(None, "a b c", "only", 1.0), (17, "twice", "b", 1.0), (17, "twice", "b", 1.0), (18, "", "void", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mix_sources(df).collect()
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = sorted(shared_targets(size).values())
    have = {}
    for r in got:
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 3
        have.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(k[1] for k in have) == pytest.approx(want, abs=1e-3)
    for (_, target), taken in have.items():
        assert abs(sum(taken) - target) <= 200


def test_flight_keeps_totals():
    rng = random.Random(4)
    size = [rng.randint(0, 50) for _ in range(500)]
    prob = fly([0.37] * 500, size, rng)
    assert sum(0 < p < 1 for p in prob) <= 2
    assert sum(prob) == pytest.approx(0.37 * 500, abs=1e-3)
    assert sum(p * s for p, s in zip(prob, size)) == pytest.approx(0.37 * sum(size), abs=1e-2)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
