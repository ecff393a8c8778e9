"""Batches against a greedy loop, and the per-batch collation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phonolake.operators.batching import (
    align_frame_labels,
    batch_by_bucket,
    batch_capacity,
    batch_counts,
    batch_greedy,
    batch_target_size,
    pad_and_mask,
)


def greedy_loop(sizes, max_tokens, max_sentences, multiple):
    """Textbook walk: close a batch when the next sample would break a limit."""
    batches, batch = [], []
    for key, size in sorted(sizes, key=lambda s: (-s[1], -s[0])):
        longest = max([size] + [s for _, s in batch])
        full = batch and (
            (max_sentences is not None and len(batch) == max_sentences)
            or (max_tokens is not None and longest * (len(batch) + 1) > max_tokens)
        )
        if full:
            cut = max(len(batch) // multiple * multiple, len(batch) % multiple)
            batches.append(batch[:cut])
            batch = batch[cut:]
        batch = [*batch, (key, size)]
    if batch:
        batches.append(batch)
    return {key: number for number, members in enumerate(batches) for key, _ in members}


@pytest.mark.parametrize("max_tokens, max_sentences, multiple", [(600, None, 1), (600, None, 8), (600, 11, 4), (None, 10, 8), (100, 3, 8)])
def test_buckets_hold_multiples(many_blocks, max_tokens, max_sentences, multiple):
    draw = random.Random(multiple)
    sizes = [(i, draw.randrange(1, 90)) for i in range(300)]
    df = many_blocks.createDataFrame(sizes, "ind bigint, size bigint")
    out = batch_by_bucket(df, "ind", "size", max_tokens, max_sentences, width=16, multiple=multiple).collect()
    want, number = {}, 0
    last = 99 if max_tokens is None else max_tokens // 16 + 1
    for bucket in range(1, 100):
        members = sorted(((s, i) for i, s in sizes if min(-(-s // 16), last) == bucket), reverse=True)
        most = min(max_sentences or 300, max(max_tokens // (bucket * 16), 1) if max_tokens else 300)
        step = max(most // multiple * multiple, most % multiple)
        for lo in range(0, len(members), step):
            want.update({i: number for _, i in members[lo : lo + step]})
            number += 1
    assert {r["ind"]: r["batch_id"] for r in out} == want


@pytest.mark.parametrize(
    "n, top, max_tokens, max_sentences, multiple",
    [
        (400, 300, 1000, None, 1),
        (400, 300, 1000, 16, 1),
        (400, 300, 2000, 12, 8),
        (333, 50, None, 10, 1),
        (333, 50, None, 10, 4),
        (250, 900, 800, 6, 3),
        (7, 20, 10_000, None, 8),
        (1, 20, 10, 5, 8),
        (300, 40, 700, None, 8),
    ],
)
def test_greedy_equals_loop(many_blocks, n, top, max_tokens, max_sentences, multiple):
    draw = random.Random(n + top + multiple)
    sizes = [(i, draw.randrange(1, top)) for i in range(n)]
    df = many_blocks.createDataFrame(sizes, "ind bigint, size bigint")
    out = batch_greedy(df, "ind", "size", max_tokens, max_sentences, multiple).collect()
    assert {r["ind"]: r["batch_id"] for r in out} == greedy_loop(sizes, max_tokens, max_sentences, multiple)


def test_greedy_with_one_size_for_all(many_blocks):
    sizes = [(i, 7) for i in range(100)]
    df = many_blocks.createDataFrame(sizes, "ind bigint, size bigint")
    out = batch_greedy(df, "ind", "size", 70, None).collect()
    assert {r["ind"]: r["batch_id"] for r in out} == greedy_loop(sizes, 70, None, 1)


def test_bucket_bounds_hold_with_a_hot_bucket(many_blocks):
    draw = random.Random(5)
    sizes = [(i, 100 if i % 3 == 0 else draw.randrange(0, 5000)) for i in range(1500)]
    df = many_blocks.createDataFrame(sizes, "ind bigint, size bigint")
    rows = batch_by_bucket(df, "ind", "size", 4000, 20).collect()
    assert sorted(r["ind"] for r in rows) == list(range(1500))
    batches = {}
    for r in rows:
        batches.setdefault(r["batch_id"], []).append(r["size"])
    assert sorted(batches) == list(range(len(batches)))
    for members in batches.values():
        assert len(members) == 1 or (max(members) * len(members) <= 4000 and len(members) <= 20)


def test_default_budget(spark):
    df = spark.createDataFrame([(0, 3_000_000), (1, 1_000_001), (2, 5)], "ind bigint, size bigint")
    rows = {r["ind"]: r["batch_id"] for r in batch_greedy(df, "ind", "size").collect()}
    assert rows == {0: 0, 1: 1, 2: 1}


def test_capacity_is_at_least_one(spark):
    df = spark.createDataFrame([(5000,), (0,), (100,)], "size bigint")
    got = [r[0] for r in df.select(batch_capacity(F.col("size"), 1000, 64)).collect()]
    assert got == [1, 64, 10]


def test_target_size(spark):
    df = spark.createDataFrame([(0, 10), (0, 30), (1, 500)], "batch_id int, size int")
    padded = {r["batch_id"]: r["target_size"] for r in batch_target_size(df, "size", 100, True).collect()}
    cropped = {r["batch_id"]: r["target_size"] for r in batch_target_size(df, "size", None, False).collect()}
    assert padded == {0: 30, 1: 100} and cropped == {0: 10, 1: 500}


def test_pad_and_crop(spark):
    df = spark.createDataFrame([(1, list(range(5)), 8), (2, list(range(8)), 8), (3, list(range(20)), 8)], "id int, s array<int>, t int")
    out = {r["id"]: r for r in pad_and_mask(df, "s", "t", F.lit(4), F.lit(0), True).collect()}
    assert out[1]["s"] == [0, 1, 2, 3, 4, 0, 0, 0] and out[1]["padding_mask"] == [False] * 5 + [True] * 3
    assert out[1]["start"] == 0 and out[2]["s"] == list(range(8)) and not any(out[2]["padding_mask"])
    assert out[3]["s"] == list(range(4, 12)) and out[3]["start"] == 4


def test_short_sample_without_padding_is_an_error(spark):
    df = spark.createDataFrame([(1, [1, 2], 8)], "id int, s array<int>, t int")
    with pytest.raises(Exception, match="does not pad"):
        pad_and_mask(df, "s", "t", F.lit(0), F.lit(0), False).collect()


def test_align_rounds_half_to_even_and_cuts_to_the_fewest_left(spark):
    rows = [(0, 1, list(range(10)), 8, 5), (0, 2, list(range(6)), 8, 3), (1, 3, [4], 2, 0)]
    df = spark.createDataFrame(rows, "batch_id int, id int, lab array<int>, size int, start int")
    out = align_frame_labels(df, "lab", "size", "start", 50.0, 100.0, pad_id=1, pad_audio=False)
    got = {r["id"]: (r["label_start"], r["target"], r["target_length"]) for r in out.collect()}
    # 5 / 2 and 3 / 2 both round to 2; sample 2 has 4 labels left, just as many as the audio wants.
    assert got == {1: (2, [2, 3, 4, 5], 4), 2: (2, [2, 3, 4, 5], 4), 3: (0, [4], 1)}
    padded = align_frame_labels(df, "lab", "size", "start", -1.0, 100.0, pad_id=1, pad_audio=True)
    got = {r["id"]: (r["target"], r["target_length"]) for r in padded.collect()}
    assert got[2] == ([0, 1, 2, 3, 4, 5, 1, 1, 1, 1], 6) and got[3] == ([4], 1)


def test_batch_counts(spark):
    rows = [(0, "wp", 2, ["a", "b"]), (0, "wp", 1, ["c"]), (1, "wp", 3, [])]
    df = spark.createDataFrame(rows, "batch_id int, label_set string, ind int, tokens array<string>")
    got = {r["batch_id"]: (r["nsentences"], r["ntokens"], r["ids"], r["target_lengths"]) for r in batch_counts(df, "ind").collect()}
    assert got == {0: (2, 3, [1, 2], [1, 2]), 1: (1, 0, [3], [0])}
