"""Framing, features and masks against direct computation, and their invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.functions import sequences as seq
from phonolake.functions import draws
from phonolake.operators import masking, signal
from phonolake.operators.features import cmvn_by_dim
from phonolake.plans import jobs
from phonolake.sources.features import read_frames


def test_frames_of_a_hot_signal(many_blocks):
    draw = random.Random(4)
    lengths = {0: 700, 1: 7, 2: 8, 3: 9, 4: 11, 5: 12, **{u: draw.randrange(1, 60) for u in range(6, 40)}}
    values = {u: [float(draw.randrange(100)) for _ in range(n)] for u, n in lengths.items()}
    rows = [(u, t, v) for u, vs in values.items() for t, v in enumerate(vs)]
    df = many_blocks.createDataFrame(rows, "u int, t int, v double").repartition(6)
    for width, hop in ((8, 4), (5, 3), (3, 5)):
        spread = signal.spread_to_frames(df, "u", [F.col("t").asc()], width, hop)
        got = {(r["u"], r["frame_idx"]): r["samples"] for r in signal.gather_frames(spread, "u", "v", width).collect()}
        want = {
            (u, i): vs[i * hop : i * hop + width]
            for u, vs in values.items()
            if len(vs) >= width
            for i in range(1 + (len(vs) - width) // hop)
        }
        assert got == want
        energy = {(r["u"], r["frame_idx"]): r["energy"] for r in signal.frame_energy(spread, "u", "v", width).collect()}
        assert energy == pytest.approx({k: sum(x * x for x in v) for k, v in want.items()})


@pytest.mark.parametrize("width,hop,hops", [(8, 4, 5), (5, 3, 1), (3, 5, 4), (20, 2, 1), (8, 4, 4096)])
def test_chunks_hold_all_frames(many_blocks, width, hop, hops):
    """One long signal over many chunks, short ones, from samples and from arrays, against slices."""
    draw = random.Random(9)
    values = {u: [float(draw.randrange(100)) for _ in range(n)] for u, n in {0: 900, 1: 0, 2: 1, 3: 7, 4: 8, 5: 21, 6: 63}.items()}
    want = {(u, i // hop): vs[i : i + width] for u, vs in values.items() for i in range(0, len(vs) - width + 1, hop)}
    tall = many_blocks.createDataFrame([(u, t, v) for u, vs in values.items() for t, v in enumerate(vs)], "u int, t int, v double")
    wide = many_blocks.createDataFrame(list(values.items()), "u int, s array<double>")
    for chunks in (
        signal.chunk_samples(tall.repartition(5), "u", [F.col("t").asc()], "v", width, hop, hops),
        signal.chunk_waveforms(wide, "u", "s", width, hop, hops),
    ):
        many = signal.chunk_hops(width, hop, hops)
        got = {}
        for r in chunks.collect():
            assert len(r["samples"]) <= many * hop + max(width - hop, 0)
            for k, x in enumerate(signal.chunk_frames(np.array(r["samples"]), width, hop, many)):
                got[r["u"], r["chunk"] * many + k] = x.tolist()
        assert got == want
        energy = {(r["u"], r["frame_idx"]): r["energy"] for r in signal.energy_of_chunks(chunks, "u", width, hop, hops).collect()}
        assert energy == pytest.approx({k: sum(x * x for x in v) for k, v in want.items()})


def test_features_in_one_pass(many_blocks, tmp_path):
    """Frames, statistics and counts of the written pass against numpy; no exchange behind the chunks."""
    rng = np.random.default_rng(4)
    waves = {u: rng.normal(size=n).round(3).tolist() for u, n in {0: 3000, 1: 15, 2: 16, 3: 200}.items()}
    wide = many_blocks.createDataFrame(list(waves.items()), "u bigint, s array<double>").repartition(3)
    chunks = signal.chunk_waveforms(wide, "u", "s", 16, 8, 10)
    feats = signal.log_mel_of_chunks(chunks, "u", 16000.0, 16, 8, 4, 10)
    assert feats._jdf.queryExecution().executedPlan().toString().count("Exchange") == wide._jdf.queryExecution().executedPlan().toString().count("Exchange")
    utterances = wide.selectExpr("u", "'a' AS audio", "'t' AS tgt_text")
    path = str(tmp_path / "features")
    made = jobs.prepare_features(chunks, "u", 16000.0, 16, 8, 4, utterances, path, 10)
    want = {}
    for u, w in waves.items():
        stack = [w[i : i + 16] for i in range(0, len(w) - 15, 8)]
        if stack:
            want.update({(u, k): x for k, x in enumerate(signal.log_mel_matrix(np.array(stack), 16000.0, 4))})
    stored = read_frames(many_blocks, f"{path}/kind=frames").collect()
    assert {(r["utt_id"], r["frame_idx"]) for r in stored} == set(want) and len(stored) == len(want)
    assert all(np.allclose(r["feat"], want[r["utt_id"], r["frame_idx"]], rtol=1e-6) for r in stored)
    assert made.frames.count() == len(want) and made.frames.schema.names == ["utt_id", "frame_idx", "feat", "unit"]
    grid = np.array(list(want.values()))
    stats = {r["dim"]: r for r in made.stats.collect()}
    assert sorted(stats) == [0, 1, 2, 3]
    for d, r in stats.items():
        assert r["n"] == len(grid) and r["sum"] == pytest.approx(grid[:, d].sum()) and r["std"] == pytest.approx(grid[:, d].std(), rel=1e-5)
    assert {r["u"]: r["n_frames"] for r in made.manifest.collect()} == {u: max(0, 1 + (len(w) - 16) // 8) for u, w in waves.items()}


def test_vector_sums_equal_cells(spark):
    rows = [([1.0, 2.0, 3.0],), ([4.0, None, 6.0],), (None,), ([],), ([7.0],)]
    df = spark.createDataFrame(rows, "feat array<float>").repartition(3)
    got = {r["dim"]: (r["n"], r["sum"], r["sumsq"]) for r in cmvn_by_dim(df).collect()}
    assert got == {0: (3, 12.0, 66.0), 1: (2, 2.0, 4.0), 2: (2, 9.0, 45.0)}


def test_array_framing_matches(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 7, 8, 12, 13)], "s array<int>")
    got = [r[0] for r in df.select(seq.signal_frames(F.col("s"), 8, 4)).collect()]
    want = [[list(range(i * 4, i * 4 + 8)) for i in range(max(0, 1 + (n - 8) // 4))] for n in (0, 7, 8, 12, 13)]
    assert got == want


def test_log_mel_of_a_tone_peaks_at_its_band():
    rate, width = 16000, 400
    tone = np.sin(2 * np.pi * 1000 * np.arange(width) / rate)[None, :] * 32768
    feats = signal.log_mel_matrix(tone, rate, 80)[0]
    weights = signal.mel_weights(80, 512, rate)
    assert feats.shape == (80,) and abs(int(feats.argmax()) - int(weights[:, 32].argmax())) <= 1
    assert np.allclose(signal.log_mel_matrix(np.full((1, width), 5.0), rate, 80), math.log(signal.ENERGY_FLOOR))


def test_mono_and_16_bit(spark):
    df = spark.createDataFrame([([[0.5, 0.25], [0.0, 0.75]],), ([[1.0, -1.0]],)], "c array<array<double>>")
    got = [r[0] for r in df.select(seq.to_16_bit(seq.to_mono(F.col("c")))).collect()]
    assert got == [[8192.0, 16384.0], [32768.0, -32768.0]]


def test_resampling_fills_gaps_on_the_line(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 5, 3.0), (1, 40, 8.0), (2, 7, 9.0)], "u int, s bigint, v double")
    got = [tuple(r) for r in signal.resample_series(df, "u", "s", "v", 10).orderBy("u", "grid").collect()]
    assert got == [(1, 0, 2.0, False), (1, 1, 3.5, True), (1, 2, 5.0, True), (1, 3, 6.5, True), (1, 4, 8.0, False), (2, 0, 9.0, False)]


def test_span_mask_invariants(spark):
    df = spark.range(300).selectExpr("id as utt", "cast(id + 1 as int) as n")
    out = {r["utt"]: r for r in masking.span_mask(df, "utt", "n", 0.65, seed=5).collect()}
    again = {r["utt"]: r["masked"] for r in masking.span_mask(df.repartition(9), "utt", "n", 0.65, seed=5).collect()}
    other = {r["utt"]: r["masked"] for r in masking.span_mask(df, "utt", "n", 0.65, seed=6).collect()}
    assert {k: r["masked"] for k, r in out.items()} == again and again != other
    for r in out.values():
        assert r["masked"] == sorted(set(r["masked"])) and all(0 <= p < r["n"] for p in r["masked"])
    long = [len(r["masked"]) / r["n"] for r in out.values() if r["n"] > 100]
    assert 0.35 < sum(long) / len(long) <= 0.65


def test_permuted_positions(spark):
    """Whole permutations hold every position once; a shorter draw is the beginning of a longer one; keys matter."""
    rows = spark.range(1, 260).selectExpr("id", "id as room").withColumn("keys", draws.round_keys("start", 7, F.col("id")))
    out = rows.select(
        "room",
        draws.permuted(F.col("room"), F.col("room"), F.col("keys")).alias("all"),
        draws.permuted(F.ceil(F.col("room") / 3), F.col("room"), F.col("keys")).alias("some"),
    ).collect()
    for r in out:
        assert sorted(r["all"]) == list(range(r["room"]))
        assert r["all"][: len(r["some"])] == r["some"] and len(r["some"]) == -(-r["room"] // 3)
    large = spark.range(400).select("id", F.lit(100).cast("bigint").alias("room")).withColumn("keys", draws.round_keys("s", F.col("id")))
    first = [r[0] for r in large.select(draws.permuted(F.lit(10), F.col("room"), F.col("keys"))).collect()]
    counts = np.bincount(np.concatenate(first), minlength=100)
    assert len({tuple(f) for f in first}) == 400 and counts.min() > 15 and counts.max() < 75
    assert abs(np.corrcoef([f[0] for f in first], [f[1] for f in first])[0, 1]) < 0.2


def test_span_mask_spans_are_whole_in_long_utterances(spark):
    df = spark.createDataFrame([(1, 500)], "utt int, n int")
    masked = masking.span_mask(df, "utt", "n", 0.1, span=10, seed=1).first()["masked"]
    runs, last = [], None
    for p in masked:
        if last is None or p != last + 1:
            runs.append(0)
        runs[-1] += 1
        last = p
    assert all(r >= 10 for r in runs)


def test_spec_augment_masks_whole_bands(spark):
    rows = [(u, t, [float(u + t + d) for d in range(40)]) for u in range(6) for t in range(50)]
    df = spark.createDataFrame(rows, "utt int, t int, f array<double>")
    out = masking.spec_augment(df, "utt", "t", "f", 40, time_width=20, mask_value=-1.0, seed=3).collect()
    assert len(out) == 300
    for utt in range(6):
        grid = np.array([r["f"] for r in sorted((r for r in out if r["utt"] == utt), key=lambda r: r["t"])])
        gone = grid == -1.0
        dims, times = gone.all(axis=0), gone.all(axis=1)
        assert (gone == (dims[None, :] | times[:, None])).all()
        assert dims.sum() <= 2 * 29 and times.sum() <= 2 * 19
        kept = ~gone
        want = np.array([[utt + t + d for d in range(40)] for t in range(50)], dtype=float)
        assert (grid[kept] == want[kept]).all()
    narrow = spark.createDataFrame([(1, t, [1.0] * 20) for t in range(60)], "utt int, t int, f array<double>")
    masked = masking.spec_augment(narrow, "utt", "t", "f", 20, freq_bands=0, mask_value=-1.0, seed=4).collect()
    spans = sum(r["f"] == [-1.0] * 20 for r in masked)
    assert 0 < spans <= 2 * 40
    banded = masking.spec_augment(narrow, "utt", "t", "f", 20, time_spans=0, mask_value=-1.0, seed=3).collect()
    assert len({tuple(r["f"]) for r in banded}) == 1 and -1.0 in banded[0]["f"]


def test_spec_augment_default_value_is_the_mean(spark):
    rows = [(1, t, [float(d) for d in range(40)]) for t in range(30)]
    df = spark.createDataFrame(rows, "utt int, t int, f array<double>")
    out = masking.spec_augment(df, "utt", "t", "f", 40, seed=3).collect()
    changed = {x for r in out for d, x in enumerate(r["f"]) if x != d}
    assert changed <= {19.5}


def test_pool_and_stride(spark):
    df = spark.createDataFrame([([True, True, True, False, True],)], "m array<boolean>")
    assert df.select(seq.pool_padding_mask(F.col("m"), F.lit(2))).first()[0] == [True, False]
    labels = spark.createDataFrame([([1, 2, 3, 4, 5],)], "l array<int>")
    assert labels.select(seq.stride_labels(F.col("l"), 3, 2)).first()[0] == [1, 3]
    assert labels.select(seq.stride_labels(F.col("l"), 1, 2)).first()[0] == [1]
    assert labels.select(seq.stride_labels(F.col("l"), 0, 2)).first()[0] == []


def test_lengths(spark):
    got = [r[0] for r in spark.range(0, 7).select(seq.subsampled_length(F.col("id"))).collect()]
    want = [math.floor((math.floor((n - 1) / 2 + 1) - 1) / 2 + 1) for n in range(7)]
    assert got == want


def test_crop_keeps_short_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    assert df.select(seq.crop(F.col("a"), 8, 0)).first()[0] == [1, 2, 3, 4, 5]
    assert df.select(seq.crop(F.col("a"), 2, 3)).first()[0] == [4, 5]
    starts = spark.range(200).select(seq.crop_start(F.lit(12), 8, F.col("id"), seed=1).alias("s"))
    assert {r["s"] for r in starts.collect()} == {0, 1, 2, 3, 4}
    assert spark.range(1).select(seq.crop_start(F.lit(5), 8, F.col("id"), seed=1)).first()[0] == 0


def test_get_or_last_and_input_length(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(seq.get_or_last(F.col("a"), 7)).collect()] == [3, None]
    assert [r[0] for r in df.select(seq.get_or_last(F.col("a"), 1)).collect()] == [2, None]
    rows = [(4, [True], 9), (None, [False, False, True], 9), (None, None, 9)]
    lens = spark.createDataFrame(rows, "g int, m array<boolean>, n int")
    got = [r[0] for r in lens.select(seq.input_length(F.col("g"), F.col("m"), F.col("n"))).collect()]
    assert got == [4, 2, 9]
