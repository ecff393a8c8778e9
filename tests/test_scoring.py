"""Edit distance, sequence scores, loss sums and reports against textbook forms."""

from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.functions import sequences as seq
from phonolake.operators import edit_distance, scoring
from phonolake.operators import ctc
from phonolake.operators.ctc import ctc_score, forward_score, forward_scores


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_hand_cases(spark):
    cases = [
        ("THE CAT SAT ON THE MAT", "THE CAT ON A MAT NOW", 3),
        ("A", "", 1),
        ("", "", 0),
        ("é a", "e a", 1),
    ]
    df = spark.createDataFrame([(a.split(), b.split(), n) for a, b, n in cases], "a array<string>, b array<string>, n int")
    out = scoring.with_edit_distance(df, {"d": ("a", "b")}).collect()
    assert [r["d"] for r in out] == [r["n"] for r in out]


def test_edit_distance_equals_table(spark):
    draw = random.Random(2)
    pairs = [
        ([f"w{draw.randrange(v)}" for _ in range(draw.randrange(40))], [f"w{draw.randrange(v)}" for _ in range(draw.randrange(40))])
        for v in (2, 5, 1000)
        for _ in range(30)
    ]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    out = scoring.with_edit_distance(df, {"d": ("a", "b"), "self": ("a", "a")}).collect()
    assert [r["d"] for r in out] == [distance(r["a"], r["b"]) for r in out]
    assert all(r["self"] == 0 for r in out)


def test_edit_distance_of_long_text_with_many_symbols(spark):
    words = [f"t{i}" for i in range(30_000)]
    other = words[:100] + words[101:20_000] + ["new"] + words[20_001:]
    df = spark.createDataFrame([(words, other)], "a array<string>, b array<string>")
    df = df.withColumn("a", F.slice("a", 1, 3000)).withColumn("b", F.slice("b", 1, 2999))
    assert scoring.with_edit_distance(df, {"d": ("a", "b")}).first()["d"] == 1


def test_missing_sides_and_tokens_count(spark):
    rows = [(None, ["a", "b"]), (["a"], None), (["a", None], ["a"]), ([None], [None]), (None, None)]
    df = spark.createDataFrame(rows, "h array<string>, r array<string>")
    scored = scoring.score_pairs(df, "h", "r")
    assert [(r["err"], r["n_ref"]) for r in scored.collect()] == [(2, 2), (1, 0), (1, 1), (0, 1), (0, 0)]
    totals = scoring.corpus_error_rate(scored).first()
    assert (totals["n_sent"], totals["err"], totals["n_ref"], totals["wer"]) == (5, 4, 4, 100.0)


def test_bit_parallel_distance_equals_table():
    draw = random.Random(7)
    for _ in range(400):
        v = draw.choice([1, 2, 4, 50, 5000])
        a = [draw.randrange(v) for _ in range(draw.choice([0, 1, 63, 64, 65, draw.randrange(300)]))]
        b = [draw.randrange(v) for _ in range(draw.choice([0, 1, 31, 64, 128, draw.randrange(300)]))]
        if draw.random() < 0.3:
            b = a[: len(a) // 2] + b[:5] + a[len(a) // 2 + draw.randrange(4) :]
        assert edit_distance.distance(a, b) == distance(a, b)


def test_long_pairs_take_seconds():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 20_000, 50_000)
    b = np.delete(a, draw.choice(len(a), 500, replace=False))
    b[::100] = 30_000
    begun = time.time()
    found = edit_distance.distance(a.tolist(), b.tolist())
    assert 500 < found <= 1000 and time.time() - begun < 15
    many = list(range(1_200_000))
    assert edit_distance.distance(many, [*many[:600_000], -1, *many[600_001:]]) == 1


def test_token_types_and_order_of_sides(spark):
    rows = [([1, 2, None, 3], [1, None, 3]), (None, [5]), ([], None), ([2**40, 7], [7, 2**40])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").withColumn("c", F.col("b"))
    out = scoring.with_edit_distance(df, {"d": ("a", "b"), "e": ("c", "a")}).collect()
    assert [(r["d"], r["e"]) for r in out] == [(1, 1), (1, 1), (0, 0), (2, 2)]


def test_rates_sum_first(spark):
    df = spark.createDataFrame([(1, 10), (5, 5)], "err bigint, n_ref bigint")
    assert scoring.corpus_error_rate(df).first()["wer"] == 6 * 100 / 15
    assert scoring.corpus_error_rate(df.where("err > 9")).first()["wer"] is None


@pytest.mark.parametrize(
    "err, n, wer",
    [
        (2679, 54401, 4.924541828275215),
        (5465, 50947, 10.726833768426012),
        (2673, 52576, 5.084068776628119),
        (5688, 52342, 10.866990179970196),
    ],
)
def test_published_ratios(spark, err, n, wer):
    assert spark.range(1).select(scoring.error_rate(F.lit(err), F.lit(n))).first()[0] == wer


def by_paths(probs, target, blank=0):
    total = 0.0
    for path in itertools.product(range(probs.shape[1]), repeat=len(probs)):
        merged = [s for s, _ in itertools.groupby(path)]
        if [s for s in merged if s != blank] == list(target):
            total += math.prod(probs[t, s] for t, s in enumerate(path))
    return -math.log(total) if total else math.inf


def test_ctc_hand_case():
    probs = np.array([[0.5, 0.3, 0.2], [0.4, 0.4, 0.2], [0.3, 0.3, 0.4], [0.6, 0.2, 0.2]])
    assert forward_score(np.log(probs), np.array([1, 1]), 0) == pytest.approx(2.8967923256990877, abs=1e-12)
    for target in ([], [1], [2, 1], [1, 2, 1], [1, 1, 1]):
        got = forward_score(np.log(probs), np.array(target, dtype=int), 0)
        assert got == pytest.approx(by_paths(probs, target), abs=1e-12)


def test_ctc_impossible_and_long_targets(spark):
    rows = [(1, [[-0.7, -0.7]], [1, 1]), (2, [[-0.7, -0.7]] * 3, [1, 1])]
    df = spark.createDataFrame(rows, "id bigint, lp array<array<double>>, t array<int>")
    plain = {r["id"]: r["nll"] for r in ctc_score(df, "id", "lp", "t").collect()}
    zeroed = {r["id"]: r["nll"] for r in ctc_score(df, "id", "lp", "t", zero_infinity=True).collect()}
    assert plain[1] == math.inf and zeroed[1] == 0.0 and plain[2] == zeroed[2] == pytest.approx(2.1)
    draw = np.random.default_rng(0)
    logits = draw.normal(size=(900, 30))
    lp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert 0 < forward_score(lp, draw.integers(1, 30, 120), 0) < math.inf


@pytest.mark.parametrize("cells", [1, 60, 1 << 22])
def test_ctc_blocks_equal_path_enumeration(monkeypatch, cells):
    monkeypatch.setattr(ctc, "CELLS", cells)
    draw = np.random.default_rng(3)
    probs = [draw.dirichlet(np.ones(3), size=n) for n in (5, 1, 0, 3, 4, 6, 2, 3)]
    targets = [draw.integers(1, 3, n) for n in (2, 0, 1, 4, 3, 0, 1, 2)]
    got = forward_scores([np.log(p) if len(p) else np.empty((0, 1)) for p in probs], targets, 0)
    for score, p, target in zip(got, probs, targets):
        want = by_paths(p, target) if len(p) else math.inf
        assert score == pytest.approx(want, abs=1e-12)


def test_ctc_null_and_empty_rows(spark):
    rows = [(1, None, [1]), (2, [[-0.7, -0.7]], None), (3, [], []), (4, None, None)]
    df = spark.createDataFrame(rows, "id bigint, lp array<array<float>>, t array<int>")
    got = {r["id"]: (r["n_tokens"], r["nll"]) for r in ctc_score(df, "id", "lp", "t").collect()}
    assert got == {1: (1, math.inf), 2: (0, pytest.approx(0.7)), 3: (0, 0.0), 4: (0, 0.0)}


def test_best_path_collapses_before_dropping_blanks(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2, 0],), ([0, 0],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(seq.best_path(F.col("a"))).collect()] == [[1, 1, 2], [], []]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    assert df.select(seq.argmax(F.col("a"))).first()[0] == 1


def test_loss_weights(spark):
    rows = [(True, 2.0, 1), (True, 1.0, 0), (False, 4.0, 1)]
    df = spark.createDataFrame(rows, "masked boolean, nll double, hit int")
    both = scoring.loss_report(df, masked_weight=1.0, unmasked_weight=0.5).first()
    assert (both["loss"], both["sample_size"]) == (5.0, 3)
    one = scoring.loss_report(df).first()
    assert (one["loss"], one["sample_size"], one["loss_u"], one["correct_u"]) == (3.0, 2, 4.0, 1)
    none = scoring.loss_report(df.where("nll > 9")).first()
    assert (none["loss"], none["sample_size"]) == (0.0, 0)


def test_cross_entropy_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 999.0], 1)], "z array<double>, t int")
    want = math.log(1 + math.exp(-1)) + 1
    assert df.select(seq.cross_entropy(F.col("z"), F.col("t"))).first()[0] == pytest.approx(want)
    soft = df.select(seq.log_softmax(F.col("z"))).first()[0]
    assert sum(math.exp(x) for x in soft) == pytest.approx(1)


def test_throughput_formulas(spark):
    df = spark.createDataFrame([("a", 10, 2.0), ("a", 30, 2.0), ("b", 0, 3.0)], "k string, n bigint, s double")
    got = {r["k"]: r for r in scoring.throughput(df, "n", "s", ["k"]).collect()}
    assert got["a"]["sentences_per_s"] == 2 / (4.0 + 1e-6) and got["a"]["tokens_per_s"] == 1 / (0.1 + 1e-6)
    assert got["b"]["tokens_per_s"] == 1 / (3.0 + 1e-6)


def test_best_hypothesis_ties_go_to_the_lower_rank(spark):
    df = spark.createDataFrame([(1, 0.5, 2, "b"), (1, 0.5, 1, "a"), (1, 0.1, 0, "c")], "utt int, score double, rank int, text string")
    assert scoring.best_hypothesis(df, "utt", "score", "rank", ["text"]).first()["text"] == "a"
