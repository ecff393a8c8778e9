"""Toxicity: subwords against plain Python, held-out accuracy, edge rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from phonolake.llm.text import cut_words, public_id
from phonolake.llm.toxicity import fit_curve, score_toxicity, subwords


def test_subwords_are_the_same_wherever_a_word_stands():
    data = np.frombuffer("bad cat badé bad".encode(), np.uint8)
    words = cut_words(data, np.array([0, len(data)]))
    ids, count = subwords(data, words.starts, words.ends)
    parts = np.split(ids, np.cumsum(count)[:-1])
    assert parts[0].tolist() == parts[3].tolist() and len(set(parts[0]) & set(parts[2])) >= 3
    assert count.tolist() == [1 + 3 + 2 + 1, 7, 1 + 5 + 4 + 3, 7]


def rows_and_labels(n=900):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["zorgle", "quixbad", "vexxim", "zorgled", "vexxims"]
    rows, labels = [], []
    for d in range(n):
        words, toxic = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))], rng.random() < 0.25
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((d, " ".join(words), 0.0))
        if d % 4:
            labels.append((d, int(toxic), 9))
    return rows, labels


def test_learns_and_handles_odd_rows(spark):
    rows, labels = rows_and_labels()
    odd = [(None, None, 0.0), (5000, "", 0.0), (5001, None, 0.0), (5002, "x" * 300000, 0.0), (1, rows[1][1], 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (labels[0][0], labels[0][1], 0)], "doc_id long, toxic int, text int")
    got = score_toxicity(docs, known).select(public_id(), "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {d: t for d, t, _ in labels}
    right = [(r.predicted == truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 100 and np.mean(right) > 0.9


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert score_toxicity(docs, none).count() == 2
    assert score_toxicity(docs.limit(0), none).count() == 0


def test_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2)) * [3, 0.1] + [5, -2]
    p = 1 / (1 + np.exp(-(x @ [0.7, 4.0] + 2)))
    w = fit_curve(x, (rng.random(4000) < p).astype(float), 1e-3)
    assert abs(w - [0.7, 4.0, 2.0]).max() < 2.0
