"""Positive-unlabelled learning: held-out accuracy, the risk's floor, edge rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from phonolake.llm.quality import FEATURES, features, score_quality, train
from phonolake.llm.text import public_id


def test_features_belong_to_their_text():
    texts = ["Good words here.\nAnd there", "", "a a a | | #", "é\n\né"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = features(data, offsets)
    for k, t in enumerate(texts):
        one = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(features(one, np.array([0, len(one)]))[0], whole[k])
    assert whole.shape == (4, FEATURES)


def test_train_separates_without_negatives():
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(0.5, 0.5, (n, FEATURES))
    bad = lambda n: rng.normal(-0.5, 0.5, (n, FEATURES))
    model = train(good(600), np.concatenate([good(1400), bad(600)]), 0.7)
    assert (model.score(good(200)) >= 0.5).mean() > 0.95 and (model.score(bad(200)) < 0.5).mean() > 0.95
    empty = train(np.zeros((0, FEATURES)), good(5), 0.8)
    assert np.allclose(empty.score(good(3)), 0.8)


def test_query(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(1200):
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(20, 150))]
        bad = rng.random() < 0.25
        rows.append((d, " ".join(w + rng.choice(["###", "&&&", "***"]) for w in words) if bad else " ".join(words) + ".", 0.5))
        if d % 2:
            labels.append((d, int(not bad)))
    odd = [(None, None, 0.0), (5000, "", 0.0), (5001, None, 0.0), (5002, "word " * 90000, 0.0), (1, rows[1][1], 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id long, quality int")
    got = score_quality(docs, known).select(public_id(), "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.93
    assert score_quality(docs, known.limit(0)).count() == len(got)
    assert score_quality(docs.limit(0), known).count() == 0
