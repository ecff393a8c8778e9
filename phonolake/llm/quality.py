"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts are enough: with the class prior p, the
risk of calling texts bad over the bad ones is the risk over all unlabelled
texts less p times that over the positives. That difference is kept from going
below zero (the non-negative estimator): where a step would take it there, the
step goes the other way. The model is logistic over byte-class pairs and word
statistics, and its score is the probability of a good text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.repetition import repeated_lines
from phonolake.llm.text import chunks, cut_words, hash_spans, keyed, public_id
from phonolake.llm.toxicity import held_out, known_labels
from phonolake.session import materialise

#: At most so many labelled positives and unlabelled texts are trained on.
SAMPLE_POSITIVE = 8000
SAMPLE_UNLABELLED = 16000

KINDS = 16
KIND = np.full(256, 15, np.uint8)
for _kind, _bytes in enumerate(["\n", " \t\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "'\"", "()[]{}", "-_/\\", "#*$%&", "|<>", "@=+~^`"]):
    KIND[[ord(c) for c in _bytes]] = _kind
KIND[128:] = 14
EXTRA = 6
FEATURES = KINDS * KINDS + EXTRA


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: roots of the shares of byte-class pairs, and word statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = KIND[data].astype(np.int64)
    inner = row[1:] == row[:-1]
    code = (row[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
    pairs = np.bincount(code[inner], minlength=n * KINDS * KINDS).reshape(n, KINDS * KINDS)
    words = cut_words(data, offsets)
    count = np.maximum(np.diff(words.first), 1)
    owner = words.rows()
    names = hash_spans(data, words.starts, words.ends)
    again = np.bincount(owner[1:][(names[1:] == names[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(names) else np.zeros(n)
    order = np.lexsort((names, owner))
    fresh = np.append(True, (names[order][1:] != names[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(names)]
    kinds = np.bincount(owner[order][fresh], minlength=n)
    started = np.zeros(len(data) + 1, np.int64)
    started[words.starts + 1] = 1
    lines = repeated_lines(data, offsets, np.cumsum(started)) if len(data) else np.zeros(n)
    length = np.bincount(owner, words.ends - words.starts, n)
    extra = [again / count, np.log1p(kinds) / np.log1p(count), np.log1p(np.diff(words.first)), np.log1p(lines), length / count, (size == 0)]
    return np.concatenate([np.sqrt(pairs / np.maximum(size, 1)[:, None]), np.stack(extra, axis=1)], axis=1)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, rate: float = 0.02, decay: float = 1e-2, seed: int = 5) -> Scorer:
    """Minimise the non-negative risk by minibatch steps (Adam) over standardised features."""
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(FEATURES), float(np.log(prior / (1 - prior))))
    centre, width = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = np.clip((positive - centre) / width, -6, 6), np.clip((unlabelled - centre) / width, -6, 6)
    rng, w, b = np.random.default_rng(seed), np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, t, steps = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0, max(1, len(u) // 1024)
    total = np.zeros(len(w) + 1)
    for epoch in range(epochs):
        for ip, iu in zip(np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)):
            if not len(ip) or not len(iu):
                continue
            zp, zu = p[ip] @ w + b, u[iu] @ w + b
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            bad_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            up, uu = prior * sp / len(ip), su / len(iu)
            bad = np.append(uu @ u[iu] - up @ p[ip], uu.sum() - up.sum())
            good_part = -prior * (1 - sp) / len(ip)
            good = np.append(good_part @ p[ip], good_part.sum())
            grad = good + bad if bad_risk >= 0 else -bad
            grad[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        if epoch >= epochs // 2:
            total += np.append(w, b)
    w, b = np.split(total / (epochs - epochs // 2), [len(w)])
    return Scorer(w / width, float(b[0] - (w * centre / width).sum()))


def sample_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the texts of a bounded list of ids."""

    def task(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                x = features(data, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32()))], ["x"])

    rows = docs.join(F.broadcast(ids), "doc").select("text").mapInArrow(task, "x array<float>").orderBy("x").toArrow()
    flat = rows.column("x").combine_chunks().flatten().to_numpy()
    return flat.reshape(-1, FEATURES).astype(np.float64)


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, fold: int = 1
) -> DataFrame:
    """Score every row; learn only from documents outside the held-out fold.

    Returns ``doc, tag`` (see ``keyed``), ``held_out, score, predicted``. Positives are documents labelled 1;
    unlabelled are all training documents, with their labels hidden, as the risk asks for a sample of the whole. The
    prior is the share of 1 among all training labels, negatives included. Null and empty texts are scored by their
    lack of words. Without positives or training texts every score is the prior (one half without labels). A null id is not held out and has no label; of several labels the highest
    counts; rows of a repeated id are scored one by one. Other columns are not read.
    """
    base = keyed(docs, doc_id, text)
    known = materialise(known_labels(labels, "doc_id", label), "labels")
    train_known = known.filter(~held_out(F.col("doc"), folds, fold))
    few = train_known.agg(F.count("*"), F.sum((F.col("y") > 0).cast("int"))).first()
    prior = min(max(((few[1] or 0) + 1) / (few[0] + 2), 0.01), 0.99)
    positive = train_known.filter("y > 0").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_POSITIVE).select("doc")
    unknown = base.select("doc").filter(~held_out(public_id(), folds, fold)).distinct()
    unknown = unknown.orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_UNLABELLED)
    model = train(sample_features(base, positive), sample_features(base, unknown), prior)

    def task(batches):
        for batch in batches:
            parts = [model.score(features(data, offsets)) for _, data, offsets in chunks(batch.column(2))]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], score], ["doc", "tag", "score"])

    out = base.mapInArrow(task, "doc long, tag int, score double")
    out = out.select("doc", "tag", held_out(public_id(), folds, fold).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
