"""Toxicity by averaged subword embeddings and a linear softmax.

A word stands for itself and the 3- to 5-grams of its marked bytes, hashed to a
fixed number of buckets, so an unseen misspelling shares vectors with the words
it resembles. The vectors of a segment of words are averaged and go through a
linear softmax; vectors and softmax are trained together in numpy on a bounded
sample of labelled segments. The worst and the mean segment give the document's
score, through a logistic curve fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.llm.text import chunks, cut_words, first_seen, hash_spans, keyed, lower_ascii, mix, powers, public_id
from phonolake.session import materialise

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SEGMENT_WORDS = 24
#: At most so many labelled documents of either class are read for training.
SAMPLE_DOCUMENTS = 1500
#: And at most so many segments of either class are trained on.
SAMPLE_SEGMENTS = 16000
#: The logistic curve over segment logits is fitted on at most so many labelled documents, none of them trained on.
SAMPLE_CURVE = 20000
SHAPE = ["worst", "mean", "length"]


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' subwords, one word after the other, and their number per word."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - begin[word]
    marked = np.full(len(word), ord("<"), np.uint64)
    inner = (at > 0) & (at < size[word] - 1)
    marked[inner] = data[starts[word[inner]] + at[inner] - 1]
    marked[begin + size - 1] = ord(">")
    table = powers(max(GRAMS))
    key = [hash_spans(data, starts, ends)]
    owner = [np.arange(len(size))]
    for n in GRAMS:
        i = np.flatnonzero(at + n <= size[word])
        h = np.zeros(len(i), np.uint64)
        for k in range(n):
            h += (marked[i + k] + np.uint64(1)) * table[k]
        key.append(mix(h + np.uint64(n)))
        owner.append(word[i])
    key, owner = np.concatenate(key), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (key[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner, minlength=len(size))


@dataclass
class Embeddings:
    """``worth``: each bucket's share in the difference of the two logits; ``bias``: the rest."""

    worth: np.ndarray
    bias: float


def train(bags: list[np.ndarray], labels: np.ndarray, size: int = 8, epochs: int = 3, rate: float = 0.3, seed: int = 3) -> Embeddings:
    """Embeddings and softmax together, by minibatch gradient steps scaled by past gradients."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    past = [np.full(BUCKETS, 1e-6, np.float32), np.full_like(weight, 1e-6), np.full_like(bias, 1e-6)]
    for _ in range(epochs if len(bags) else 0):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 128):
            batch = order[lo : lo + 128]
            length = np.array([len(bags[i]) for i in batch])
            ids, owner = np.concatenate([bags[i] for i in batch]), np.repeat(np.arange(len(batch)), length)
            cuts = np.cumsum(length) - length
            hidden = np.add.reduceat(table[ids], cuts) / length[:, None]
            logits = hidden @ weight + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            into = (p @ weight.T / length[:, None]).astype(np.float32)
            grads = [None, hidden.T @ p / len(batch), p.mean(axis=0)]
            for x, g, s in zip((weight, bias), grads[1:], past[1:]):
                s += g * g
                x -= rate * g / np.sqrt(s)
            used, codes = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(codes, into[owner, k], len(used)) for k in range(size)], axis=1)
            past[0][used] += (grad * grad).mean(axis=1)
            table[used] -= rate * (grad / np.sqrt(past[0][used])[:, None]).astype(np.float32)
    slope = weight[:, 1] - weight[:, 0]
    return Embeddings((table @ slope).astype(np.float32), float(bias[1] - bias[0]))


def segment_logits(column: pa.Array, model: Embeddings) -> np.ndarray:
    """For each text the highest and the mean logit of its segments, and the log of their number.

    Segments overlap by half. A text without words has the bias as its only logit.
    """
    out = [np.zeros((0, 3))]
    half = SEGMENT_WORDS // 2
    for _, data, offsets in chunks(column):
        data = lower_ascii(data)
        words = cut_words(data, offsets)
        found = np.tile([model.bias, model.bias, 0.0], (len(offsets) - 1, 1))
        if len(words):
            one, codes = first_seen(hash_spans(data, words.starts, words.ends))
            ids, count = subwords(data, words.starts[one], words.ends[one])
            total = np.add.reduceat(model.worth[ids].astype(np.float64), np.cumsum(count) - count)
            n = np.diff(words.first)
            blocks = -(-n // half)
            row = np.repeat(np.arange(len(n)), blocks)
            cuts = words.first[row] + half * (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            worth, weight = np.add.reduceat(total[codes], cuts), np.add.reduceat(count[codes], cuts)
            pair = np.append(row[1:] == row[:-1], False)
            logit = np.append(worth[1:], 0.0) * pair + worth
            logit = logit / (np.append(weight[1:], 0) * pair + weight) + model.bias
            some = np.flatnonzero(blocks)
            first = (np.cumsum(blocks) - blocks)[some]
            found[some, 0] = np.maximum.reduceat(logit, first)
            found[some, 1] = np.add.reduceat(logit, first) / blocks[some]
            found[some, 2] = np.log1p(blocks[some])
        out.append(found)
    return np.concatenate(out)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def known_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``doc, y``: one label per document, the highest of several; rows without id or label don't count."""
    kept = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("y")).dropna()
    return kept.groupBy("doc").agg(F.max("y").alias("y"))


def sample_bags(docs: DataFrame, known: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Subword buckets of segments of the sampled documents: a bounded, repeatable sample."""
    parts = []
    for y in (0, 1):
        few = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_DOCUMENTS)
        texts = docs.join(F.broadcast(few), "doc").select("doc", "text")

        def segments(batches):
            for batch in batches:
                for _, data, offsets in chunks(batch.column(1)):
                    data = lower_ascii(data)
                    words = cut_words(data, offsets)
                    ids, count = subwords(data, words.starts, words.ends) if len(words) else (None, np.zeros(0, int))
                    stop = np.append(0, np.cumsum(count))
                    cuts = [(a, min(a + SEGMENT_WORDS, hi)) for lo, hi in zip(words.first[:-1], words.first[1:]) for a in range(lo, hi, SEGMENT_WORDS)]
                    bags = [ids[stop[a] : stop[b]].tobytes() for a, b in cuts]
                    yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(b) for b in bags], pa.int64()), pa.array(bags, pa.binary())], ["key", "bag"])

        rows = texts.mapInArrow(segments, "key long, bag binary").orderBy("key", "bag").limit(SAMPLE_SEGMENTS).collect()
        parts.append([np.frombuffer(r.bag, np.int32) for r in rows])
    return parts[0] + parts[1], np.repeat([0, 1], [len(p) for p in parts])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (offset last) of the logistic curve of ``y`` on the columns of ``x``, by Newton's method."""
    if len(y) == 0 or y.min() == y.max():
        return np.append(np.eye(1, x.shape[1])[0], 0.0)
    centre, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - centre) / width, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        bend = (a.T * (p * (1 - p))) @ a + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(bend, a.T @ (y - p) - ridge * w), -3, 3)
        w += step
        if abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / width, w[-1] - (w[:-1] * centre / width).sum())


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 4,
    fold: int = 2,
    threshold: float = 0.3,
) -> DataFrame:
    """Score every row; learn only from labels of documents outside the held-out fold.

    Returns ``doc, tag`` (see ``keyed``), ``held_out, score, predicted``. Null and empty texts get the score of the bias alone.
    A null id is not held out and has no label. Without labels of both classes there is no curve, and the
    score is that of the worst segment. Rows of a repeated id are scored one by one. Other columns are not read.
    """
    base = keyed(docs, doc_id, text)
    known = materialise(known_labels(labels, "doc_id", label).filter(~held_out(F.col("doc"), folds, fold)), "labels")
    for_curve = F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(4)) == 0
    bags, y = sample_bags(base, known.filter(~for_curve))
    model = train(bags, y)

    def task(batches):
        for batch in batches:
            found = segment_logits(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(found[:, k]) for k in range(3)]], ["doc", "tag", *SHAPE])

    kinds = ", ".join(f"{c} double" for c in SHAPE)
    raw = materialise(base.mapInArrow(task, f"doc long, tag int, {kinds}"), "logits")
    few = raw.join(known.filter(for_curve), "doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_CURVE).select(*SHAPE, "y").toPandas()
    *slopes, offset = fit_curve(few[SHAPE].to_numpy(), (few["y"] > 0).to_numpy(float)).tolist()
    logit = sum((F.col(c) * w for c, w in zip(SHAPE, slopes)), F.lit(offset))
    score = F.lit(1.0) / (1 + F.exp(-logit))
    out = raw.select("doc", "tag", held_out(public_id(), folds, fold).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
