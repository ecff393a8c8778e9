"""Mixing sources to target weights by cube-method balanced sampling.

Every document starts with the share of its source's target to its size: the
whole part are certain repeats, the fraction is an inclusion probability. The
flight phase moves the probabilities of three documents at a time along the
null space of two constraints, document total and token total, until one of
them is 0 or 1. Cells of bounded size fly in parallel; at most two documents of
a cell stay open and fly on together with those of other cells of the source,
until one cell is left, whose last documents the landing phase decides.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phonolake.llm.text import WORD_PATTERN, id_key
from phonolake.session import materialise

CELL_ROWS = 2048
MOST = 3
CLOSE = 1e-9


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, n, source_size, target`` from rows of ``source, size``.

    Sources by code point, null last, weigh 1, 2, 3, repeating; a target stops at three times
    its source's size and the excess goes to the others by weight: the level at which all
    targets, ``least(3 * size, weight * level)``, add up to the total. One row per source
    reaches the two windows here.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))
    s = s.withColumn("level", (F.col("total") - capped) / F.sum("weight").over(rest))
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    s = s.withColumn("fit", fits)
    s = s.withColumn("final", F.first("fit", ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(MOST * F.col("source_size").cast("double"), F.col("weight") * F.col("final"))
    return s.select("source", "n", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def fly(prob: list[float], size: list[int], draw: random.Random) -> list[float]:
    """Flight of one cell: probabilities after it, at most two of them not 0 or 1."""
    open_: list[int] = []
    for k in range(len(prob)):
        open_.append(k)
        while len(open_) > 2:
            i, j, m = open_[-3:]
            a, b, c = size[i], size[j], size[m]
            step = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
            up, down = math.inf, math.inf
            for x, u in zip((i, j, m), step):
                if u > 0:
                    up, down = min(up, (1 - prob[x]) / u), min(down, prob[x] / u)
                elif u < 0:
                    up, down = min(up, prob[x] / -u), min(down, (1 - prob[x]) / -u)
            move = up if draw.random() * (up + down) < down else -down
            for x, u in zip((i, j, m), step):
                prob[x] += move * u
                if prob[x] < CLOSE or prob[x] > 1 - CLOSE:
                    prob[x] = float(round(prob[x]))
            open_[-3:] = [x for x in (i, j, m) if 0 < prob[x] < 1]
    return prob


def land(prob: list[float], size: list[int]) -> list[float]:
    """Decide the last open documents: the choice whose tokens come nearest to those expected."""
    open_ = [k for k, p in enumerate(prob) if 0 < p < 1]
    want = sum(prob[k] * size[k] for k in open_)
    choices = range(1 << len(open_))
    best = min(choices, key=lambda c: (abs(want - sum(size[k] for n, k in enumerate(open_) if c >> n & 1)), c))
    for n, k in enumerate(open_):
        prob[k] = float(best >> n & 1)
    return prob


def flight(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    """Fly (and land, in the last cell of a source) the rows of every ``source, cell``."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["spread", "doc", "tag", "size"], kind="stable")
        prob, size = pdf["prob"].tolist(), pdf["size"].tolist()
        prob = fly(prob, size, random.Random(f"{seed} {pdf['source'].iloc[0]} {pdf['cell'].iloc[0]}"))
        return pdf.assign(prob=land(prob, size) if last else prob)

    return rows.groupBy("source", "cell").applyInPandas(task, rows.schema)


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7
) -> DataFrame:
    """Take whole documents, up to three times each, so that each source's words come to its target.

    Returns ``doc, tag`` (see ``keyed``), ``size, source_size, target, repeats, taken`` for every row.
    Null and empty texts have size 0 and are as likely as others; a null source is a source.
    Rows of a repeated id are drawn one by one; equal rows may swap their outcome. Draws depend
    on seed, source and id alone, so reruns agree. Other columns of ``docs`` are not read.
    """
    base = docs.select(
        id_key(doc_id).alias("doc"),
        F.hash(F.col(text).cast("string")).alias("tag"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    sizes = materialise(base, "sizes")
    targets = materialise(source_targets(sizes), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source)
    rows = rows.withColumn("whole", F.floor(share + F.lit(CLOSE)).cast("long"))
    rows = rows.withColumn("prob", F.greatest(share - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("prob", F.when(F.col("prob") < CLOSE, 0.0).otherwise(F.col("prob")))
    rows = rows.withColumn("spread", F.xxhash64("doc", "tag", F.lit(seed)))
    rows = rows.withColumn("cells", F.ceil(F.col("n") / CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod("spread", "cells"))
    done, level = [], 0
    most = targets.agg(F.coalesce(F.max(F.ceil(F.col("n") / CELL_ROWS)), F.lit(1))).first()[0]
    while True:
        rows = materialise(flight(rows, most <= 1, seed + level), "flight")
        if most <= 1:
            done.append(rows)
            break
        done.append(rows.filter("prob IN (0, 1)"))
        rows = rows.filter("prob NOT IN (0, 1)").withColumn("cells", F.ceil(F.col("cells") / (CELL_ROWS // 2)))
        rows = rows.withColumn("cell", F.floor(F.col("cell") / (CELL_ROWS // 2)))
        most, level = math.ceil(most / (CELL_ROWS // 2)), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    repeats = F.col("whole") + F.col("prob").cast("long")
    return out.select(
        "doc", "tag", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken")
    )
