"""Repetition counts against brute force."""

from __future__ import annotations

import random
import re

import pytest

from phonolake.llm.repetition import LONGEST_SHARE, LONGEST_WORDS, MOST_COVERED, REPEAT_WORDS, judge_repetition


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)

    def inside(size):
        seen, gone = {}, set()
        for p in range(n - size + 1):
            seen.setdefault(tuple(w[p : p + size]), []).append(p)
        for places in seen.values():
            if len(places) > 1:
                for p in places:
                    gone |= set(range(p, p + size))
        return len(gone)

    longest = 0
    while longest < n and len({tuple(w[p : p + longest + 1]) for p in range(n - longest)}) < n - longest:
        longest += 1
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += line in lines and bool(line.strip(" \t\n\x0b\x0c\r"))
        lines.add(line)
    repeat, covered = inside(8), inside(REPEAT_WORDS)
    failed = n < 20 or 100 * repeat > 30 * n
    kept = not failed and 100 * covered <= MOST_COVERED * n and longest <= max(LONGEST_WORDS, LONGEST_SHARE * n // 100)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, kept, covered, longest)


@pytest.mark.parametrize("alphabet", [2, 12, 200])
def test_equals_brute_force(spark, alphabet):
    rng = random.Random(alphabet)
    rows = []
    for d in range(60):
        words = [f"w{rng.randrange(alphabet)}é#"[: rng.choice([2, 4, 9])] for _ in range(rng.randint(0, 120))]
        piece = words[: rng.randint(0, 60)]
        text = rng.choice([" ", "\n", "\n \n", "\t\r\n"]).join(words + piece * rng.randint(0, 3))
        rows.append((d, rng.choice(["", "\n"]) + text + rng.choice(["", " ", "\n"])))
    rows += [(None, None), (70, ""), (71, " \n\n \n"), (72, "one"), (3, rows[3][1]), (73, "For " * 300), (74, "\n".join(["same line here"] * 9))]
    rows += [(75, "no\x0bbreak here é 日本語 | < >")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in judge_repetition(df).collect()), key=key)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=key)


def test_empty(spark):
    assert judge_repetition(spark.createDataFrame([], "doc_id long, text string")).collect() == []
