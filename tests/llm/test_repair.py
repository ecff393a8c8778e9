"""Repair against a search over all edit sequences, and the query against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

from phonolake.llm import repair
from phonolake.llm.queries import LLM_QUERIES

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, grp int"


def cheapest(rows):
    """Least (cost, audit, outcome) over edit sequences, by search in order of cost; rows are (role, text, must go, cut off)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if (at, initials, audit, out) in seen:
            continue
        seen.add((at, initials, audit, out))
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, out
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        steps = [(2, "I", at, r, (r, "")) for r in ("user", "assistant")] if audit[-3:] != "III" else []
        if at < len(rows):
            role, text, gone, cut = rows[at]
            steps.append((3, "D", at + 1, None, None))
            if not gone:
                steps.append((cut, "K", at + 1, role, (role, text)))
                steps += [(2 + cut, "R", at + 1, r, (r, text)) for r in ("user", "assistant")]
        for extra, letter, next_at, role, line in steps:
            if role is not None and not role[:1]:
                continue
            more = initials + (role[:1] if role is not None else "")
            heapq.heappush(heap, (cost + extra, audit + letter, next_at, more, out + ((line,) if line else ())))
    raise AssertionError


def brute(rows):
    damaged = {}
    for conv, turn, role, text, *_ in rows:
        damaged.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        if draw:
            damaged[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks = set(), []
        for _, role, text in own:
            body = text.strip(SPACE)
            marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([(r, t, m in ("blank", "duplicate"), int(m == "truncated")) for (_, r, t), m in zip(own, marks)])
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(8)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ünder"])
            text = rng.choice(["Hi.", "so\n", "What?", "Yes! ", "open", None, "", "\t", "\x1c", "é.", "ok…", "x" * 30_000 + ("." if conv % 2 else "")])
            rows.append((conv, rng.choice([turn, turn * 2, None]) if conv % 7 == 0 else turn, role, text, "own", 1))
    rows += [(None, 1, "user", "A null id.", "own", 1), (None, None, None, None, "own", 1), rows[0], rows[0]]
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.", "own", 1)]


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def query(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    out = LLM_QUERIES["op13_conversation_repair"](spark, path)
    return sorted([tuple(r[c] for c in COLUMNS) for r in out.collect()], key=str)


def test_equals_search(spark, tmp_path):
    want = brute(cases())
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in want)
    assert {x for r in want for x in r[7]} == set("DIKR")
    assert query(spark, cases(), tmp_path) == want


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_cells_equal_search_for_short_conversations():
    texts = [("user", 0, 0), ("assistant", 0, 0), ("system", 0, 0), ("tool", 0, 0), ("user", 1, 0), ("assistant", 0, 1)]
    for n in range(1, 5):
        for rows in itertools.product(texts, repeat=n):
            if n == 4 and hash(rows) % 3:
                continue
            cost, audit, _ = cheapest([(r, "t", g, c) for r, g, c in rows])
            cell = repair.parse([repair.row_cell(r[:1], bool(g), bool(c)) for r, g, c in rows])
            assert repair.best(cell) == (cost, audit), rows


def test_long_conversation_in_rounds(spark, monkeypatch):
    """Two rounds of blocks of eight give what one pass over all rows gives."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    monkeypatch.setattr(repair, "BLOCK", 8)
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", f"c{t}", f"d{t}?", " "]), 0) for t in range(300)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"{t}.", 0) for t in range(64)]
    out = {r.grp: r for r in repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int")).collect()}
    own, seen, cells = sorted(rows[:300], key=lambda r: r[1]), set(), []
    marks = []
    for _, _, role, text, _ in own:
        gone = not text.strip() or (role, text) in seen
        seen.add((role, text))
        marks.append((role, text))
        cells.append(repair.row_cell(role[0], gone, not gone and text[-1] not in ".!?"))
    cell = cells[0]
    for c in cells[1:]:
        cell = repair.join(cell, c)
    assert (out["+1"].cost, out["+1"].audit) == repair.best(cell)
    text = "\n".join(f"{r}:{t}" for r, t in repair.repaired(marks, out["+1"].audit))
    assert out["+1"].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (out["+2"].cost, out["+2"].audit, out["+2"].illegal, out["+2"].gaps) == (0, "K" * 64, 0, 0)
