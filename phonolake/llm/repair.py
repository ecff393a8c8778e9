"""Cheapest repair of conversations by weighted interval parsing.

A conversation shall have the role initials ``(s?(ua)+)?``. The repair grammar is in Chomsky
normal form over the four stages of that pattern (nothing yet, after s, after u, after a):
a symbol for every pair of stages, N(p,q) -> N(p,r) N(r,q), stands for a span of rows whose
repaired form leads from stage p to stage q. Terminal rules are the edits of one row, and the
insertion closure adds turns between rows, at either side of a span. A cell holds for each symbol
the smallest (cost, audit) over all derivations, audit being the edits' initials in order.

Every way to split a span derives the same repairs here, as each stage in between is a
symbol of its own, so cells are combined bottom-up along spans of doubling length. An
audit that extends another of the same rows has more insertions and costs more, so least
audits stay least when spans are joined. Blocks of ``BLOCK`` rows are parsed by any task;
cells of blocks are parsed on as rows of the next round, until a conversation is one cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.operators.ordering import ordered_scan
from phonolake.session import materialise

BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = r"\x20\x09-\x0D"

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role initial leads from each stage.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {"u": "user", "a": "assistant"}
#: Legal neighbours, as role initials.
LEGAL = {"su", "ua", "au"}

Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: N(p,q) -> N(p,r) N(r,q)."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                made = (cost + other[0], audit + other[1])
                if (p, q) not in out or made < out[p, q]:
                    out[p, q] = made
    return out


def insertions() -> Cell:
    """The closure of inserting user and assistant turns into an empty span."""
    closure: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = {(p, q): (INSERT, "I") for x in "ua" for p, q in NEXT[x].items()}
    while True:
        more = join(closure, one)
        better = {k: min(v, closure.get(k, v)) for k, v in {**more, **closure}.items()}
        better = {k: min(v, more.get(k, v)) for k, v in better.items()}
        if better == closure:
            return closure
        closure = better


CLOSURE = insertions()


def row_cell(initial: str, gone: bool, truncated: bool) -> Cell:
    """The cell of one row: its edits, with insertions before and after it."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not gone:
        extra = TRUNCATED if truncated else 0
        for x in "ua":
            for p, q in NEXT[x].items():
                edits[p, q] = min(edits.get((p, q), (1 << 60, "")), (REROLE + extra, "R"))
        for p, q in NEXT.get(initial, {}).items():
            edits[p, q] = min(edits.get((p, q), (1 << 60, "")), (extra, "K"))
    return join(join(CLOSURE, edits), CLOSURE)


def parse(cells: list[Cell]) -> Cell:
    """The cell of a whole span, from its rows' cells: lengths 1, 2, 4 and so on."""
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that gives a legal conversation, an empty one included."""
    return min(cell[k] for k in ((START, START), (START, ASSISTANT)) if k in cell)


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from the rows in order and the audit."""
    stage, edits = START, iter(audit)
    rows = iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if stage == USER else "u"]
        stage = NEXT[role[:1]][stage]
        yield role, text


# ------------------------------------------------------------------ Spark


def faults(rows: DataFrame) -> DataFrame:
    """``grp, at, initial, fault`` (0 none, 1 blank, 2 duplicate, 3 truncated) of placed rows."""
    text = F.col("text")
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = rows.select(
        "grp",
        "at",
        F.substring("role", 1, 1).alias("initial"),
        same.alias("same"),
        (~text.rlike(f"[^{SPACES}]")).alias("blank"),
        (~text.rlike(rf"[.!?][{SPACES}]*\z")).alias("open"),
    )
    narrow = materialise(narrow, "turns")
    first = narrow.groupBy("grp", "same").agg(F.min("at").alias("first"))
    marked = narrow.join(first, ["grp", "same"])
    fault = F.when(F.col("blank"), 1).when(F.col("at") > F.col("first"), 2).when(F.col("open"), 3).otherwise(0)
    return marked.select("grp", "at", "initial", fault.alias("fault"))


CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"
PARSED = ["head", "tail", "illegal", "blank", "duplicate", "truncated", "cells"]


def as_row(head: str, tail: str, counts: list[int], cell: Cell) -> tuple:
    return head, tail, *counts, [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def parsed_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    cells = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, cells]
    made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["grp", "at", *PARSED])


SCHEMA = f"grp string, at long, head string, tail string, illegal long, blank long, duplicate long, truncated long, cells {CELLS}"


def blocks_of(rows: DataFrame) -> DataFrame:
    """``grp, at, rows``: neighbouring rows of a conversation, at most ``BLOCK`` of them, in order."""
    gathered = F.sort_array(F.collect_list(F.struct("at", *[c for c in rows.columns if c not in ("grp", "at")])))
    blocks = rows.groupBy("grp", F.shiftrightunsigned("at", BLOCK_BITS).alias("block")).agg(gathered.alias("rows"))
    return blocks.select("grp", F.col("block").alias("at"), "rows")


def parse_rows(blocks: DataFrame) -> DataFrame:
    """The cells of blocks of turns, with the counts of their faults."""

    def task(batches):
        known: dict[tuple, Cell] = {}
        whole: dict[tuple, Cell] = {}

        def cell_of(turns: tuple) -> Cell:
            if len(turns) > 16:
                return parse([known[t] for t in turns])
            if turns not in whole:
                if len(whole) > 1 << 16:
                    whole.clear()
                whole[turns] = parse([known[t] for t in turns])
            return whole[turns]

        for batch in batches:
            out = []
            for turns in batch.column(2).to_pylist():
                marks = tuple((t["initial"], t["fault"]) for t in turns)
                for x in set(marks) - known.keys():
                    known[x] = row_cell(x[0], x[1] in (1, 2), x[1] == 3)
                initials = [x for x, _ in marks]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
                counts = [illegal, *[sum(f == k for _, f in marks) for k in (1, 2, 3)]]
                out.append(as_row(initials[0], initials[-1], counts, cell_of(marks)))
            yield parsed_batch(batch, out)

    return blocks.mapInArrow(task, SCHEMA)


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """The cells of blocks of cells."""

    def task(batches):
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cells"]} for x in parts]
                counts = [sum(x[k] for x in parts) for k in PARSED[2:6]]
                counts[0] += sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(parts, parts[1:]))
                out.append(as_row(parts[0]["head"], parts[-1]["tail"], counts, parse(cells)))
            yield parsed_batch(batch, out)

    return blocks.mapInArrow(task, SCHEMA)


def parse_conversations(marked: DataFrame, longest: int) -> DataFrame:
    """``grp``, the counts, ``cost`` and ``audit`` of every conversation with rows; the longest has ``longest``."""
    cells = parse_rows(blocks_of(marked))
    while longest > BLOCK:
        longest = -(-longest // BLOCK)
        cells = parse_blocks(blocks_of(materialise(cells, "cells")))
    legal = F.filter("cells", lambda c: (c["p"] == START) & c["q"].isin(START, ASSISTANT))
    least = F.array_min(F.transform(legal, lambda c: F.struct(c["cost"], c["audit"])))
    return cells.select("grp", *PARSED[2:6], least["cost"].alias("cost"), least["audit"].alias("audit"))


def repaired_texts(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``grp, repaired_sha256``: of the repaired ``role:text``, joined by newlines.

    A conversation's audit comes before its rows, which then stream by; a task holds one audit and one batch.
    """
    none = F.lit(None).cast("string")
    heads = audits.select("grp", F.lit(-1).cast("long").alias("at"), none.alias("role"), F.col("audit").alias("text"))
    lines = heads.unionByName(rows.select("grp", "at", "role", "text"))

    def task(batches):
        group, audit, state, done = None, "", None, []

        def lines_of(edits: str, row: tuple[str, str] | None):
            """Take the edits up to the row's own, or all that are left."""
            nonlocal place, stage, begun
            while place < len(edits):
                edit = edits[place]
                if edit != "I" and row is None:
                    break
                place += 1
                role, text = ("", "") if edit == "I" else row
                if edit != "D":
                    if edit != "K":
                        role = ROLES["a" if stage == USER else "u"]
                    stage = NEXT[role[:1]][stage]
                    state.update((("\n" if begun else "") + role + ":" + text).encode("utf-8", "replace"))
                    begun = True
                if edit != "I":
                    break

        place, stage, begun = 0, START, False
        for batch in batches:
            for grp, at, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if at < 0:
                    if group is not None:
                        lines_of(audit, None)
                        done.append((group, state.hexdigest()))
                    group, audit, state = grp, text, hashlib.sha256()
                    place, stage, begun = 0, START, False
                else:
                    lines_of(audit, (role, text))
            yield hashes(done)
            done = []
        if group is not None:
            lines_of(audit, None)
            yield hashes([(group, state.hexdigest())])

    ordered = lines.repartition("grp").sortWithinPartitions("grp", "at")
    return ordered.mapInArrow(task, "grp string, repaired_sha256 string")


def hashes(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["grp", "repaired_sha256"])


def group_of(conversation: str) -> Column:
    """A text for each id that is not null; the null id is empty."""
    return F.coalesce(F.concat(F.lit("+"), F.col(conversation).cast("string")), F.lit(""))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Find the faults of conversations and the cheapest repair of each.

    Takes ``conv_id, turn, role, text`` and ``copy``, which orders equal turns; other columns are not read.
    Rows go by turn, null first, then role and text, then copy. A null role or text is one
    space. Returns per conversation with rows: ``grp`` (see ``group_of``), ``gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``. Empty texts are blank. A null id is a conversation of its own.
    Long texts are only matched and digested; a conversation of any length is parsed in blocks, but its
    audit is one value and its repaired text is digested in order by one task. An empty table gives no rows.
    """
    space = F.lit(" ")
    named = turns.select(
        group_of("conv_id").alias("grp"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.col("copy").cast("int").alias("copy"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    rows = materialise(ordered_scan(materialise(named, "conversations"), order, ["grp"], position="at"), "placed-turns")
    longest = rows.agg(F.max("at")).first()[0]
    marked = faults(rows)
    parsed = materialise(parse_conversations(marked, 1 + (longest or 0)), "parsed")
    texts = repaired_texts(rows, parsed.select("grp", "audit"))
    missing = F.max("turn").cast("decimal(20)") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("grp").agg(F.coalesce(missing.try_cast("long"), F.lit(0)).cast("long").alias("gaps"))
    return parsed.join(texts, "grp").join(gaps, "grp")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of ``conv_id:turn``, and ``copy``; nulls become one space, turns and ids keep theirs.

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it and 4 makes its role ``user``.
    """
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("_draw")).filter("_draw <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_draw") == 1, F.lit("")).when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
