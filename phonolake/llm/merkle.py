"""A Merkle manifest of a document table, with a witness for every document.

Leaves are digests of documents. Per source they ascend by id, and every ``FAN``
consecutive nodes of a level become their digest, until one node remains, the
subroot; the subroots of all sources, in order, give the root in the same way.

The trees grow by appending. An appended node gets what stands to its left in its
open run as a partial witness; every later sibling extends it on the right, and a
full run is appended as one node a level up. A block is an aligned stretch of
``BLOCK`` leaves, so that it is a whole subtree that any task can grow on its own;
block roots are further appends to the tree above, in blocks again, round by round.
Going down the rounds, the witness of a block is added to those of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.llm.text import id_key
from phonolake.operators.ordering import ordered_scan
from phonolake.session import materialise

FAN = 16
LEVELS = 2
BLOCK = FAN**LEVELS
WITNESS = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


class Node:
    """A digest in a growing tree, with its witness so far on this level."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, value: str):
        self.digest, self.left, self.right, self.parent = value, "", [], None

    def witness(self, top: Node | None = None) -> list[tuple[str, str]]:
        """(left, right) siblings, level by level, up to ``top`` or the last node that has a parent."""
        out, node = [], self
        while node is not top and node.parent is not None:
            out.append((node.left, "".join(node.right)))
            node = node.parent
        return out


class Tree:
    """Nodes appended one after the other, in runs of ``FAN``."""

    def __init__(self):
        self.open: list[list[Node]] = [[]]

    def append(self, node: Node, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        node.left = "".join([x.digest for x in run])
        for earlier in run:
            earlier.right.append(node.digest)
        run.append(node)
        if len(run) == FAN:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Node(digest("".join([x.digest for x in run])))
        for node in run:
            node.parent = parent
        self.append(parent, level + 1)

    def finish(self, levels: int) -> Node:
        """Close what is open so that one node remains ``levels`` levels up."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self.close(level)
        return self.open[levels][0]


def height(n: int) -> int:
    """Levels until one of ``n`` nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grown(digests: Sequence[str], levels: int) -> tuple[list[Node], Node]:
    """The nodes of a block, each with its witness, and the block's root ``levels`` up."""
    tree, nodes = Tree(), [Node(x) for x in digests]
    for node in nodes:
        tree.append(node)
    return nodes, tree.finish(levels)


def block_roots(nodes: DataFrame, sizes: DataFrame, before: int) -> DataFrame:
    """``grp, at, n, rows, only, levels, root``: aligned blocks of the nodes (``grp, at, h`` and more) as rows.

    ``sizes`` has the leaves ``n`` of each group, ``before`` the leaves below a node. The only
    block of a group stops at one node, any other goes up all levels.
    """
    rows = F.sort_array(F.collect_list(F.struct("at", *[c for c in nodes.columns if c not in ("grp", "at")])))
    blocks = nodes.groupBy("grp", F.shiftrightunsigned("at", LEVELS * 4).alias("block")).agg(rows.alias("rows"))
    blocks = blocks.join(sizes, "grp").withColumn("only", F.col("n") <= before * BLOCK)
    blocks = blocks.select("grp", F.col("block").alias("at"), "rows", "only")

    def task(batches):
        for batch in batches:
            roots, levels = [], []
            for digests, only in zip(field_lists(batch.column(2), "h"), batch.column(3).to_pylist()):
                levels.append(height(len(digests)) if only else LEVELS)
                roots.append(grown(digests, levels[-1])[1].digest)
            made = [pa.array(levels, pa.int32()), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "levels", "root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.mapInArrow(task, f"{schema}, levels int, root string")


def field_lists(column: pa.ListArray, name: str) -> list[list]:
    """A field of each row's structs as Python lists."""
    return pa.ListArray.from_arrays(column.offsets, column.values.field(name)).to_pylist()


def grow(nodes: DataFrame, sizes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, written, and ``grp, top``: one node for each group.

    The number of rounds grows with the logarithm of the largest group; only that size comes to the driver.
    """
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds, before = [], 1
    while before == 1 or before < most:
        rounds.append(materialise(block_roots(nodes, sizes, before), "merkle-blocks"))
        nodes = rounds[-1].filter("NOT only").select("grp", "at", F.col("root").alias("h"))
        before *= BLOCK
    tops = [r.filter("only").select("grp", F.col("root").alias("top")) for r in rounds]
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return rounds, materialise(top, "merkle-tops")


def with_witnesses(rounds: list[DataFrame], roots: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``grp, at, h``, the columns ``keep`` and ``witness`` of all lowest nodes.

    ``roots`` has ``grp`` and the witness of each group's top as ``above``. From the last round down,
    the witness of a block is added to those of its nodes.
    """
    found = None
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number].join(roots.select("grp", F.col("above").alias("_top")), "grp")
        if found is not None:
            higher = found.select("grp", "at", F.col("witness").alias("_block"))
            blocks = blocks.join(higher, ["grp", "at"], "left")
            blocks = blocks.withColumn("above", F.when(F.col("only"), F.col("_top")).otherwise(F.col("_block")))
        else:
            blocks = blocks.withColumn("above", F.col("_top"))
        found = node_witnesses(blocks.select("grp", "rows", "levels", "above"), keep if number == 0 else ())
        if number:
            found = materialise(found, "merkle-witnesses")
    return found


def node_witnesses(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per node of the blocks: its witness within the block, then that of the block."""
    names = ["at", "h", *keep]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["rows"].dataType.elementType.fields}

    def task(batches):
        for batch in batches:
            levels, above = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, digests in enumerate(field_lists(batch.column(1), "h")):
                more = [(x["left"], x["right"]) for x in above[k]]
                nodes, top = grown(digests, levels[k])
                sides = [node.witness(top) + more for node in nodes]
                ends = [0]
                for x in sides:
                    ends.append(ends[-1] + len(x))
                parts = [pa.array([x[i] for one in sides for x in one], pa.string()) for i in (0, 1)]
                witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["left", "right"]))
                rows = batch.column(1).slice(k, 1).flatten()
                group = batch.column(0).take(pa.array([k] * len(nodes)))
                columns = [group, *[rows.field(c) for c in names], witness]
                yield pa.RecordBatch.from_arrays(columns, ["grp", *names, "witness"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return blocks.mapInArrow(task, f"grp string, {schema}, witness {WITNESS}")


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a document's fields: ``-`` for null, else byte count, colon and value each."""
    parts = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, **also: Column) -> DataFrame:
    """``doc, source, leaf`` of every document, and the columns named in ``also``."""
    return docs.select(
        id_key("doc_id").alias("doc"),
        F.col("source").cast("string").alias("source"),
        leaf_of([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        *[x.alias(name) for name, x in also.items()],
    )


def build_manifest(rows: DataFrame) -> DataFrame:
    """The manifest of ``leaves``: one row per document with its witness.

    Takes ``doc, source, leaf`` and any further columns, which are carried along. Returns them with
    ``subroot, root`` and ``witness``, the (left, right) siblings level by level from the leaf to the root.
    Sources ascend bytewise, null first; within a source documents ascend by id, a null id last, and rows
    of one id by leaf, so that repeated rows give a repeatable manifest. A document's text is only digested,
    however long it is; empty and null texts have digests of their own. An empty table has an empty manifest.
    """
    keep = [c for c in rows.columns if c not in ("doc", "source", "leaf")]
    group = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("source")))
    named = rows.select(group.alias("grp"), "doc", F.col("leaf").alias("h"), *[F.col(c).alias(f"also_{c}") for c in keep])
    placed = ordered_scan(materialise(named, "leaves"), [F.col("doc"), F.col("h")], ["grp"], position="at")
    placed = materialise(placed, "placed-leaves")
    sizes = materialise(placed.groupBy("grp").agg(F.count("*").alias("n")), "merkle-sizes")
    rounds, tops = grow(placed, sizes)

    whole = F.lit("").alias("grp")
    sources = ordered_scan(tops, [F.col("grp")], position="at")
    sources = materialise(sources.select(whole, "at", F.col("top").alias("h"), F.col("grp").alias("name")), "sources")
    outer, root = grow(sources, materialise(sources.agg(F.count("*").alias("n")).select(whole, "n"), "merkle-sizes"))
    end = F.array().cast(WITNESS).alias("above")
    above = with_witnesses(outer, root.select("grp", end), ["name"])
    above = above.select(F.col("name").alias("grp"), F.col("witness").alias("above"), F.col("h").alias("subroot"))
    above = materialise(above, "source-witnesses")

    carried = ["doc", *[f"also_{c}" for c in keep]]
    found = with_witnesses(rounds, above, carried)
    found = found.join(above.select("grp", "subroot"), "grp").withColumn("root", root.select("top").limit(1).scalar())
    return found.select(
        "doc",
        F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("source"),
        F.col("h").alias("leaf"),
        *[F.col(f"also_{c}").alias(c) for c in keep],
        "subroot",
        "root",
        "witness",
    )


def proof_text(witness: str = "witness") -> Column:
    """All siblings of a witness, from the leaf to the root, left to right, as one text."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def fold(leaf: Column, witness: str = "witness") -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda h, w: F.sha2(F.concat(w["left"], h, w["right"]), 256))
