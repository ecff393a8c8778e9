"""The manifest against trees built level by level, and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from phonolake.llm import merkle
from phonolake.llm.queries import LLM_QUERIES, LLM_SQL
from tests.compare import connect, differences

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def climb(nodes):
    """The top of a list of nodes, and each one's siblings level by level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(places):
            run = at // 16 * 16
            paths[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
            places[k] = at // 16
        level = [digest("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    out = []
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], []
    for s in sources:
        own = sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        top, paths = climb([leaf(r) for r in own])
        tops.append(top)
        inner.append((own, paths))
    root, outer = climb(tops)
    for (own, paths), top, above in zip(inner, tops, outer):
        for r, path in zip(own, paths):
            path = path + above
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]), *r[5:])
            h = leaf(changed)
            for left, right in path:
                h = digest(left + h + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((r[0], leaf(r), top, root, proof, h, h == root))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    rows = []
    for k in range(700):
        source = rng.choice([None, "", "a", "b", "ü", "hot", "hot", "hot"])
        text = rng.choice([None, "", "x", "Äbc", "ABC def", "z" * 50_000 if k % 90 == 0 else "Y y"])
        rows.append((k * 7 % 1000, source, rng.choice(["de", None]), rng.choice([0, 3, None]), text, "own", k))
    rows += [(5000, "lone", "en", 1, "T", "own", 1), (None, "hot", "en", 1, "T", "own", 1), (None, "hot", None, 1, "U", "own", 1)]
    rows += [rows[3], rows[3]]
    rows += [(6000 + k, f"s{k:03}", "en", k, "text", "x", 0) for k in range(40)]
    return rows


def query(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = LLM_QUERIES["op11_merkle_manifest"](spark, path).collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got], key=str)


def test_equals_brute_force(spark, tmp_path):
    rows = cases()
    want = brute(rows)
    assert {x[-1] for x in want} == {True, False}
    assert query(spark, rows, tmp_path) == want


def test_more_rounds(spark, tmp_path, monkeypatch):
    """Blocks of one level: three rounds for the hot source, two for the sources."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = cases()
    assert query(spark, rows, tmp_path) == brute(rows)


def test_empty_and_one(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    one = [(1, "a", "b", 2, "Text", "x", 0)]
    assert query(spark, one, tmp_path) == brute(one)


def test_appending_completes_witnesses():
    tree, nodes = merkle.Tree(), [merkle.Node(f"{k:02}") for k in range(17)]
    tree.append(nodes[0])
    assert nodes[0].left == "" and nodes[0].right == [] and nodes[0].parent is None
    for node in nodes[1:16]:
        tree.append(node)
    assert nodes[3].left == "000102" and nodes[3].right[0] == "04" and len(nodes[3].right) == 12
    assert nodes[0].parent is nodes[15].parent and nodes[0].parent.right == []
    tree.append(nodes[16])
    top = tree.finish(2)
    assert nodes[16].witness(top) == [("", ""), (nodes[0].parent.digest, "")]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_sql(spark, folder):
    name = "op11_merkle_manifest"
    assert differences(LLM_QUERIES[name](spark, folder), LLM_SQL[name], connect(folder)) == []
