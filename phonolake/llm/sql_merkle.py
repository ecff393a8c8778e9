"""DuckDB SQL of the Merkle manifest: the levels of the trees are unrolled."""

from __future__ import annotations

INNER, OUTER = 8, 5
A_TO_Z = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


def crc32(text: str) -> str:
    """Bit by bit over the bytes of ASCII text."""
    ones = "CAST(4294967295 AS BIGINT)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    values = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend({ones}, {values}), lambda c, b: {step}), {ones})"


def tree(name: str, levels: int) -> list[str]:
    """From ``{name}0`` (grp, pos, h) the levels above and their runs."""
    parts = []
    for k in range(levels):
        parts.append(
            f"{name}run{k} AS MATERIALIZED (SELECT grp, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS line FROM {name}{k} "
            f"WHERE grp IN (SELECT grp FROM {name}{k} GROUP BY grp HAVING count(*) > 1) GROUP BY ALL)"
        )
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT grp, run AS pos, sha256(line) AS h FROM {name}run{k} UNION ALL "
            f"SELECT grp, pos, h FROM {name}{k} WHERE grp NOT IN (SELECT grp FROM {name}run{k}))"
        )
    return parts


def climb(start: str, name: str, levels: int, grp: str, at: str) -> tuple[list[str], str]:
    """Every row of ``start`` (f, proof and more) taken up the levels of a tree."""
    parts, below = [], start
    for k in range(levels):
        place = f"64 * (({at} >> {4 * k}) & 15)"
        left, right = f"substr(line, 1, {place})", f"substr(line, {place} + 65)"
        parts.append(
            f"{start}{name}{k} AS MATERIALIZED (SELECT b.* REPLACE (CASE WHEN line IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, "
            f"CASE WHEN line IS NULL THEN proof ELSE proof || {left} || {right} END AS proof) "
            f"FROM {below} b LEFT JOIN {name}run{k} r ON r.grp = {grp} AND r.run = ({at} >> {4 * k + 4}))"
        )
        below = f"{start}{name}{k}"
    return parts, below


inner_climb, climbed = climb("placed", "node", INNER, "b.g", "b.place")
outer_climb, folded = climb(climbed, "sub", OUTER, "1", "(b.g - 1)")
OP11 = "WITH " + ",\n".join(
    [
        f"""leaves AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, {leaf("text")} AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(A_TO_Z)} ELSE {leaf("text")} END AS f FROM documents)""",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, '' AS proof FROM leaves)",
        "node0 AS MATERIALIZED (SELECT g AS grp, place AS pos, leaf AS h FROM placed)",
        *tree("node", INNER),
        f"sub0 AS MATERIALIZED (SELECT 1 AS grp, grp - 1 AS pos, h FROM node{INNER})",
        *tree("sub", OUTER),
        *inner_climb,
        *outer_climb,
    ]
) + f"""
SELECT doc_id, leaf, n.h AS subroot, s.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s.h AS verified
FROM {folded} b JOIN node{INNER} n ON n.grp = b.g CROSS JOIN sub{OUTER} s
"""
