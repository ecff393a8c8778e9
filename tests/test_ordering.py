"""Ordered scans against plain loops, with groups that span many blocks."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phonolake.operators import ordering
from phonolake.operators.ordering import epoch_order, ordered_indices, ordered_scan, shard_of_batch
from phonolake.operators.selection import collapse_repeats, get_or_last
from phonolake.sources.lines import read_lines


def skewed_rows(n=3000, groups=40, seed=3):
    """A third of all rows in group 0, the rest spread out; values repeat."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        group = 0 if i % 3 == 0 else draw.randrange(1, groups)
        rows.append((group, draw.randrange(50), i, draw.randrange(4)))
    return rows


def by_group(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[row[0]].append(row)
    return groups


def test_scan_positions_sums_and_previous(many_blocks):
    rows = skewed_rows()
    df = many_blocks.createDataFrame(rows, "g int, o int, id int, v int").repartition(7)
    out = ordered_scan(df, [F.col("o").asc(), F.col("id").asc()], ["g"], "at", {"before": "v"}, {"prev": "v"})
    got = {r["id"]: (r["at"], r["before"], r["prev"]) for r in out.collect()}
    want = {}
    for members in by_group(rows).values():
        total = 0
        for at, row in enumerate(members):
            want[row[2]] = (at, total, members[at - 1][3] if at else None)
            total += row[3]
    assert got == want


def test_one_group_spans_several_blocks(many_blocks):
    df = many_blocks.createDataFrame(skewed_rows(), "g int, o int, id int, v int")
    spread = (
        df.repartitionByRange("g", "o", "id").where("g = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    )
    assert len(spread) > 1
    assert max(r["count"] for r in spread) < 3000 / 3


def test_global_scan_with_descending_order(many_blocks):
    rows = skewed_rows(1000)
    df = many_blocks.createDataFrame(rows, "g int, o int, id int, v int")
    out = ordered_scan(df, [F.col("o").desc(), F.col("id").desc()], position="at")
    got = [r["id"] for r in sorted(out.collect(), key=lambda r: r["at"])]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (-r[1], -r[2]))]
    assert sorted(r["at"] for r in out.collect()) == list(range(1000))


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "g int, o int")
    assert ordered_scan(df, [F.col("o").asc()], ["g"], "at").count() == 0


def test_null_group_and_null_values(many_blocks):
    rows = [(None, 1, 5), (None, 2, None), (1, 1, 7), (1, 2, 8)]
    df = many_blocks.createDataFrame(rows, "g int, o int, v int")
    out = ordered_scan(df, [F.col("o").asc()], ["g"], "at", {"before": "v"}, {"prev": "v"})
    got = {(r["g"], r["o"]): (r["at"], r["before"], r["prev"]) for r in out.collect()}
    assert got == {(None, 1): (0, 0, None), (None, 2): (1, 5, 5), (1, 1): (0, 0, None), (1, 2): (1, 7, 7)}


def test_get_or_last(many_blocks):
    rows = skewed_rows(600, 9)
    df = many_blocks.createDataFrame(rows, "g int, o int, id int, v int")
    out = get_or_last(df, "g", [F.col("o").asc(), F.col("id").asc()], "id", [0, 3, 100])
    got = {(r["g"], r["layer"]): r["id"] for r in out.collect()}
    want = {(g, k): m[min(k, len(m) - 1)][2] for g, m in by_group(rows).items() for k in (0, 3, 100)}
    assert got == want


def test_collapse_repeats_across_blocks(many_blocks):
    rows = skewed_rows()
    df = many_blocks.createDataFrame(rows, "g int, o int, id int, v int")
    out = collapse_repeats(df, "g", [F.col("o").asc(), F.col("id").asc()], "v")
    want = set()
    for members in by_group(rows).values():
        want |= {m[2] for at, m in enumerate(members) if at == 0 or members[at - 1][3] != m[3]}
    assert {r["id"] for r in out.collect()} == want


def test_line_numbers_over_unequal_files(spark, tmp_path):
    draw = random.Random(1)
    want = []
    for name, n in (("a", 3000), ("b", 10), ("c", 900), ("d", 1)):
        lines = [f"{name}{i} " + "x" * draw.randrange(40) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in sorted(rows, key=lambda r: r["line_no"])] == want
    assert sorted(r["line_no"] for r in rows) == list(range(len(want)))


def test_part_files_go_by_number(spark, tmp_path):
    for name in ("part-99999-x", "part-100000-x", "part-00007-x"):
        (tmp_path / f"{name}.txt").write_text(f"{name}\n")
    rows = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["value"] for r in rows] == ["part-00007-x", "part-99999-x", "part-100000-x"]


def test_epoch_order_ignores_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "ind")
    one = {r["ind"]: r["pos"] for r in epoch_order(df.coalesce(1), "ind", 7, 1).collect()}
    many = {r["ind"]: r["pos"] for r in epoch_order(df.repartition(13), "ind", 7, 1).collect()}
    other = {r["ind"]: r["pos"] for r in epoch_order(df, "ind", 7, 2).collect()}
    assert one == many and one != other and sorted(other.values()) == list(range(500))


def test_longest_first(spark):
    df = spark.createDataFrame([(0, 5), (1, 9), (2, 5), (3, 1)], "ind bigint, size bigint")
    plain = [r["ind"] for r in ordered_indices(df, "ind", "size").orderBy("pos").collect()]
    assert plain == [1, 2, 0, 3]
    orders = set()
    for epoch in range(8):
        rows = ordered_indices(df, "ind", "size", seed=3, epoch=epoch).orderBy("pos").collect()
        assert [r["size"] for r in rows] == [9, 5, 5, 1]
        orders.add(tuple(r["ind"] for r in rows))
    assert orders == {(1, 0, 2, 3), (1, 2, 0, 3)}


def test_batches_are_dealt_in_turn(spark):
    out = shard_of_batch(spark.range(7).withColumnRenamed("id", "batch_id"), 3).orderBy("batch_id").collect()
    assert [(r["shard"], r["step"]) for r in out] == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1), (0, 2)]


def test_scan_needs_one_exchange(many_blocks):
    """The rows are dealt by range once; nothing is shuffled by block."""
    df = many_blocks.range(1000).selectExpr("id % 3 AS g", "id", "cast(id % 7 as double) AS x")
    ordered = df.repartitionByRange("g", "id").sortWithinPartitions("g", "id").withColumn("_row", F.monotonically_increasing_id())
    scanned = ordering.scan_partitions(ordered, ["g"], {"s": "x"}, {"p": "id"})
    assert scanned._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scan_carries_over_batches(many_blocks):
    """Batches of three rows: places, sums and values before go on across them, NULL groups and cells included."""
    many_blocks.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(None if k % 5 == 0 else k % 3, k, None if k % 4 == 0 else k, None if k % 6 == 0 else k / 4, f"v{k}") for k in range(200)]
        df = many_blocks.createDataFrame(rows, "g int, k int, n int, x double, v string")
        out = ordering.ordered_scan(df, [F.col("k")], ["g"], "at", {"sn": "n", "sx": "x"}, {"before": "v"}).collect()
    finally:
        many_blocks.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 200
    for g in (None, 0, 1, 2):
        own = sorted((r for r in out if r["g"] == g), key=lambda r: r["k"])
        n, x, before = 0, 0.0, None
        for at, r in enumerate(own):
            assert (r["at"], r["sn"], r["before"]) == (at, n, before) and abs(r["sx"] - x) < 1e-9
            n, x, before = n + (r["n"] or 0), x + (r["x"] or 0), r["v"]


def test_sums_of_text_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    with pytest.raises(TypeError, match="needs numbers"):
        ordering.ordered_scan(df, [F.col("k")], sums={"s": "t"})
