"""Files written and read back, and the manifest traps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonolake.operators import filters, lookup
from phonolake.operators.features import cmvn_by_dim, cmvn_row, normalise
from phonolake.plans import jobs
from phonolake.sources.lines import read_lines
from phonolake.sources import byte_ranges, corpus, dictionary, features, reports


def test_audio_list(spark, tmp_path):
    (tmp_path / "x.info").write_text("/a/b-1.flac HELLO  BIG WORLD \n/a/b-2.flac\n\n")
    got = {tuple(r) for r in corpus.scan_audio_list(spark, str(tmp_path)).collect()}
    assert got == {("b-1", "/a/b-1.flac", "HELLO BIG WORLD"), ("b-2", "/a/b-2.flac", "")}


def test_size_filter_keeps_line_positions(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("/root\n" + "".join(f"_\tp{n}\t{n}\tx\n" for n in (5, 10, 20, 21)))
    got = [tuple(r) for r in corpus.scan_manifest(spark, str(tmp_path), 10, 20).orderBy("ind").collect()]
    assert got == [(1, "p10", 10), (2, "p20", 20)]
    whole = corpus.scan_manifest(spark, str(tmp_path))
    summary = filters.load_summary(whole, "n_frames", 10, 20).first().asDict()
    assert summary == {"loaded": 2, "n_short": 1, "n_long": 1, "longest": 20, "shortest": 10, "total": 4}


def test_short_is_tested_before_long(spark):
    df = spark.createDataFrame([(7,)], "n int")
    assert filters.size_rejects(df, "n", 10, 5).first()["reason"] == "short"


def test_empty_manifest_gives_no_rows(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("/root\n")
    assert corpus.scan_manifest(spark, str(tmp_path)).count() == 0


def test_manifest_escapes(spark):
    row = [(0, "a\tb", "p\\q", 3, "x\ny")]
    df = spark.createDataFrame(row, "ind bigint, id string, audio string, n_frames int, tgt_text string")
    assert corpus.manifest_lines(df, "ind").where("ind = 0").first()["line"] == "a\\tb\tp\\\\q\t3\tx\\ny"


def test_labels_align_with_the_unfiltered_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "l").mkdir()
    (tmp_path / "m" / "m.tsv").write_text("/root\n" + "".join(f"_\tp{n}\t{n}\n" for n in (5, 10, 20)))
    (tmp_path / "l" / "m.wp").write_text("A B\nC\n\n")
    kept = corpus.scan_manifest(spark, str(tmp_path / "m"), 10)
    labels = corpus.scan_labels(spark, str(tmp_path / "l"), "wp", -1.0)
    got = {r["path"]: r["tokens"] for r in filters.align_labels(kept, labels).collect()}
    assert got == {"p10": ["C"], "p20": []}
    assert filters.label_count_check(corpus.scan_manifest(spark, str(tmp_path / "m")), labels).first()["agrees"]


def test_label_durations(spark):
    df = spark.createDataFrame([(100, 40, 50.0), (100, 48, 50.0), (100, 3, -1.0)], "size int, n int, rate double")
    got = [r["mismatch"] for r in filters.verify_label_lengths(df, "size", 100.0, "n", "rate").collect()]
    assert got == [True, False, False]


def test_dictionary_and_tokens(spark, tmp_path):
    df = spark.createDataFrame([(1, ["b", "a", "a", "c"]), (2, []), (3, ["zz", "a"])], "utt int, t array<string>")
    built = dictionary.build_dictionary(df.where("utt < 3"), "t")
    want = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "a": 4, "b": 5, "c": 6}
    assert {r["symbol"]: r["id"] for r in built.collect()} == want
    dictionary.write_dictionary(built, str(tmp_path / "d"))
    read = dictionary.scan_dictionary(spark, str(tmp_path / "d"))
    assert {r["symbol"]: r["id"] for r in read.collect()} == want
    ids = dictionary.encode_tokens(df, "utt", "t", read)
    assert {r["utt"]: r["ids"] for r in ids.collect()} == {1: [5, 4, 4, 6], 2: [], 3: [3, 4]}
    names = dictionary.decode_ids(ids, "utt", "ids", read)
    assert {r["utt"]: r["units"] for r in names.collect()} == {1: "b a a c", 2: "", 3: "<unk> a"}


def test_large_dictionaries_are_joined_with_the_same_results(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["hot"] * 50 + [f"w{i}", None], [f"w{i}", "x"]) for i in range(60)], "utt int, t array<string>, h array<string>")
    words = dictionary.build_dictionary(df.where("utt < 50").withColumn("t", F.array_compact("t")), "t")
    twice = spark.createDataFrame([("w1", 900, 1), (None, 901, 1)], "symbol string, id int, n bigint")
    words = words.unionByName(twice)

    def results():
        coded = dictionary.encode_tokens(df, "utt", "t", words)
        names = dictionary.decode_ids(coded, "utt", "ids", words)
        checked = dictionary.check_vocabulary(df, "utt", "h", "t", words)
        return [sorted(map(str, x.collect())) for x in (coded, names, checked)]

    sent = results()
    assert "900" not in "".join(sent[0])
    monkeypatch.setattr(lookup, "TABLE_BYTES", 0)
    assert results() == sent


def test_tokens_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "utt int, t array<string>")
    words = dictionary.build_dictionary(df, "t")
    ids = dictionary.encode_tokens(df, "utt", "t", words)
    names = dictionary.decode_ids(ids, "utt", "ids", words)
    checked = dictionary.check_vocabulary(df, "utt", "t", "t", words)
    for result in (ids, names, checked):
        assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()
    assert {r["utt"]: r["units"] for r in names.collect()} == {1: "a b", 2: ""}


def test_equal_numbers_are_told_apart(monkeypatch):
    monkeypatch.setattr(lookup, "key_numbers", lambda keys: np.array([len(k) for k in keys.to_pylist()], dtype=np.int64))
    table = lookup.sorted_table(pa.array(["aa", "b", "cc", "dd"]), pa.array([1, 2, 3, 4]))
    sizes, _, values = lookup.look_up(table, pa.array([["dd", "b", "zz"], None, [None, "aa", "yyy"]]))
    assert sizes.tolist() == [3, 0, 3] and values.to_pylist() == [4, 2, None, None, 1, None]


def test_decoding_unknown_and_special_ids(spark):
    words = spark.createDataFrame([("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3), ("A", 4)], "symbol string, id int")
    ids = spark.createDataFrame([(1, [0, 4, 2, 9, 4]), (2, []), (3, None), (4, [2])], "utt int, ids array<int>")
    got = {r["utt"]: r["units"] for r in dictionary.decode_ids(ids, "utt", "ids", words).collect()}
    assert got == {1: "A <unk> A", 2: "", 3: "", 4: ""}


def test_lines_keep_their_numbers_when_splits_change(spark, tmp_path):
    """Blocks are cut differently between building and running the scan."""
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(20000)))
    before = {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.files.openCostInBytes": "4m"}
    after = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1000"}
    try:
        for built, run in ((before, after), (after, before)):
            for k, v in built.items():
                spark.conf.set(k, v)
            lines = read_lines(spark, str(tmp_path))
            for k, v in run.items():
                spark.conf.set(k, v)
            rows = lines.select("value", "line_no").collect()
            assert len(rows) == 20000 and all(r.value == f"line {r.line_no}" for r in rows)
    finally:
        for k in before:
            spark.conf.unset(k)


def test_manifest_survives_any_text(spark, tmp_path):
    texts = ["a\nb\tc\rd", "back\\slash \\n not a newline", "\\", "\n\\\n", "", " padded ", "\\\\t"]
    df = spark.createDataFrame([(i, str(i), f"p\t{i}", i, t) for i, t in enumerate(texts)], "ind bigint, id string, audio string, n_frames int, tgt_text string")
    corpus.write_manifest(df, "ind", str(tmp_path / "m"))
    got = corpus.read_manifest(spark, str(tmp_path / "m")).orderBy("ind").collect()
    assert [(r.ind, r.id, r.audio, r.n_frames, r.tgt_text) for r in got] == [(i, str(i), f"p\t{i}", i, t) for i, t in enumerate(texts)]
    assert [r.path for r in corpus.scan_manifest(spark, str(tmp_path / "m")).orderBy("ind").collect()] == [f"p\t{i}" for i in range(len(texts))]


def test_unknown_tokens_leave_the_hypothesis_only(spark):
    words = spark.createDataFrame([("a",), ("b",)], "symbol string")
    df = spark.createDataFrame([(1, ["a", "x", "b"], ["a", "y"]), (2, [], ["b"])], "utt int, h array<string>, r array<string>")
    got = {r["utt"]: (r["h"], r["n_dropped"], r["n_ref_missing"]) for r in dictionary.check_vocabulary(df, "utt", "h", "r", words).collect()}
    assert got == {1: (["a", "b"], 1, 1), 2: ([], 0, 0)}


def test_statistics(spark, tmp_path):
    rows = [(0, i, [1.0, float(i)], 0) for i in range(4)]
    frames = spark.createDataFrame(rows, features.FRAMES_SCHEMA)
    by_dim = {r["dim"]: r for r in cmvn_by_dim(frames).collect()}
    assert by_dim[0]["std"] == pytest.approx(1e-4) and by_dim[1]["std"] == pytest.approx(1.25**0.5)
    features.write_stats(cmvn_row(cmvn_by_dim(frames)), str(tmp_path / "s"))
    stats = features.read_stats(spark, str(tmp_path / "s"))
    normal = [r["feat"][1] for r in normalise(frames, stats).orderBy("frame_idx").collect()]
    assert normal == pytest.approx([(i - 1.5) / 1.25**0.5 for i in range(4)], rel=1e-6)
    assert [r["line"] for r in features.stats_lines(stats).orderBy("line_no").collect()] == ["4", "4.0 6.0 ", "4.0 14.0 "]


def test_frames_by_partition(spark, tmp_path):
    frames = spark.range(60).selectExpr(
        "id div 20 as utt_id", "cast(id % 20 as int) as frame_idx", "array(cast(id as float)) as feat", "cast(id as int) as unit"
    )
    features.write_frames(frames, str(tmp_path / "f"), partition_by=["unit"])
    assert features.read_frames(spark, str(tmp_path / "f")).count() == 60


def test_bucketed_frames_join_without_shuffle(spark, tmp_path):
    frames = spark.range(400).selectExpr(
        "id div 20 as utt_id", "cast(id % 20 as int) as frame_idx", "array(cast(id as float)) as feat", "cast(id as int) as unit"
    )
    features.save_frames_table(frames, "bucketed_frames", 4, str(tmp_path / "b"))
    try:
        grouped = spark.table("bucketed_frames").groupBy("utt_id").count()
        assert grouped.count() == 20
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE bucketed_frames")


def test_label_processor(spark, tmp_path):
    (tmp_path / "l.ltr").write_text("A B |\n")
    rows = corpus.scan_labels(spark, str(tmp_path), "ltr", -1.0, process=lambda line: F.split(F.lower(line), " "))
    assert rows.first()["tokens"] == ["a", "b", "|"]


def test_report_texts(spark, tmp_path):
    text = "WER: 4.924541828275215\nerr / num_ref_words = 2679 / 54401\n\n_name: null\nbeam: 50\n"
    (tmp_path / "wer.1").write_text(text)
    got = reports.scan_reports(spark, str(tmp_path)).first()
    assert (got["wer"], got["err"], got["n_ref"], got["config"]) == (4.924541828275215, 2679, 54401, "_name: null\nbeam: 50\n")


def test_run_files_read_back(spark, tmp_path):
    rows = [(10, "A (None-3)", "x", 1, 4), (9, "", "\u00e9 y", 0, 0), (2, "B", "", 2, 3)]
    df = spark.createDataFrame(rows, "utt bigint, h string, r string, err bigint, n_ref bigint").repartition(3)
    jobs.write_run(df, "utt", {"hypo.word": "h", "ref.word": "r"}, F.lit("beam: 50\n"), str(tmp_path / "run"))
    got = reports.read_outputs(spark, str(tmp_path / "run/outputs"), "utt").collect()
    assert {(r["kind"], r["utt"], r["text"]) for r in got} == {(k, u, t) for u, h, x, *_ in rows for k, t in (("hypo.word", h), ("ref.word", x))}
    files = sorted((tmp_path / "run/outputs/kind=hypo.word").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "B (None-2)\n (None-9)\nA (None-3) (None-10)\n"
    report = reports.read_reports(spark, str(tmp_path / "run/reports")).first()
    assert report["value"].endswith("err / num_ref_words = 3 / 7\n\nbeam: 50\n") and report["run_id"]


def test_shards_merge_in_shard_order(spark, tmp_path):
    rows = [(i, i % 3, f"line {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "ind int, shard int, line string").repartition(5)
    reports.write_shards(df, F.col("line"), "ind", str(tmp_path / "s"))
    merged = reports.merge_shards(spark, str(tmp_path / "s")).orderBy("merged_no").collect()
    assert [r["line"] for r in merged] == [f"line {i}" for s in range(3) for i in range(s, 30, 3)]
    assert [r["shard"] for r in merged] == [s for s in range(3) for _ in range(10)]


def test_hyp_ref_lines(spark):
    df = spark.createDataFrame([(7, "A B", "")], "sid int, h string, r string")
    got = {r["kind"]: r["line"] for r in reports.hyp_ref_lines(df, "sid", {"hypo.word": "h", "ref.word": "r"}).collect()}
    assert got == {"hypo.word": "A B (None-7)", "ref.word": " (None-7)"}


def test_label_offsets(spark):
    rows = [("a", 0, "xy"), ("a", 1, "é"), ("a", 2, ""), ("b", 0, "q")]
    df = spark.createDataFrame(rows, "file string, ind int, line string")
    got = {(r["file"], r["ind"]): (r["start"], r["end"]) for r in corpus.label_offsets(df, "file", "ind", "line").collect()}
    assert got == {("a", 0): (0, 2), ("a", 1): (3, 5), ("a", 2): (6, 6), ("b", 0): (0, 1)}


def test_size_filter_reaches_the_scan(spark):
    df = filters.filter_by_size(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "n_chars"), "n_chars", 200, 1562)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,200)" in plan and "LessThanOrEqual(n_chars,1562)" in plan
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_drop_null_source(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, source int")
    assert [r["id"] for r in filters.drop_null_source(df, "source").collect()] == [2]


def label_folder(tmp_path, lines_of_files):
    for k, lines in enumerate(lines_of_files):
        (tmp_path / f"part-{k:05}.txt").write_bytes(lines)
    (tmp_path / "_SUCCESS").write_text("x\n")
    (tmp_path / ".hidden").write_text("x\n")
    return str(tmp_path)


FILES = [b"one\n\ntwo three\n", b"", b"\n", "f\u00fcnf \u00e9t\u00e9\r\nlong ".encode() + b"x" * 5000 + b"\nlast", b"a\nb\n"]
LINES = ["one", "", "two three", "", "f\u00fcnf \u00e9t\u00e9", "long " + "x" * 5000, "last", "a", "b"]


@pytest.mark.parametrize("block", [1, 3, 7, 64, 1 << 20])
def test_line_ranges_whatever_the_block(spark, tmp_path, block):
    path = label_folder(tmp_path, FILES)
    rows = byte_ranges.scan_line_ranges(spark, path, block_bytes=block if block > 3 else 700 * block).collect()
    rows = sorted(rows, key=lambda r: (r["file"], r["start"]))
    assert [r["line"] for r in rows] == LINES
    for r in rows:
        assert open(r["file"], "rb").read()[r["start"] : r["end"]].rstrip(b"\r").decode() == r["line"]


def test_lines_starting_in_every_range():
    body = b"".join(FILES)
    for step in (1, 2, 5, 13):
        found = []
        for at in range(0, len(body), step):
            starts, ends, data, first = byte_ranges.lines_starting_in(_Bytes(body), at, min(at + step, len(body)), len(body))
            found += byte_ranges.line_column(data, starts - first, ends - first).to_pylist()
        assert found == body.decode().replace("\r\n", "\n").removesuffix("\n").split("\n")


class _Bytes:
    def __init__(self, body):
        self.body = body

    def read_at(self, n, at):
        return self.body[at : at + n]


def test_labels_by_offset_read_only_their_bytes(spark, tmp_path):
    lines = [f"label {k} " + "y" * (k % 50) * 40 for k in range(4000)]
    path = label_folder(tmp_path, [("\n".join(lines[:2500]) + "\n").encode(), ("\n".join(lines[2500:])).encode()])
    offsets = corpus.scan_label_offsets(spark, f"file://{path}")
    kept = offsets.where("ind % 400 = 7 OR ind > 3990").cache()
    labels = corpus.read_labels(kept, "words", 50.0)
    want = corpus.scan_labels(spark, path, "words", 50.0).join(kept, "ind", "left_semi")
    assert sorted(map(str, labels.collect())) == sorted(map(str, want.select(labels.columns).collect()))
    read = byte_ranges.read_ranges(kept).agg(F.sum("bytes_read"), F.sum(F.col("end") - F.col("start")), F.count("*")).first()
    assert read[2] == 19 and read[1] <= read[0] <= read[1] + 19 * byte_ranges.GAP
    assert read[0] < sum(len(x) for x in lines) / 20
    kept.unpersist()


def test_no_label_files(spark, tmp_path):
    path = label_folder(tmp_path, [b""])
    assert corpus.scan_label_offsets(spark, path).count() == 0
