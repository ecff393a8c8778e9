"""Streams over several files end with what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.operators.features import cmvn_by_dim
from phonolake.operators.scoring import corpus_error_rate, score_pairs, throughput
from phonolake.plans import standins
from phonolake.streaming import running

FOLDER = "/root/testdata/sf0.001"


def split_table(spark, tmp_path, name):
    """The table as a folder of four files, streamed one file per micro-batch."""
    whole = standins.table(spark, FOLDER, name)
    whole.repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    path = str(tmp_path / f"{name}.parque[t]")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return whole, stream


def test_statistics(spark, tmp_path):
    whole, stream = split_table(spark, tmp_path, "embeddings")
    got = {r["dim"]: r for r in running.stream_cmvn(standins.as_frames(stream)).collect()}
    want = {r["dim"]: r for r in cmvn_by_dim(standins.as_frames(whole)).collect()}
    assert got.keys() == want.keys()
    for dim, row in want.items():
        assert got[dim]["n"] == row["n"] and abs(got[dim]["sum"] - row["sum"]) < 1e-9
        assert abs(got[dim]["std"] - row["std"]) < 1e-6


def test_error_rate(spark, tmp_path):
    whole, stream = split_table(spark, tmp_path, "conversations")
    got = running.stream_error_rate(standins.as_hyp_ref(standins.as_turns(stream)), "hyp", "ref").first().asDict()
    want = corpus_error_rate(score_pairs(standins.as_hyp_ref(standins.as_turns(whole)), "hyp", "ref")).first().asDict()
    assert got == want


def test_throughput(spark, tmp_path):
    whole, stream = split_table(spark, tmp_path, "events")
    got = running.stream_throughput(standins.timings(stream), "ts", "tokens", "seconds").collect()
    rows = standins.timings(whole).withColumn("w", F.window("ts", "1 hour")["start"])
    want = {r["w"]: r for r in throughput(rows, "tokens", "seconds", ["w"]).collect()}
    assert {r["window_start"] for r in got} == set(want)
    for r in got:
        assert (r["sentences"], r["tokens"]) == (want[r["window_start"]]["sentences"], want[r["window_start"]]["tokens"])
        assert abs(r["seconds"] - want[r["window_start"]]["seconds"]) < 1e-9


def test_redelivered_pairs_count_once(spark, tmp_path):
    rows = spark.range(40).selectExpr(
        "id % 20 as utt", "timestamp_seconds(1700000000 + id % 20) as at", "array('a', 'b') as hyp", "array('a', 'c', 'd') as ref"
    )
    rows.repartition(4).write.parquet(str(tmp_path / "pairs"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pairs"))
    got = running.stream_error_rate(stream, "hyp", "ref", key="utt", at="at").first()
    assert (got["n_sent"], got["err"], got["n_ref"]) == (20, 40, 60)
    again = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pairs"))
    assert running.stream_error_rate(again, "hyp", "ref").first()["n_sent"] == 40


def test_watermark_keeps_rows_in_time(spark, tmp_path):
    whole, stream = split_table(spark, tmp_path, "events")
    got = running.stream_throughput(standins.timings(stream), "ts", "tokens", "seconds", watermark="60 days")
    assert got.agg(F.sum("sentences")).first()[0] == whole.count()


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.range(60).selectExpr("id as utt", "IF(id % 5 = 0, NULL, array('a', 'b')) as hyp", "array('a', 'c', 'd') as ref")
    folder, store = str(tmp_path / "pairs"), str(tmp_path / "store")
    want = []
    for part in range(3):
        rows.where(f"utt % 3 = {part}").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        got = running.stream_error_rate(stream, "hyp", "ref", store=store).first()
        want = corpus_error_rate(score_pairs(rows.where(f"utt % 3 <= {part}"), "hyp", "ref")).first()
        assert got.asDict() == want.asDict()
    again = spark.readStream.schema(rows.schema).parquet(folder)
    assert running.stream_error_rate(again, "hyp", "ref", store=store).first().asDict() == want.asDict()


def test_result_has_one_row_a_key_after_many_micro_batches(spark, tmp_path):
    folder, store = str(tmp_path / "frames"), str(tmp_path / "store")
    frames = spark.range(120).selectExpr("array(cast(id as float), cast(-id as float)) as feat")
    frames.repartition(12).write.parquet(folder)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r["dim"]: r for r in running.stream_cmvn(stream, store=store).collect()}
    assert {d: (r["n"], r["sum"]) for d, r in got.items()} == {0: (120, 7140.0), 1: (120, -7140.0)}
    for slot in (0, 1):
        assert spark.read.parquet(f"{store}/rows/slot={slot}").count() == 2


def test_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("feat array<float>").parquet(str(tmp_path / "none"))
    assert running.stream_cmvn(stream).count() == 0


def test_redelivered_and_missing_hypotheses(spark, tmp_path):
    """Two streams in several micro-batches; references 0, 5, 10 ... never get a hypothesis."""
    refs = spark.range(60).selectExpr("id as utt", "timestamp_seconds(1700000000 + id * 600) as at", "array('a', 'c', 'd') as ref")
    hyps = refs.where("utt % 5 <> 0").selectExpr(
        "utt", "at + INTERVAL 5 MINUTES as at", "IF(utt % 2 = 0, array('a', 'b'), array('a', 'c', 'd')) as hyp"
    )
    store = str(tmp_path / "store")

    def told():
        streams = [
            spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
            for name, x in (("refs", refs), ("hyps", hyps))
        ]
        return running.stream_missing_error_rate(*streams, "utt", "at", "hyp", "ref", store=store)

    def wanted(missing_before):
        known = refs.join(hyps.select("utt", "hyp"), "utt", "left").where(f"hyp IS NOT NULL OR utt < {missing_before}")
        full = known.withColumn("hyp", F.coalesce("hyp", F.array().cast("array<string>")))
        return corpus_error_rate(score_pairs(full, "hyp", "ref")).first().asDict()

    refs.coalesce(1).write.parquet(str(tmp_path / "refs"))
    hyps.coalesce(1).write.parquet(str(tmp_path / "hyps"))
    hyps.coalesce(1).write.mode("append").parquet(str(tmp_path / "hyps"))
    # The watermark is an hour before the last of either stream (59 * 600 s); a reference waits an hour more.
    assert told().first().asDict() == wanted(47)
    late = "timestamp_seconds(1700000000 + 1000000) as at"
    refs.limit(1).selectExpr("1000L as utt", late, "ref").write.mode("append").parquet(str(tmp_path / "refs"))
    hyps.limit(1).selectExpr("1000L as utt", late, "array('a', 'c', 'd') as hyp").write.mode("append").parquet(str(tmp_path / "hyps"))
    got, want = told().first().asDict(), wanted(60)
    assert (got["n_sent"], got["err"], got["n_ref"]) == (want["n_sent"] + 1, want["err"], want["n_ref"] + 3)
