"""Running statistics over streams of frames, scored pairs and timings.

Every counter is an additive aggregate, so a stream keeps one state row per
group and ends with what the batch form gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import finalise_cmvn
from ..operators.scoring import error_rate, score_pairs, with_rates
from ..session import scratch_path


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream a Parquet table, be it one file or a folder of files.

    The last letter as a glob class lets the source accept a single file.
    """
    path = f"{folder.rstrip('/')}/{name}"
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


Merge = Callable[[DataFrame], DataFrame]


def run_to_end(stream: DataFrame, mode: str, name: str, merge: Merge, schema: T.StructType, store: str | None = None) -> DataFrame:
    """Process all that is there and return the merged result, of ``schema``.

    ``merge`` makes one result of earlier results and a micro-batch's rows, told apart by ``version``. Each
    micro-batch merges its rows with what the one before it left and writes over the older of two slots: the result
    holds no more than the merged rows twice, and a repeated micro-batch gives the same. ``store`` is a
    folder for result and state: a later call with it goes on where the last one stopped, so read a result before
    the next call. Without one the stream starts anew.
    """
    spark = stream.sparkSession
    base = store.rstrip("/") if store else scratch_path(spark, name)
    target, state = f"{base}/rows", f"{base}/state"
    versioned = T.StructType([*schema.fields, T.StructField("version", T.LongType())])

    def keep(rows: DataFrame, batch: int) -> None:
        rows = rows.withColumn("version", F.lit(batch).cast("bigint"))
        if batch > 0:
            before = rows.sparkSession.read.schema(versioned).parquet(f"{target}/slot={(batch - 1) % 2}")
            rows = before.unionByName(rows, allowMissingColumns=True)
        merged = merge(rows).select(*schema.names, F.lit(batch).cast("bigint").alias("version"))
        merged.write.mode("overwrite").parquet(f"{target}/slot={batch % 2}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # A source without any data runs no micro-batch; this empty part makes its result readable.
    spark.createDataFrame([], versioned).write.mode("overwrite").parquet(f"{target}/slot=2")
    written = spark.read.schema(versioned).parquet(target)
    newest = written.agg(F.max("version")).first()[0]
    return written.where(F.col("version") == F.lit(newest)).select(*schema.names)


def latest(keys: list[str]) -> Merge:
    """The newest row of each key: each group is rewritten whenever it changes."""

    def merge(rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "version")]), "version")
        return rows.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*")

    return merge


def stream_latest(stream: DataFrame, keys: list[str], name: str, store: str | None) -> DataFrame:
    """The last state of each group of a streamed aggregate."""
    return run_to_end(stream, "update", name, latest(keys), stream.schema, store)


def stream_cmvn(frames: DataFrame, feat: str = "feat", store: str | None = None) -> DataFrame:
    """Normalisation statistics per dimension, kept up by a stream of frames."""
    cells = frames.select(F.posexplode(feat).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = cells.groupBy("dim").agg(
        F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq")
    )
    return finalise_cmvn(stream_latest(sums, ["dim"], "stream-cmvn", store))


def stream_error_rate(
    pairs: DataFrame,
    hyp: str,
    ref: str,
    key: str | None = None,
    at: str | None = None,
    watermark: str = "1 hour",
    store: str | None = None,
) -> DataFrame:
    """Running errors, reference words and their rate over a stream of sentence pairs.

    With ``key`` and its event time ``at``, a pair delivered again within the
    watermark counts once; the keys kept are bounded by that span.
    """
    if key is not None and at is not None:
        pairs = pairs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
        pairs = pairs.dropDuplicatesWithinWatermark([key])
    scored = score_pairs(pairs, hyp, ref)
    sums = scored.groupBy(F.lit("all").alias("run")).agg(
        F.count("*").alias("n_sent"), F.sum("err").alias("err"), F.sum("n_ref").alias("n_ref")
    )
    totals = stream_latest(sums, ["run"], "stream-wer", store)
    return totals.withColumn("wer", error_rate(F.col("err"), F.col("n_ref"))).drop("run")


def paired(
    refs: DataFrame, hyps: DataFrame, key: str, at: str, hyp: str, ref: str, within: str = "1 hour", watermark: str = "1 hour"
) -> DataFrame:
    """Streams of references and hypotheses ``(key, at, text)`` as one stream of pairs ``(key, hyp, ref)``.

    A hypothesis belongs to the reference of its key if it comes at most ``within`` before or after it. A reference
    gets an empty one when its time is over: when both streams' watermarks have passed it by ``within``.
    Rows of a key delivered again within the watermark count once. Keys and times are taken not to be NULL.
    """

    def once(rows: DataFrame, text: str, named: str, time: str) -> DataFrame:
        timed = rows.select(F.col(key).alias(named), F.col(at).cast("timestamp").alias(time), text).withWatermark(time, watermark)
        return timed.dropDuplicatesWithinWatermark([named])

    span = F.expr(f"INTERVAL {within}")
    left, right = once(refs, ref, key, "_ref_at"), once(hyps, hyp, "_key", "_hyp_at")
    near = (F.col("_hyp_at") >= F.col("_ref_at") - span) & (F.col("_hyp_at") <= F.col("_ref_at") + span)
    rows = left.join(right, (F.col(key) == F.col("_key")) & near, "left")
    return rows.select(key, F.coalesce(hyp, F.array().cast("array<string>")).alias(hyp), ref)


def stream_missing_error_rate(
    refs: DataFrame,
    hyps: DataFrame,
    key: str,
    at: str,
    hyp: str,
    ref: str,
    within: str = "1 hour",
    watermark: str = "1 hour",
    store: str | None = None,
) -> DataFrame:
    """Running errors of references and hypotheses that come as two streams, see ``paired``.

    All words of a reference whose hypothesis never comes are deletions, counted when its time is over. Before
    any pair is told the result has no rows.
    """
    scored = score_pairs(paired(refs, hyps, key, at, hyp, ref, within, watermark), hyp, ref)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("n_sent", "err", "n_ref")])

    def add(rows: DataFrame) -> DataFrame:
        totals = rows.agg(*[F.sum(c).alias(c) for c in schema.names])
        return totals.where(F.col("n_sent").isNotNull())

    one = scored.select(F.lit(1).cast("bigint").alias("n_sent"), F.col("err").cast("bigint"), F.col("n_ref").cast("bigint"))
    totals = run_to_end(one, "append", "stream-missing", add, schema, store)
    return totals.withColumn("wer", error_rate(F.col("err"), F.col("n_ref")))


def stream_throughput(
    timings: DataFrame,
    at: str,
    tokens: str,
    seconds: str,
    window: str = "1 hour",
    watermark: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Sentences, tokens and rates per tumbling window of event time.

    With a watermark, windows older than it leave the state and later rows for
    them are lost; without one every row counts and the state grows with time.
    """
    if watermark is not None:
        # Watermarks are kept on timestamps with a time zone.
        timings = timings.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    sums = (
        timings.groupBy(F.window(at, window).alias("w"))
        .agg(F.count("*").alias("sentences"), F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))
        .select(F.col("w.start").alias("window_start"), "sentences", "tokens", "seconds")
    )
    totals = stream_latest(sums, ["window_start"], "stream-throughput", store)
    return with_rates(totals)
