"""The query catalogue: one entry per operator, over the stand-in views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..functions import text as txt
from ..operators import batching, ctc, features, filters, masking, ordering, scoring, selection, signal
from ..session import materialise, scratch_path
from ..sources import corpus, dictionary, reports
from ..sources import features as stored
from ..streaming import running
from . import jobs, standins
from .standins import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOGUE[fn.__name__] = fn
    return fn


def joined(values: str | Column, sep: str = " ") -> Column:
    """An array as text, so that results compare as plain values."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def bits(mask: str | Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.when(m, "1").otherwise("0")), "")


def rounded(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column).cast("double"), digits).alias(column)


def by_time() -> list[Column]:
    return [F.col(c).asc() for c in standins.SIGNAL_ORDER]


# --- sources and sinks -------------------------------------------------------------------------


@query
def scan_audio_list(spark, folder):
    docs = table(spark, folder, "documents")
    line = F.concat(standins.audio_path(), F.lit(" "), F.col("text"))
    return corpus.parse_audio_list(docs.select(line.alias("value")))


def _manifest_rows(spark, folder):
    return standins.manifest(spark, folder).select(
        "ind",
        F.col("ind").cast("string").alias("id"),
        F.col("path").alias("audio"),
        "n_frames",
        "tgt_text",
    )


@query
def scan_manifest(spark, folder):
    path = scratch_path(spark, "manifest")
    corpus.write_manifest(_manifest_rows(spark, folder), "ind", path)
    return corpus.scan_manifest(spark, path)


@query
def manifest_roundtrip(spark, folder):
    path = scratch_path(spark, "manifest-whole")
    corpus.write_manifest(_manifest_rows(spark, folder), "ind", path)
    return corpus.read_manifest(spark, path)


@query
def manifest_lines(spark, folder):
    return corpus.manifest_lines(_manifest_rows(spark, folder), "ind")


@query
def scan_labels(spark, folder):
    path = scratch_path(spark, "labels")
    rows = standins.manifest(spark, folder).select("ind", "tgt_text")
    corpus.write_lines(rows, txt.squeeze(F.col("tgt_text")), [F.col("ind").asc()], path)
    labels = corpus.scan_labels(spark, path, "words", -1.0)
    return labels.select("label_set", "ind", F.size("tokens").alias("n_tokens"), joined("tokens").alias("tokens"))


@query
def label_offsets(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", "text")
    return corpus.label_offsets(docs, "source", "doc_id", "text")


@query
def labels_by_offset(spark, folder):
    """The labels of long enough samples only, read by their places in the files."""
    path = scratch_path(spark, "labels")
    rows = standins.manifest(spark, folder).select("ind", "n_frames", "tgt_text")
    corpus.write_lines(rows, txt.squeeze(F.col("tgt_text")), [F.col("ind").asc()], path)
    kept = filters.filter_by_size(rows.select("ind", "n_frames"), "n_frames", 1000, 5000)
    places = corpus.scan_label_offsets(spark, path).join(kept.select("ind"), "ind", "left_semi")
    labels = corpus.read_labels(places, "words", -1.0)
    return labels.select("label_set", "ind", F.size("tokens").alias("n_tokens"), joined("tokens").alias("tokens"))


def _dictionary(spark, folder, min_count=1):
    return materialise(
        dictionary.build_dictionary(standins.hyp_ref(spark, folder), "ref", min_count), "dictionary"
    )


@query
def build_dictionary(spark, folder):
    return dictionary.build_dictionary(standins.hyp_ref(spark, folder), "ref")


@query
def scan_dictionary(spark, folder):
    path = scratch_path(spark, "dictionary-text")
    dictionary.write_dictionary(_dictionary(spark, folder, 1), path)
    return dictionary.scan_dictionary(spark, path).select("symbol", "id")


@query
def frames_roundtrip(spark, folder):
    path = scratch_path(spark, "frames")
    stored.write_frames(standins.frames(spark, folder), path)
    total = F.aggregate("feat", F.lit(0.0), lambda acc, x: acc + x)
    return stored.read_frames(spark, path).select(
        "utt_id", "frame_idx", F.size("feat").alias("n_dims"), F.round(total, 6).alias("total"), "unit"
    )


OUTPUTS = {"hypo.word": "hypo_word", "hypo.units": "hypo_units", "ref.word": "ref_word", "ref.units": "ref_units"}


def _written_run(spark, folder):
    """The four outputs and the report of a scored run, as files."""
    texts = {
        "hypo_word": F.array_join("hyp", " "),
        "hypo_units": F.array_join(standins.to_pieces("hyp"), " "),
        "ref_word": F.array_join("ref", " "),
        "ref_units": F.array_join(standins.to_pieces("ref"), " "),
    }
    path = scratch_path(spark, "run")
    scored = materialise(_scored(spark, folder), "scored").withColumns(texts)
    jobs.write_run(scored, "utt_id", OUTPUTS, F.lit("nbest: 1\ntype: viterbi"), path)
    return path


@query
def hyp_ref_lines(spark, folder):
    path = _written_run(spark, folder)
    return reports.read_outputs(spark, f"{path}/outputs", "utt_id").select("kind", "utt_id", "line")


@query
def merge_shards(spark, folder):
    path = scratch_path(spark, "shards")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("utt_id"), "text")
    line = reports.hyp_ref_line(txt.squeeze(F.col("text")), F.col("utt_id"))
    reports.write_shards(ordering.shard_of_batch(docs, 4, batch="utt_id"), line, "utt_id", path)
    return reports.merge_shards(spark, path)


def _run_reports(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("err"), F.count("*").alias("n_ref")
    )
    rate = scoring.error_rate(F.col("err"), F.col("n_ref"))
    config = F.concat(F.lit("status: "), F.col("o_orderstatus"), F.lit("\nbeam: 50"))
    return counts.select(
        "o_orderstatus", reports.report_text(rate, F.col("err"), F.col("n_ref"), config).alias("value")
    )


@query
def parse_reports(spark, folder):
    return reports.parse_reports(_run_reports(spark, folder))


@query
def wer_report(spark, folder):
    path = _written_run(spark, folder)
    return reports.read_reports(spark, f"{path}/reports").withColumnRenamed("value", "report")


# --- projections and filters -------------------------------------------------------------------


@query
def filter_by_size(spark, folder):
    rows = standins.manifest(spark, folder).select("ind", "path", "n_frames")
    return filters.filter_by_size(rows, "n_frames", 200, 1562)


@query
def size_rejects(spark, folder):
    rows = standins.manifest(spark, folder).select("ind", "n_frames")
    return filters.size_rejects(rows, "n_frames", 200, 1562)


@query
def drop_null_source(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    sources = docs.join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", F.col("quality").alias("source"))
    return filters.drop_null_source(sources, "source")


@query
def strip_special(spark, folder):
    units = F.col("units")
    return standins.unit_arrays(spark, folder).select(
        "utt_id",
        joined(seq.strip_ids(units, dictionary.PAD, dictionary.EOS)).alias("no_pad_eos"),
        joined(seq.strip_ids(units, dictionary.PAD)).alias("no_pad"),
    )


@query
def effective_size(spark, folder):
    n = F.col("n_frames")
    return standins.manifest(spark, folder).select(
        "ind",
        seq.effective_size(n, 1562, pad_audio=True).alias("padded_size"),
        seq.effective_size(n, 1562, pad_audio=False).alias("cropped_size"),
    )


@query
def subsampled_length(spark, folder):
    return standins.manifest(spark, folder).select(
        "ind", "n_frames", seq.subsampled_length(F.col("n_frames")).alias("n_sub")
    )


@query
def get_or_last(spark, folder):
    return selection.get_or_last(standins.signals(spark, folder), "user_id", by_time(), "value", [3, 11, 60, 100])


@query
def input_lengths(spark, folder):
    mask = F.transform("units", lambda u: u == 0)
    first = F.get("units", F.lit(0))
    rows = standins.unit_arrays(spark, folder).select(
        "utt_id",
        F.when(first < 3, F.lit(15)).alias("given"),
        F.when(first < 7, mask).alias("mask"),
        F.size("units").alias("n"),
    )
    return rows.select("utt_id", seq.input_length(F.col("given"), F.col("mask"), F.col("n")).alias("input_length"))


# --- joins -------------------------------------------------------------------------------------


@query
def align_labels(spark, folder):
    rows = standins.manifest(spark, folder).select("ind", "path", "n_frames")
    kept = filters.filter_by_size(rows, "n_frames", 200)
    return filters.align_labels(kept, standins.line_labels(spark, folder))


@query
def label_count_check(spark, folder):
    return filters.label_count_check(standins.manifest(spark, folder), standins.line_labels(spark, folder))


@query
def multi_label(spark, folder):
    return filters.multi_label(
        standins.line_labels(spark, folder), "ind", "label_set", "value", standins.LABEL_SETS
    )


def _encoded(spark, folder, words):
    return dictionary.encode_tokens(standins.hyp_ref(spark, folder), "utt_id", "ref", words)


@query
def encode_tokens(spark, folder):
    return _encoded(spark, folder, _dictionary(spark, folder, 2)).select("utt_id", joined("ids").alias("ids"))


@query
def decode_ids(spark, folder):
    words = _dictionary(spark, folder, 2)
    return dictionary.decode_ids(_encoded(spark, folder, words), "utt_id", "ids", words)


@query
def decode_ids_unknown(spark, folder):
    """Begin, an id of no symbol and end around every utterance."""
    words = _dictionary(spark, folder, 2)
    ids = F.concat(F.array(F.lit(dictionary.BOS)), "ids", F.array(F.lit(1 << 30), F.lit(dictionary.EOS)))
    return dictionary.decode_ids(_encoded(spark, folder, words).withColumn("ids", ids), "utt_id", "ids", words)


@query
def drop_oov(spark, folder):
    words = _dictionary(spark, folder, 2)
    checked = dictionary.check_vocabulary(standins.hyp_ref(spark, folder), "utt_id", "hyp", "ref", words)
    return checked.withColumn("hyp", F.array_join("hyp", " "))


@query
def apply_cmvn(spark, folder):
    path = scratch_path(spark, "stats")
    frames = standins.frames(spark, folder)
    stored.write_stats(features.cmvn_row(features.cmvn_by_dim(frames)), path)
    normal = features.normalise(frames, stored.read_stats(spark, path))
    cells = normal.select("utt_id", "frame_idx", F.posexplode_outer("feat").alias("dim", "x"))
    return cells.withColumn("x", rounded("x", 4))


# --- aggregations ------------------------------------------------------------------------------


def _rounded_stats(stats):
    return stats.select("dim", "n", *[rounded(c) for c in ("sum", "sumsq", "mean", "std")])


@query
def cmvn_stats(spark, folder):
    return _rounded_stats(features.cmvn_by_dim(standins.frames(spark, folder)))


@query
def cmvn_stats_text(spark, folder):
    stats = features.cmvn_row(features.cmvn_by_dim(standins.frames(spark, folder)))
    return stored.stats_lines(stats, decimals=4)


@query
def load_summary(spark, folder):
    return filters.load_summary(standins.manifest(spark, folder), "n_frames", 200, 1562)


MAX_TOKENS, MAX_SENTENCES = 40_000, 32


def _bucketed(spark, folder):
    rows = standins.manifest(spark, folder).select("ind", "n_frames")
    return batching.batch_by_bucket(rows, "ind", "n_frames", MAX_TOKENS, MAX_SENTENCES)


@query
def batch_by_bucket(spark, folder):
    return _bucketed(spark, folder)


@query
def batch_greedy(spark, folder):
    rows = standins.manifest(spark, folder).select("ind", "n_frames")
    return batching.batch_greedy(rows, "ind", "n_frames", MAX_TOKENS, MAX_SENTENCES, multiple=8)


@query
def batch_target_size(spark, folder):
    batched = materialise(_bucketed(spark, folder), "batches")
    padded = batching.batch_target_size(batched, "n_frames", 1562, pad_audio=True)
    cropped = batching.batch_target_size(batched, "n_frames", 1562, pad_audio=False)
    return padded.withColumnRenamed("target_size", "padded_size").join(
        cropped.select("batch_id", F.col("target_size").alias("cropped_size")), "batch_id"
    )


def _word_batches(spark, folder):
    """Documents batched by their word count, 64-word buckets."""
    sizes = materialise(standins.document_words(spark, folder).select("doc_id", "n_words"), "sizes")
    return batching.batch_by_bucket(sizes, "doc_id", "n_words", 8000, 32, width=64).drop("bucket")


@query
def batch_counts(spark, folder):
    words = standins.document_words(spark, folder).join(_word_batches(spark, folder).drop("n_words"), "doc_id")
    sets = F.array(
        F.struct(F.lit("word").alias("label_set"), F.col("words").alias("tokens")),
        F.struct(F.lit("long").alias("label_set"), F.filter("words", lambda w: F.length(w) > 3).alias("tokens")),
    )
    labels = words.select("batch_id", "doc_id", F.inline(sets))
    counted = batching.batch_counts(labels, "doc_id")
    return counted.withColumn("ids", joined("ids")).withColumn("target_lengths", joined("target_lengths"))


@query
def loss_report(spark, folder):
    rows = standins.logits(spark, folder).where(~F.col("padded"))
    scored = scoring.with_frame_loss(rows, "logits", "target", temperature=0.1)
    power = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    report = scoring.loss_report(
        scored.withColumn("features_pen", power), masked_weight=1.0, unmasked_weight=0.5, log_keys={"features_pen": "avg"}
    )
    return report.select(
        *[rounded(c) for c in ("loss", "loss_m", "loss_u", "features_pen")],
        "sample_size", "count_m", "count_u", "correct_m", "correct_u",
    )


@query
def masked_accuracy(spark, folder):
    rows = standins.logits(spark, folder).where(~F.col("padded"))
    scored = scoring.with_frame_loss(rows, "logits", "target")
    return scoring.masked_accuracy(scored).withColumn("accuracy", rounded("accuracy"))


def _scored(spark, folder):
    return scoring.score_pairs(standins.hyp_ref(spark, folder), "hyp", "ref")


@query
def wer_per_sentence(spark, folder):
    return _scored(spark, folder).select("utt_id", "err", "n_ref")


@query
def wer_missing_hyp(spark, folder):
    """Every fifth hypothesis is missing: all its words are deleted."""
    pairs = standins.hyp_ref(spark, folder)
    heard = pairs.where("utt_id % 5 <> 0").select("utt_id", "hyp")
    gaps = pairs.select("utt_id", "ref").join(heard, "utt_id", "left")
    return scoring.score_pairs(gaps, "hyp", "ref").select("utt_id", "err", "n_ref")


def corpus_wer_totals(spark, folder):
    return scoring.corpus_error_rate(_scored(spark, folder))


@query
def corpus_wer(spark, folder):
    return corpus_wer_totals(spark, folder).withColumn("wer", rounded("wer"))


@query
def error_totals(spark, folder):
    pairs = standins.hyp_ref(spark, folder)
    cut = pairs.withColumn("hyp_units", standins.to_pieces("hyp")).withColumn("ref_units", standins.to_pieces("ref"))
    # An empty hypothesis has no words; an empty reference has one empty word.
    spoken = F.when(F.size("hyp_units") > 0, txt.tokens_strict(txt.pieces_to_words(F.array_join("hyp_units", " "))))
    words = cut.withColumn("hyp_words", F.coalesce(spoken, F.array().cast("array<string>"))).withColumn(
        "ref_words", txt.tokens_strict(txt.pieces_to_words(F.array_join("ref_units", " ")))
    )
    # The longer turns come with words of an outer decoder.
    decoded = F.when(F.size("ref") > 20, F.filter("hyp", lambda t: t != "<x>"))
    totals = scoring.error_totals(
        words.withColumn("decoded", decoded),
        ("hyp_units", "ref_units"),
        ("hyp_words", "ref_words"),
        "role",
        "decoded",
    )
    rates = [rounded(c) for c in ("uer", "wer", "raw_wer")]
    sums = ["c_errors", "c_total", "w_errors", "w_total", "wv_errors"]
    return totals.select(F.coalesce("role", F.lit("ALL")).alias("role"), "is_total", *sums, *rates)


@query
def throughput(spark, folder):
    rows = standins.timings(table(spark, folder, "events"))
    rates = scoring.throughput(rows, "tokens", "seconds", ["event_type"])
    return rates.select(
        "event_type", "sentences", "tokens", *[rounded(c) for c in ("seconds", "sentences_per_s", "tokens_per_s")]
    )


# --- ordered scans -----------------------------------------------------------------------------


@query
def collapse_repeats_window(spark, folder):
    rows = standins.frames(spark, folder).select("utt_id", "frame_idx", "unit")
    return selection.collapse_repeats(rows, "utt_id", [F.col("frame_idx").asc()], "unit")


@query
def shard_assign(spark, folder):
    batches = _bucketed(spark, folder).groupBy("batch_id").agg(F.count("*").alias("nsentences"))
    return ordering.shard_of_batch(batches, 8)


@query
def best_hypothesis(spark, folder):
    nbest = table(spark, folder, "events").select("user_id", "event_id", "value", "event_type")
    return scoring.best_hypothesis(nbest, "user_id", "value", "event_id", ["event_type"])


FRAME_WIDTH, FRAME_HOP = 8, 4
SIGNAL_HOPS = 64


def _chunks(spark, folder, width, hop):
    """Signals as chunked waveforms, small chunks so that signals have several."""
    return signal.chunk_samples(standins.signals(spark, folder), "user_id", by_time(), "value", width, hop, SIGNAL_HOPS)


@query
def frame_signal(spark, folder):
    chunks = _chunks(spark, folder, FRAME_WIDTH, FRAME_HOP)
    energy = signal.energy_of_chunks(chunks, "user_id", FRAME_WIDTH, FRAME_HOP, SIGNAL_HOPS)
    return energy.withColumn("energy", rounded("energy", 4))


@query
def ordered_indices(spark, folder):
    rows = standins.manifest(spark, folder).select("ind", "n_frames")
    return ordering.ordered_indices(rows, "ind", "n_frames")


@query
def epoch_order(spark, folder):
    return ordering.epoch_order(standins.manifest(spark, folder).select("ind"), "ind", seed=1337, epoch=2)


# --- set operations ----------------------------------------------------------------------------


@query
def duplicate_rows(spark, folder):
    return scoring.duplicate_rows(standins.logits(spark, folder).select("vec_id", "target"))


@query
def concat_heads(spark, folder):
    rows = standins.logits(spark, folder).select("vec_id", "logits", "target", "masked")
    heads = [rows, rows.withColumn("logits", F.reverse("logits"))]
    return scoring.concat_heads(heads).select(
        "head", "vec_id", "target", "masked", seq.argmax(F.col("logits")).alias("best")
    )


@query
def mask_partition(spark, folder):
    return scoring.mask_partition(standins.logits(spark, folder)).select("vec_id", "part")


# --- text --------------------------------------------------------------------------------------


@query
def pieces_to_words(spark, folder):
    units = F.array_join(standins.to_pieces("ref"), " ")
    return standins.hyp_ref(spark, folder).select("utt_id", txt.pieces_to_words(units).alias("words"))


@query
def letters_to_words(spark, folder):
    turns = standins.as_turns(table(spark, folder, "conversations"))
    rows = turns.select("utt_id", "role", txt.tokens(F.col("text")).alias("words"))
    letters = F.array_join(F.split(F.array_join("words", "|"), ""), " ")
    lettered = rows.withColumn("units", F.concat(letters, F.lit(" |")))
    # User turns are letters; the others are read as phones, whose units are the words.
    kind = F.when(F.col("role") == "user", "ltr").otherwise("phn")
    return lettered.select("utt_id", txt.units_to_words(F.col("units"), kind).alias("words"))


@query
def tokenise(spark, folder):
    text = F.col("text")
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.size(txt.tokens(text)).alias("n_words"),
        F.size(txt.tokens_strict(text)).alias("n_strict"),
        F.array_join(txt.tokens(text), "|").alias("words"),
    )


@query
def run_fingerprint(spark, folder):
    return table(spark, folder, "documents").select("doc_id", txt.fingerprint(F.col("text")).alias("run_id"))


# --- sequences ---------------------------------------------------------------------------------


@query
def frame_argmax(spark, folder):
    return standins.logits(spark, folder).select("vec_id", seq.argmax(F.col("logits")).alias("best"))


@query
def best_path(spark, folder):
    return standins.unit_arrays(spark, folder).select("utt_id", joined(seq.best_path(F.col("units"))).alias("path"))


def _input_length() -> Column:
    return (20 - F.col("utt_id") % 7).cast("int")


@query
def best_path_cut(spark, folder):
    path = seq.best_path(F.col("units"), length=_input_length())
    return standins.unit_arrays(spark, folder).select("utt_id", joined(path).alias("path"))


@query
def crop_sequences(spark, folder):
    target = 64
    rows = standins.document_words(spark, folder)
    spare = F.greatest(F.col("n_words") - target, F.lit(0))
    placed = rows.withColumn("start", (F.col("doc_id") % (spare + 1)).cast("int"))
    return placed.select(
        "doc_id", "n_words", "start", F.array_join(seq.crop(F.col("words"), target, F.col("start")), " ").alias("words")
    )


def _crop_start(key: str, size: str, target: str) -> Column:
    return F.col(key) % (F.greatest(F.col(size) - F.col(target), F.lit(0)) + 1)


def _batched_words(spark, folder, max_sample_size, pad_audio):
    planned = _word_batches(spark, folder)
    targeted = batching.with_target_size(planned, "n_words", max_sample_size, pad_audio)
    return standins.document_words(spark, folder).join(targeted.drop("n_words"), "doc_id")


@query
def pad_and_mask(spark, folder):
    rows = _batched_words(spark, folder, 256, pad_audio=True)
    lengths = rows.withColumn("source", F.transform("words", F.length))
    start = _crop_start("doc_id", "n_words", "target_size")
    padded = batching.pad_and_mask(lengths, "source", "target_size", start, F.lit(0), pad_audio=True)
    return padded.select(
        "batch_id", "doc_id", "start", joined("source").alias("source"), bits("padding_mask").alias("padding_mask")
    )


@query
def align_frame_labels(spark, folder):
    rows = _batched_words(spark, folder, 256, pad_audio=False)
    every_other = F.filter(F.transform("words", F.length), lambda x, i: i % 2 == 0)
    start = _crop_start("doc_id", "n_words", "target_size").cast("int")
    labelled = rows.withColumn("labels", every_other).withColumn("start", start)
    aligned = batching.align_frame_labels(
        labelled, "labels", "target_size", "start", 50.0, 100.0, pad_id=dictionary.PAD, pad_audio=False
    )
    return aligned.select("batch_id", "doc_id", "label_start", "target_length", joined("target").alias("target"))


@query
def pad_sequence_labels(spark, folder):
    rows = _batched_words(spark, folder, None, pad_audio=True)
    labelled = rows.withColumn("labels", F.transform("words", F.length)).withColumn("start", F.lit(0))
    aligned = batching.align_frame_labels(
        labelled, "labels", "target_size", "start", -1.0, 100.0, pad_id=dictionary.PAD, pad_audio=True
    )
    return aligned.select("batch_id", "doc_id", "target_length", joined("target").alias("target"))


@query
def stride_labels(spark, folder):
    rows = standins.document_words(spark, folder).select("doc_id", F.transform("words", F.length).alias("labels"))
    n_sub = seq.subsampled_length(F.size("labels"), (5,)).cast("int")
    return rows.select(
        "doc_id",
        seq.strided_length(F.col("labels"), n_sub, 2).alias("n_frames"),
        joined(seq.stride_labels(F.col("labels"), n_sub, 2)).alias("target"),
    )


@query
def cross_entropy(spark, folder):
    rows = standins.logits(spark, folder)
    loss = seq.cross_entropy(F.col("logits"), F.col("target"), 0.1)
    return rows.select("vec_id", F.round(loss, 6).alias("nll"))


def _gathered_log_probs(spark, folder, length=None):
    rows = standins.frames(spark, folder).select("utt_id", "frame_idx", seq.log_softmax(F.col("feat")).alias("lp"), "unit")
    ordered = F.sort_array(F.collect_list(F.struct("frame_idx", "lp", "unit")))
    gathered = rows.groupBy("utt_id").agg(ordered.alias("rows"))
    arrays = gathered.select(
        "utt_id", F.transform("rows", lambda r: r["lp"]).alias("log_probs"), F.transform("rows", lambda r: r["unit"]).alias("units")
    )
    return arrays.select("utt_id", "log_probs", seq.best_path(F.col("units"), length=length).alias("target"))


def _ctc_scored(spark, folder):
    arrays = _gathered_log_probs(spark, folder)
    return ctc.ctc_score(arrays, "utt_id", "log_probs", "target", zero_infinity=True)


@query
def ctc_score(spark, folder):
    return _ctc_scored(spark, folder).select("utt_id", rounded("nll"))


@query
def ctc_score_cut(spark, folder):
    arrays = _gathered_log_probs(spark, folder, _input_length()).withColumn("n", _input_length())
    scored = ctc.ctc_score(arrays, "utt_id", "log_probs", "target", zero_infinity=True, length="n")
    return scored.select("utt_id", rounded("nll"))


@query
def ctc_loss_report(spark, folder):
    report = scoring.sequence_loss_report(_ctc_scored(spark, folder), "nll", "n_tokens", sentence_avg=False)
    return report.withColumn("loss", rounded("loss", 5))


def _label_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "text")
    words = docs.select(
        F.col("doc_id").alias("ind"), F.col("n_chars").alias("n_frames"), F.size(txt.tokens(F.col("text"))).alias("n_words")
    )
    sets = F.array(
        F.struct(F.lit("phn").alias("label_set"), F.lit(20.0).alias("label_rate")),
        F.struct(F.lit("wp").alias("label_set"), F.lit(-1.0).alias("label_rate")),
    )
    return words.select("ind", "n_frames", "n_words", F.inline(sets))


def _verified(spark, folder):
    return filters.verify_label_lengths(_label_rows(spark, folder), "n_frames", 100.0, "n_words", "label_rate")


@query
def verify_label_lengths(spark, folder):
    return _verified(spark, folder).select("ind", "label_set", rounded("gap_s"), "mismatch")


@query
def label_length_summary(spark, folder):
    return filters.label_length_summary(_verified(spark, folder)).withColumn("max_gap_s", rounded("max_gap_s"))


@query
def pool_padding_mask(spark, folder):
    rows = standins.document_words(spark, folder).select(
        "doc_id", F.transform("words", lambda w: F.length(w) < 5).alias("mask")
    )
    n_sub = seq.subsampled_length(F.size("mask")).cast("int")
    return rows.select("doc_id", bits(seq.pool_padding_mask(F.col("mask"), n_sub)).alias("mask"))


@query
def span_mask(spark, folder):
    rows = standins.document_words(spark, folder).select("doc_id", "n_words")
    masked = masking.span_mask(rows, "doc_id", "n_words", 0.8, seed=1337)
    return masked.select("doc_id", F.size("masked").alias("n_masked"), joined("masked").alias("masked"))


@query
def spec_augment(spark, folder):
    rows = standins.frames(spark, folder).select("utt_id", "frame_idx", "feat")
    masked = masking.spec_augment(rows, "utt_id", "frame_idx", "feat", n_dims=64, seed=1337)
    cells = masked.select("utt_id", "frame_idx", F.posexplode_outer("feat").alias("dim", "x"))
    return cells.withColumn("x", rounded("x"))


def _waveforms(spark, folder):
    """Embeddings as two-channel waveforms, mixed down and scaled."""
    channels = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    rows = table(spark, folder, "embeddings").select("vec_id", channels.alias("channels"))
    return rows.select("vec_id", seq.to_16_bit(seq.to_mono(F.col("channels"))).alias("samples"))


@query
def to_mono(spark, folder):
    mono = _waveforms(spark, folder)
    return mono.select("vec_id", F.posexplode_outer("samples").alias("sample_idx", "sample")).withColumn("sample", rounded("sample"))


@query
def resample_series(spark, folder):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = standins.signals(spark, folder).withColumn("at", seconds)
    grid = signal.resample_series(rows, "user_id", "at", "value", 3600)
    return grid.withColumn("value", rounded("value", 9))


MEL_WIDTH, MEL_HOP, N_MELS, SAMPLE_RATE = 16, 8, 4, 16000.0


def _log_mel(spark, folder):
    chunks = _chunks(spark, folder, MEL_WIDTH, MEL_HOP)
    return signal.log_mel_of_chunks(chunks, "user_id", SAMPLE_RATE, MEL_WIDTH, MEL_HOP, N_MELS, SIGNAL_HOPS)


@query
def log_mel(spark, folder):
    cells = _log_mel(spark, folder).select("user_id", "frame_idx", F.posexplode_outer("feat").alias("mel", "x"))
    return cells.withColumn("x", rounded("x"))


@query
def waveform_features(spark, folder):
    chunks = signal.chunk_waveforms(_waveforms(spark, folder), "vec_id", "samples", MEL_WIDTH, MEL_HOP, 3)
    feats = signal.log_mel_of_chunks(chunks, "vec_id", SAMPLE_RATE, MEL_WIDTH, MEL_HOP, N_MELS, 3)
    cells = feats.select("vec_id", "frame_idx", F.posexplode_outer("feat").alias("mel", "x"))
    return cells.withColumn("x", rounded("x"))


# --- streams -----------------------------------------------------------------------------------


def _stream(spark, folder, name):
    return running.read_table_stream(spark, folder, f"{name}.parquet", table(spark, folder, name).schema)


@query
def stream_cmvn(spark, folder):
    frames = standins.as_frames(_stream(spark, folder, "embeddings"))
    return _rounded_stats(running.stream_cmvn(frames))


def _timed_pairs(spark, folder, copies):
    """Pairs with an event time, each delivered several times."""
    pairs = standins.as_hyp_ref(standins.as_turns(_stream(spark, folder, "conversations")))
    return pairs.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("utt_id"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


@query
def stream_wer(spark, folder):
    """Every pair comes twice and counts once."""
    pairs = _timed_pairs(spark, folder, 2)
    return running.stream_error_rate(pairs, "hyp", "ref", key="utt_id", at="at").withColumn("wer", rounded("wer"))


@query
def stream_wer_missing(spark, folder):
    """Every fifth hypothesis never comes, the others come twice; a reference waits an hour for its own."""
    refs = _timed_pairs(spark, folder, 1).select("utt_id", "at", "ref")
    hyps = _timed_pairs(spark, folder, 2).where("utt_id % 5 <> 0").select("utt_id", "at", "hyp")
    rates = running.stream_missing_error_rate(refs, hyps, "utt_id", "at", "hyp", "ref")
    return rates.withColumn("wer", rounded("wer"))


@query
def stream_throughput(spark, folder):
    rows = standins.timings(_stream(spark, folder, "events"))
    rates = running.stream_throughput(rows, "ts", "tokens", "seconds", watermark="60 days")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', window_start)").alias("hour")
    return rates.select(
        hour, "sentences", "tokens", *[rounded(c) for c in ("seconds", "sentences_per_s", "tokens_per_s")]
    )


# --- end-to-end jobs ---------------------------------------------------------------------------


def _prepared(spark, folder):
    users = table(spark, folder, "events").groupBy("user_id").agg(
        F.concat(F.lit("MOSTLY "), F.upper(F.max("event_type"))).alias("tgt_text")
    )
    utterances = users.withColumn("audio", F.concat(F.lit("/fbank/"), F.col("user_id").cast("string"), F.lit(".npy")))
    return jobs.prepare_features(
        _chunks(spark, folder, MEL_WIDTH, MEL_HOP),
        "user_id",
        SAMPLE_RATE,
        MEL_WIDTH,
        MEL_HOP,
        N_MELS,
        utterances,
        scratch_path(spark, "features"),
        SIGNAL_HOPS,
    )


@query
def prepare_features(spark, folder):
    path = scratch_path(spark, "manifest")
    corpus.write_manifest(_prepared(spark, folder).manifest, "user_id", path)
    return corpus.scan_manifest(spark, path)


@query
def prepared_stats(spark, folder):
    stats = _prepared(spark, folder).stats
    return stats.select("dim", "n", *[rounded(c, 4) for c in ("sum", "sumsq", "mean", "std")])


@query
def assemble_training_set(spark, folder):
    samples = standins.document_words(spark, folder).select(
        "doc_id",
        F.transform("words", F.length).alias("source"),
        F.transform("words", lambda w: F.length(w) * 2).alias("labels"),
    )
    rows = jobs.assemble_training_set(
        samples,
        "doc_id",
        "source",
        {"words": jobs.LabelSet("labels", 100.0, stride=2)},
        start=_crop_start("doc_id", "n", "target_size"),
        sample_rate=100.0,
        min_keep=20,
        max_sample_size=256,
        max_tokens=8000,
        max_sentences=32,
        mask_prob=0.8,
        seed=1337,
    )
    return rows.select(
        "batch_id",
        "doc_id",
        "start",
        "n_sub",
        joined("source").alias("source"),
        joined("target_words").alias("target"),
        joined("masked").alias("masked"),
    )


@query
def assemble_padded(spark, folder):
    """Normalised one-dimensional frames, padded, with frame labels at half the rate and sequence labels."""
    words = standins.document_words(spark, folder)
    lengths = F.transform("words", F.length)
    samples = words.select(
        "doc_id",
        F.transform(lengths, lambda n: F.array(n.cast("float"))).alias("source"),
        F.filter(lengths, lambda n, i: i % 2 == 0).alias("half"),
        lengths.alias("every"),
    )
    stats = features.cmvn_row(features.cmvn_by_dim(samples.select(F.explode("source").alias("feat"))))
    rows = jobs.assemble_training_set(
        samples,
        "doc_id",
        "source",
        {"half": jobs.LabelSet("half", 50.0), "every": jobs.LabelSet("every", -1.0)},
        start=_crop_start("doc_id", "n", "target_size"),
        sample_rate=100.0,
        min_keep=20,
        max_sample_size=256,
        max_tokens=8000,
        max_sentences=32,
        mask_prob=0.8,
        stats=stats,
        pad_audio=True,
        seed=1337,
    )
    values = F.transform(F.flatten("source"), lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    return rows.select(
        "batch_id",
        "doc_id",
        "start",
        "n_sub",
        joined(values).alias("source"),
        bits("padding_mask").alias("padding_mask"),
        joined("target_half").alias("half"),
        "length_half",
        joined("target_every").alias("every"),
        "length_every",
        joined("masked").alias("masked"),
    )


def _decoded(spark, folder, lengths=None):
    frames = standins.frames(spark, folder)
    words = _dictionary(spark, folder)
    names = dictionary.decode_ids(
        standins.unit_arrays(spark, folder).withColumn("units", seq.best_path(F.col("units"))), "utt_id", "units", words, "ref"
    )
    refs = names.withColumn("ref", txt.tokens(F.col("ref")))
    scored = jobs.decode_and_score(frames, "utt_id", "frame_idx", "feat", words, refs, lengths=lengths)
    return scored.select("utt_id", F.array_join("hyp", " ").alias("hyp"), F.array_join("ref", " ").alias("ref"), "err", "n_ref")


@query
def decode_and_score(spark, folder):
    return _decoded(spark, folder)


@query
def decode_and_score_cut(spark, folder):
    """Frames from an utterance's input length on are padding; every ninth utterance has no length."""
    utterances = standins.frames(spark, folder).select("utt_id").distinct()
    return _decoded(spark, folder, utterances.where("utt_id % 9 <> 0").withColumn("input_len", _input_length()))
