"""SQL for another engine that states, on the same tables, what each query must give."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# --- shared table expressions ------------------------------------------------------------------

MANIFEST = """manifest AS (
  SELECT doc_id AS ind, source AS split, '/data/' || source || '/' || doc_id || '.flac' AS path,
         n_chars AS n_frames, text AS tgt_text FROM documents)"""

LINE_LABELS = """line_labels AS (
  SELECT doc_id AS ind, 'quality' AS label_set, quality AS value FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"""

DOC_WORDS = r"""dw AS (
  SELECT doc_id, words, len(words) AS n FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS words FROM documents))"""

HYP_REF = r"""utt AS (
  SELECT conv_id * 1000 + turn AS utt_id, role,
         list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ref FROM conversations),
hr AS (
  SELECT utt_id, role, ref,
         list_filter(list_transform(ref, lambda t, i: CASE WHEN i % 11 = 0 THEN '<x>' ELSE t END),
                     lambda t, i: i % 7 <> 0) AS hyp FROM utt)"""

FRAMES = """frames AS (
  SELECT vec_id // 20 AS utt_id, (vec_id % 20)::INT AS frame_idx, embedding AS feat, label AS unit
  FROM embeddings)"""

UNITS = FRAMES + """,
units AS (SELECT utt_id, list(unit ORDER BY frame_idx) AS units FROM frames GROUP BY utt_id)"""

LOGITS = """logits AS (
  SELECT vec_id, embedding AS z, label AS target, embedding[1] > 0 AS masked, label = 9 AS padded
  FROM embeddings)"""

SIGNAL = """sig AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p,
         count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, ' '), '')"


def collapsed(expr: str) -> str:
    return f"list_filter(list_filter({expr}, lambda x, i: i = 1 OR x <> {expr}[i - 1]), lambda x: x <> 0)"


def pieces(expr: str) -> str:
    return (
        f"flatten(list_transform({expr}, lambda t: CASE WHEN length(t) > 3 "
        "THEN [substr(t, 1, 3), '##' || substr(t, 4)] ELSE [t] END))"
    )


def words_of(units: str) -> str:
    glued = f"replace({units}, ' ##', '')"
    glued = rf"regexp_replace({glued}, ' ([.?!,])', '\1', 'g')"
    glued = rf"regexp_replace({glued}, ' (n''t|''m|''s|''ve|''re)', '\1', 'g')"
    return f"replace(replace({glued}, ' '' ', ''''), '##', '')"


def split_words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda t: t <> '')"


def draw(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def dictionary(min_count: int) -> str:
    return f"""vocab AS (
  SELECT symbol, count(*) AS n FROM (SELECT unnest(ref) AS symbol FROM hr)
  WHERE symbol NOT IN ('<s>', '<pad>', '</s>', '<unk>') GROUP BY symbol HAVING count(*) >= {min_count}),
dict AS (
  SELECT symbol, (row_number() OVER (ORDER BY n DESC, symbol) + 3)::INT AS id, n FROM vocab
  UNION ALL SELECT * FROM (VALUES ('<s>', 0, 0), ('<pad>', 1, 0), ('</s>', 2, 0), ('<unk>', 3, 0)))"""


# Needs ``pair(id, kind, a, b)``; gives ``dist(id, kind, err)`` by the textbook table, one diagonal
# (i + j = k) per step: ``p1`` is the last diagonal by i, ``p2`` the one before.
EDIT = """dp AS (
  SELECT id, kind, 0 AS k, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1000000 END) AS p1,
         list_transform(range(0, len(a) + 1), lambda i: 1000000) AS p2 FROM pair
  UNION ALL
  SELECT dp.id, dp.kind, dp.k + 1, list_transform(range(0, len(pair.a) + 1), lambda i: CASE
           WHEN i > dp.k + 1 OR dp.k + 1 - i > len(pair.b) THEN 1000000
           WHEN i = 0 OR i = dp.k + 1 THEN dp.k + 1
           ELSE least(dp.p1[i] + 1, dp.p1[i + 1] + 1,
                      dp.p2[i] + CASE WHEN pair.a[i] = pair.b[dp.k + 1 - i] THEN 0 ELSE 1 END) END), dp.p1
  FROM dp JOIN pair ON dp.id = pair.id AND dp.kind = pair.kind WHERE dp.k < len(pair.a) + len(pair.b)),
dist AS (
  SELECT dp.id, dp.kind, dp.p1[len(pair.a) + 1]::BIGINT AS err
  FROM dp JOIN pair ON dp.id = pair.id AND dp.kind = pair.kind WHERE dp.k = len(pair.a) + len(pair.b))"""


def buckets(rows: str, key: str, size: str, max_tokens: int, max_sentences: int, width: int) -> str:
    return f"""bucketed AS (
  SELECT *, greatest(1, least({max_sentences}, {max_tokens} // (bucket * {width})))::BIGINT AS cap,
         row_number() OVER (PARTITION BY bucket ORDER BY {size} DESC, {key} DESC) - 1 AS slot FROM (
    SELECT {key}, {size},
           least(greatest(ceil({size} / {width}), 1), {max_tokens // width + 1})::BIGINT AS bucket FROM {rows})),
firsts AS (
  SELECT bucket, coalesce(sum(k) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT bucket, ceil(count(*) / any_value(cap))::BIGINT AS k FROM bucketed GROUP BY bucket)),
batched AS (
  SELECT {key}, {size}, bucket, (first + slot // cap)::BIGINT AS batch_id FROM bucketed JOIN firsts USING (bucket))"""


MANIFEST_BATCHES = MANIFEST + ",\n" + buckets("manifest", "ind", "n_frames", 40000, 32, 256)
WORD_BATCHES = DOC_WORDS + ",\n" + buckets("dw", "doc_id", "n", 8000, 32, 64)


def spans(rows: str, key: str, length: str) -> str:
    """``masked(key, n_masked, masked)`` for the rows' lengths: starts by a keyed permutation in four rounds."""

    def turn(value: str, number: int) -> str:
        digits = f"('0x' || substr(md5('start:1337:1:' || k), {8 * number + 1}, 8))::BIGINT % 2147483647"
        shifted = f"(({value} + {digits}) % 2147483647)"
        return f"{shifted} * {shifted} % 2147483647"

    return f"""sized AS (
  SELECT {key} AS k, {length} AS len, greatest(2, floor(0.8::DOUBLE * {length} / 10
           + {draw(f"'spans:1337:1:' || {key}")} / 4294967296.0::DOUBLE))::INT AS spans FROM {rows}),
roomy AS (SELECT *, CASE WHEN len - 10 <= spans THEN spans + 1 ELSE len - 10 END AS room FROM sized),
grid AS (SELECT *, ((room + wide - 1) // wide)::BIGINT AS high FROM (SELECT *, ceil(sqrt(room))::BIGINT AS wide FROM roomy)),
cells AS (SELECT *, i % wide AS x0, i // wide AS y0 FROM (
  SELECT *, unnest(range(0, least(spans + wide, wide * high))) AS i FROM grid)),
one AS (SELECT *, (x0 + {turn("y0", 0)}) % wide AS x1 FROM cells),
two AS (SELECT *, (y0 + {turn("x1", 1)}) % high AS y1 FROM one),
three AS (SELECT *, (x1 + {turn("y1", 2)}) % wide AS x2 FROM two),
four AS (SELECT *, (y1 + {turn("x2", 3)}) % high AS y2 FROM three),
drawn AS (
  SELECT k, len, spans, x2 + wide * y2 AS p, row_number() OVER (PARTITION BY k ORDER BY i) AS nth FROM four
  WHERE x2 + wide * y2 < room),
covered AS (
  SELECT DISTINCT k, q FROM (SELECT k, len, unnest(range(p, p + 10)) AS q FROM drawn WHERE nth <= spans)
  WHERE q < len),
masks AS (
  SELECT roomy.k AS {key}, count(q)::INT AS n_masked, coalesce(string_agg(q::VARCHAR, ' ' ORDER BY q), '') AS masked
  FROM roomy LEFT JOIN covered ON roomy.k = covered.k GROUP BY roomy.k)"""


def line_of(text: str, key: str) -> str:
    return f"{text} || ' (None-' || {key} || ')'"


# --- sources and sinks -------------------------------------------------------------------------

oracle(
    "scan_audio_list",
    r"""SELECT doc_id::VARCHAR AS id, '/data/' || source || '/' || doc_id || '.flac' AS wav_path,
       trim(regexp_replace(text, '\s+', ' ', 'g')) AS tgt_text FROM documents""",
)
oracle(
    "scan_manifest",
    f"WITH {MANIFEST} SELECT row_number() OVER (ORDER BY ind) - 1 AS ind, path, n_frames FROM manifest",
)
oracle(
    "manifest_roundtrip",
    f"""WITH {MANIFEST} SELECT row_number() OVER (ORDER BY ind) - 1 AS ind, ind::VARCHAR AS id, path AS audio,
       n_frames::INT AS n_frames, tgt_text FROM manifest""",
)
oracle(
    "manifest_lines",
    rf"""WITH {MANIFEST}, esc AS (
  SELECT ind, path, n_frames, replace(replace(replace(replace(tgt_text, '\', '\\'), chr(9), '\t'),
         chr(10), '\n'), chr(13), '\r') AS tgt_text FROM manifest)
SELECT ind, concat_ws(chr(9), ind::VARCHAR, path, n_frames::VARCHAR, tgt_text) AS line FROM esc
UNION ALL SELECT NULL, concat_ws(chr(9), 'id', 'audio', 'n_frames', 'tgt_text')""",
)
oracle(
    "scan_labels",
    f"""WITH {DOC_WORDS}
SELECT 'words' AS label_set, row_number() OVER (ORDER BY doc_id) - 1 AS ind, n::INT AS n_tokens,
       {joined('words')} AS tokens FROM dw""",
)
oracle(
    "labels_by_offset",
    f"""WITH {DOC_WORDS}
SELECT 'words' AS label_set, ind, n::INT AS n_tokens, coalesce(array_to_string(words, ' '), '') AS tokens
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ind FROM dw) JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)
WHERE n_chars BETWEEN 1000 AND 5000""",
)
oracle(
    "label_offsets",
    """WITH o AS (
  SELECT source, doc_id, strlen(text) AS b,
         coalesce(sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM documents)
SELECT source, doc_id, s AS "start", (s + b)::BIGINT AS "end" FROM o""",
)
oracle("build_dictionary", f"WITH {HYP_REF}, {dictionary(1)} SELECT symbol, id, n FROM dict")
oracle("scan_dictionary", f"WITH {HYP_REF}, {dictionary(1)} SELECT symbol, id FROM dict")
oracle(
    "frames_roundtrip",
    f"""WITH {FRAMES} SELECT utt_id, frame_idx, len(feat)::INT AS n_dims,
       round(list_sum(list_transform(feat, lambda x: x::DOUBLE)), 6) AS total, unit FROM frames""",
)
oracle(
    "hyp_ref_lines",
    f"""WITH {HYP_REF}, texts AS (
  SELECT 'hypo.word' AS kind, utt_id, {joined('hyp')} AS t FROM hr
  UNION ALL SELECT 'hypo.units', utt_id, {joined(pieces('hyp'))} FROM hr
  UNION ALL SELECT 'ref.word', utt_id, {joined('ref')} FROM hr
  UNION ALL SELECT 'ref.units', utt_id, {joined(pieces('ref'))} FROM hr)
SELECT kind, utt_id, {line_of('t', 'utt_id')} AS line FROM texts""",
)
oracle(
    "merge_shards",
    rf"""SELECT row_number() OVER (ORDER BY doc_id % 4, doc_id) - 1 AS merged_no, doc_id % 4 AS shard,
       {line_of(r"trim(regexp_replace(text, '\s+', ' ', 'g'))", 'doc_id')} AS line FROM documents""",
)
RUNS = """runs AS (
  SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS err, count(*) AS n_ref
  FROM orders GROUP BY o_orderstatus)"""
oracle(
    "parse_reports",
    f"""WITH {RUNS} SELECT o_orderstatus, err::DOUBLE * 100 / n_ref AS wer, err, n_ref,
       'status: ' || o_orderstatus || chr(10) || 'beam: 50' AS config FROM runs""",
)


def fingerprint(text: str) -> str:
    value = "0::BIGINT"
    for start in range(1, 33, 4):
        value = f"(({value}) * 65536 + ('0x' || substr(md5({text}), {start}, 4))::BIGINT) % 1000000"
    return value


SENTENCES = f"""WITH RECURSIVE {HYP_REF},
pair AS (SELECT utt_id AS id, 'w' AS kind, hyp AS a, ref AS b FROM hr), {EDIT},
scored AS (SELECT utt_id, err, len(ref)::BIGINT AS n_ref FROM hr JOIN dist ON utt_id = id)"""
CORPUS_WER = f"""{SENTENCES}
SELECT count(*) AS n_sent, sum(err)::BIGINT AS err, sum(n_ref)::BIGINT AS n_ref,
       round(sum(err)::DOUBLE * 100 / sum(n_ref)::DOUBLE, 6) AS wer FROM scored"""
oracle(
    "wer_report",
    f"""{SENTENCES}, totals AS (SELECT sum(err)::BIGINT AS e, sum(n_ref)::BIGINT AS n FROM scored),
conf AS (SELECT 'nbest: 1' || chr(10) || 'type: viterbi' AS c)
SELECT 'WER: ' || (e::DOUBLE * 100 / n) || chr(10) || 'err / num_ref_words = ' || e || ' / ' || n
       || chr(10) || chr(10) || c AS report, {fingerprint('c')} AS run_id FROM totals, conf""",
)

# --- projections and filters -------------------------------------------------------------------

oracle(
    "filter_by_size",
    f"WITH {MANIFEST} SELECT ind, path, n_frames FROM manifest WHERE n_frames BETWEEN 200 AND 1562",
)
oracle(
    "size_rejects",
    f"""WITH {MANIFEST} SELECT ind, n_frames, CASE WHEN n_frames < 200 THEN 'short' ELSE 'long' END AS reason
FROM manifest WHERE n_frames < 200 OR n_frames > 1562""",
)
oracle(
    "drop_null_source",
    """SELECT doc_id, quality AS source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""",
)
oracle(
    "strip_special",
    f"""WITH {UNITS} SELECT utt_id, {joined('list_filter(units, lambda u: u NOT IN (1, 2))')} AS no_pad_eos,
       {joined('list_filter(units, lambda u: u <> 1)')} AS no_pad FROM units""",
)
oracle(
    "effective_size",
    f"WITH {MANIFEST} SELECT ind, n_frames AS padded_size, least(n_frames, 1562) AS cropped_size FROM manifest",
)
oracle(
    "subsampled_length",
    f"""WITH {MANIFEST}, one AS (SELECT ind, n_frames, floor((n_frames - 1) / 2 + 1) AS l FROM manifest)
SELECT ind, n_frames, floor((l - 1) / 2 + 1)::BIGINT AS n_sub FROM one""",
)
oracle(
    "get_or_last",
    f"""WITH {SIGNAL} SELECT user_id, layer, value FROM sig, (SELECT unnest([3, 11, 60, 100]) AS layer)
WHERE p = least(layer, n - 1)""",
)
oracle(
    "input_lengths",
    f"""WITH {UNITS} SELECT utt_id, CASE WHEN units[1] < 3 THEN 15
       WHEN units[1] < 7 THEN len(list_filter(units, lambda u: u <> 0)) ELSE len(units) END::INT AS input_length
FROM units""",
)

# --- joins -------------------------------------------------------------------------------------

oracle(
    "align_labels",
    f"""WITH {MANIFEST}, {LINE_LABELS} SELECT ind, path, n_frames, label_set, value
FROM manifest JOIN line_labels USING (ind) WHERE n_frames >= 200""",
)
oracle(
    "label_count_check",
    f"""WITH {LINE_LABELS}, n AS (SELECT count(*) AS n_samples FROM documents)
SELECT label_set, count(*) AS n_labels, any_value(n_samples) AS n_samples,
       count(*) = any_value(n_samples) AS agrees FROM line_labels, n GROUP BY label_set""",
)
oracle("multi_label", "SELECT doc_id AS ind, quality, toxic FROM labels")
SPREAD = "spread AS (SELECT utt_id, unnest(ref) AS symbol, generate_subscripts(ref, 1) AS pos FROM hr)"
oracle(
    "encode_tokens",
    f"""WITH {HYP_REF}, {dictionary(2)}, {SPREAD}
SELECT hr.utt_id, coalesce(string_agg(coalesce(id, 3)::VARCHAR, ' ' ORDER BY pos) FILTER (WHERE pos IS NOT NULL), '') AS ids
FROM hr LEFT JOIN spread ON hr.utt_id = spread.utt_id LEFT JOIN dict USING (symbol) GROUP BY hr.utt_id""",
)
oracle(
    "decode_ids",
    f"""WITH {HYP_REF}, {dictionary(2)}, {SPREAD}
SELECT hr.utt_id, coalesce(string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE symbol END, ' ' ORDER BY pos)
         FILTER (WHERE pos IS NOT NULL), '') AS units
FROM hr LEFT JOIN spread ON hr.utt_id = spread.utt_id LEFT JOIN dict USING (symbol) GROUP BY hr.utt_id""",
)
oracle(
    "decode_ids_unknown",
    "SELECT utt_id, CASE WHEN units = '' THEN '<unk>' ELSE units || ' <unk>' END AS units FROM "
    f"({ORACLE['decode_ids']})",
)
oracle(
    "drop_oov",
    f"""WITH {HYP_REF}, {dictionary(2)},
h AS (SELECT utt_id, unnest(hyp) AS symbol, generate_subscripts(hyp, 1) AS pos FROM hr),
hk AS (SELECT utt_id, string_agg(symbol, ' ' ORDER BY pos) FILTER (WHERE id IS NOT NULL) AS hyp,
              count(*) FILTER (WHERE id IS NULL) AS n FROM h LEFT JOIN dict USING (symbol) GROUP BY utt_id),
r AS (SELECT utt_id, unnest(ref) AS symbol FROM hr),
rk AS (SELECT utt_id, count(*) FILTER (WHERE id IS NULL) AS n FROM r LEFT JOIN dict USING (symbol) GROUP BY utt_id)
SELECT hr.utt_id, coalesce(hk.hyp, '') AS hyp, coalesce(hk.n, 0) AS n_dropped, coalesce(rk.n, 0) AS n_ref_missing
FROM hr LEFT JOIN hk ON hr.utt_id = hk.utt_id LEFT JOIN rk ON hr.utt_id = rk.utt_id""",
)
STATS = """cells AS (SELECT unnest(feat)::DOUBLE AS x, generate_subscripts(feat, 1) - 1 AS dim FROM frames),
stats AS (
  SELECT dim::INT AS dim, count(*) AS n, sum(x) AS sum, sum(x * x) AS sumsq, (sum(x) / count(*))::FLOAT AS mean,
         sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)), 1e-8))::FLOAT AS std
  FROM cells GROUP BY dim)"""
oracle(
    "apply_cmvn",
    f"""WITH {FRAMES}, {STATS},
spread AS (SELECT utt_id, frame_idx, unnest(feat) AS x, (generate_subscripts(feat, 1) - 1)::INT AS dim FROM frames)
SELECT utt_id, frame_idx, dim, round(((x - mean) / std)::DOUBLE, 4) AS x FROM spread JOIN stats USING (dim)""",
)

# --- aggregations ------------------------------------------------------------------------------

ROUNDED_STATS = """SELECT dim, n, round(sum, 6) AS sum, round(sumsq, 6) AS sumsq, round(mean::DOUBLE, 6) AS mean,
       round(std::DOUBLE, 6) AS std FROM stats"""
oracle("cmvn_stats", f"WITH {FRAMES}, {STATS} {ROUNDED_STATS}")
oracle(
    "cmvn_stats_text",
    f"""WITH {FRAMES}, {STATS}
SELECT 0 AS line_no, max(n)::VARCHAR AS line FROM stats
UNION ALL SELECT 1, string_agg(printf('%.4f', sum), ' ' ORDER BY dim) || ' ' FROM stats
UNION ALL SELECT 2, string_agg(printf('%.4f', sumsq), ' ' ORDER BY dim) || ' ' FROM stats""",
)
oracle(
    "load_summary",
    """SELECT count(*) FILTER (WHERE n_chars BETWEEN 200 AND 1562) AS loaded,
       count(*) FILTER (WHERE n_chars < 200) AS n_short, count(*) FILTER (WHERE n_chars > 1562) AS n_long,
       max(n_chars) FILTER (WHERE n_chars BETWEEN 200 AND 1562) AS longest,
       min(n_chars) FILTER (WHERE n_chars BETWEEN 200 AND 1562) AS shortest, count(*) AS total FROM documents""",
)
oracle("batch_by_bucket", f"WITH {MANIFEST_BATCHES} SELECT ind, n_frames, bucket, batch_id FROM batched")
oracle(
    "batch_greedy",
    f"""WITH RECURSIVE {MANIFEST}, o AS (
  SELECT ind, n_frames, row_number() OVER (ORDER BY n_frames DESC, ind DESC) - 1 AS pos,
         greatest(1, least(32, 40000 // greatest(n_frames, 1))) AS cap, count(*) OVER () AS n FROM manifest),
walk AS (
  SELECT 0::BIGINT AS s, 0::BIGINT AS b
  UNION ALL
  SELECT s + CASE WHEN n - s <= cap THEN n ELSE greatest(cap // 8 * 8, cap % 8) END, b + 1
  FROM walk JOIN o ON pos = s)
SELECT ind, n_frames, pos, b AS batch_id FROM o ASOF JOIN walk ON pos >= s""",
)
oracle(
    "batch_target_size",
    f"""WITH {MANIFEST_BATCHES} SELECT batch_id, count(*) AS nsentences, least(max(n_frames), 1562) AS padded_size,
       least(min(n_frames), 1562) AS cropped_size FROM batched GROUP BY batch_id""",
)
oracle(
    "batch_counts",
    f"""WITH {WORD_BATCHES}, labelled AS (
  SELECT batch_id, doc_id, 'word' AS label_set, len(words) AS k FROM batched JOIN dw USING (doc_id)
  UNION ALL SELECT batch_id, doc_id, 'long', len(list_filter(words, lambda w: length(w) > 3))
  FROM batched JOIN dw USING (doc_id))
SELECT batch_id, label_set, count(*) AS nsentences, sum(k)::BIGINT AS ntokens,
       string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS ids,
       string_agg(k::VARCHAR, ' ' ORDER BY doc_id) AS target_lengths FROM labelled GROUP BY batch_id, label_set""",
)


def nll(temperature: str) -> str:
    return (
        f"(list_max(z) / {temperature} + ln(list_sum(list_transform(z, lambda x: "
        f"exp((x::DOUBLE - list_max(z)::DOUBLE) / {temperature})))) - z[target + 1]::DOUBLE / {temperature})"
    ).replace("(list_max(z) /", "(list_max(z)::DOUBLE /")


SCORED_LOGITS = f"""{LOGITS}, scored AS (
  SELECT *, {nll('0.1::DOUBLE')} AS nll, list_position(z, list_max(z)) - 1 = target AS hit,
         list_sum(list_transform(z, lambda x: x::DOUBLE * x::DOUBLE)) AS pen FROM logits WHERE NOT padded)"""
oracle(
    "loss_report",
    f"""WITH {SCORED_LOGITS}
SELECT round(sum(nll) FILTER (WHERE masked) + 0.5 * sum(nll) FILTER (WHERE NOT masked), 6) AS loss,
       round(sum(nll) FILTER (WHERE masked), 6) AS loss_m, round(sum(nll) FILTER (WHERE NOT masked), 6) AS loss_u,
       round(avg(pen), 6) AS features_pen, count(*) AS sample_size, count(*) FILTER (WHERE masked) AS count_m,
       count(*) FILTER (WHERE NOT masked) AS count_u, count(*) FILTER (WHERE masked AND hit) AS correct_m,
       count(*) FILTER (WHERE NOT masked AND hit) AS correct_u FROM scored""",
)
oracle(
    "masked_accuracy",
    f"""WITH {SCORED_LOGITS} SELECT masked, count(*) FILTER (WHERE hit) AS correct, count(*) AS count,
       round(count(*) FILTER (WHERE hit) / count(*), 6) AS accuracy FROM scored GROUP BY masked""",
)
oracle("wer_per_sentence", f"{SENTENCES} SELECT utt_id, err, n_ref FROM scored")
oracle(
    "wer_missing_hyp",
    f"""{SENTENCES} SELECT utt_id, CASE WHEN utt_id % 5 = 0 THEN n_ref ELSE err END AS err, n_ref FROM scored""",
)
oracle("corpus_wer", CORPUS_WER)
oracle(
    "error_totals",
    f"""WITH RECURSIVE {HYP_REF}, cut AS (
  SELECT utt_id, role, {pieces('hyp')} AS hu, {pieces('ref')} AS ru,
         CASE WHEN len(ref) > 20 THEN list_filter(hyp, lambda t: t <> '<x>') END AS dec FROM hr),
words AS (
  SELECT *, CASE WHEN len(hu) = 0 THEN [] ELSE string_split({words_of("array_to_string(hu, ' ')")}, ' ') END AS hw,
         string_split({words_of("coalesce(array_to_string(ru, ' '), '')")}, ' ') AS rw FROM cut),
pair AS (
  SELECT utt_id AS id, 'c' AS kind, hu AS a, ru AS b FROM words
  UNION ALL SELECT utt_id, 'v', hw, rw FROM words
  UNION ALL SELECT utt_id, 'w', coalesce(dec, hw), rw FROM words), {EDIT},
rows AS (
  SELECT role, len(ru) AS cl, len(rw) AS wl, c.err AS c, v.err AS v, w.err AS w FROM words
  JOIN dist c ON c.id = utt_id AND c.kind = 'c' JOIN dist v ON v.id = utt_id AND v.kind = 'v'
  JOIN dist w ON w.id = utt_id AND w.kind = 'w'),
totals AS (
  SELECT coalesce(role, 'ALL') AS role, grouping(role)::INT AS is_total, sum(c)::BIGINT AS c_errors,
         sum(cl)::BIGINT AS c_total, sum(w)::BIGINT AS w_errors, sum(wl)::BIGINT AS w_total,
         sum(v)::BIGINT AS wv_errors FROM rows GROUP BY ROLLUP (role))
SELECT *, round(c_errors * 100::DOUBLE / c_total, 6) AS uer, round(w_errors * 100::DOUBLE / w_total, 6) AS wer,
       round(wv_errors * 100::DOUBLE / w_total, 6) AS raw_wer FROM totals""",
)
RATES = """round(s, 6) AS seconds, round(n / (s + 1e-6), 6) AS sentences_per_s,
       round(1 / (CASE WHEN k > 0 THEN s / k ELSE s END + 1e-6), 6) AS tokens_per_s"""
oracle(
    "throughput",
    f"""WITH t AS (
  SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k, sum(value) AS s
  FROM events GROUP BY event_type)
SELECT event_type, n AS sentences, k AS tokens, {RATES} FROM t""",
)

# --- ordered scans -----------------------------------------------------------------------------

oracle(
    "collapse_repeats_window",
    f"""WITH {FRAMES}, l AS (
  SELECT utt_id, frame_idx, unit, lag(unit) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS before FROM frames)
SELECT utt_id, frame_idx, unit FROM l WHERE before IS NULL OR unit <> before""",
)
oracle(
    "shard_assign",
    f"""WITH {MANIFEST_BATCHES} SELECT batch_id, count(*) AS nsentences, batch_id % 8 AS shard, batch_id // 8 AS step
FROM batched GROUP BY batch_id""",
)
oracle(
    "best_hypothesis",
    """SELECT user_id, value, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
)
oracle(
    "frame_signal",
    f"""WITH {SIGNAL}, f AS (
  SELECT user_id, unnest(range(0, (n - 8) // 4 + 1)) AS frame_idx FROM (SELECT DISTINCT user_id, n FROM sig) WHERE n >= 8)
SELECT user_id, frame_idx, round(sum(value * value), 4) AS energy
FROM f JOIN sig USING (user_id) WHERE p >= frame_idx * 4 AND p < frame_idx * 4 + 8 GROUP BY user_id, frame_idx""",
)
oracle(
    "ordered_indices",
    f"WITH {MANIFEST} SELECT ind, n_frames, row_number() OVER (ORDER BY n_frames DESC, ind DESC) - 1 AS pos FROM manifest",
)
oracle(
    "epoch_order",
    f"WITH {MANIFEST} SELECT ind, row_number() OVER (ORDER BY md5('1337:2:' || ind), ind) - 1 AS pos FROM manifest",
)

# --- set operations ----------------------------------------------------------------------------

oracle(
    "duplicate_rows",
    "SELECT vec_id, label AS target, copy FROM embeddings, (SELECT unnest([0, 1]) AS copy)",
)
oracle(
    "concat_heads",
    f"""WITH {LOGITS}, heads AS (
  SELECT 0 AS head, vec_id, target, masked, z FROM logits
  UNION ALL SELECT 1, vec_id, target, masked, list_reverse(z) FROM logits)
SELECT head, vec_id, target, masked, (list_position(z, list_max(z)) - 1)::INT AS best FROM heads""",
)
oracle(
    "mask_partition",
    f"""WITH {LOGITS} SELECT vec_id, CASE WHEN padded THEN 'padding' WHEN masked THEN 'masked' ELSE 'unmasked' END AS part
FROM logits""",
)

# --- text --------------------------------------------------------------------------------------

oracle(
    "pieces_to_words",
    f"""WITH {HYP_REF} SELECT utt_id, {words_of(joined(pieces('ref')))} AS words FROM hr""",
)
oracle(
    "letters_to_words",
    rf"""WITH t AS (
  SELECT conv_id * 1000 + turn AS utt_id, role,
         array_to_string({split_words('text')}, '|') AS s FROM conversations),
l AS (SELECT utt_id, role, array_to_string(regexp_extract_all(s, '.'), ' ') || ' |' AS letters FROM t)
SELECT utt_id, CASE WHEN role = 'user' THEN trim(replace(replace(letters, ' ', ''), '|', ' ')) ELSE letters END AS words
FROM l""",
)
oracle(
    "tokenise",
    f"""WITH t AS (SELECT *, {split_words('text')} AS w FROM conversations)
SELECT conv_id, turn, len(w)::INT AS n_words, len(string_split(text, ' '))::INT AS n_strict,
       array_to_string(w, '|') AS words FROM t""",
)
oracle("run_fingerprint", f"SELECT doc_id, {fingerprint('text')} AS run_id FROM documents")

# --- sequences ---------------------------------------------------------------------------------

oracle("frame_argmax", f"WITH {LOGITS} SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS best FROM logits")
oracle("best_path", f"WITH {UNITS} SELECT utt_id, {joined(collapsed('units'))} AS path FROM units")
CUT = ("FROM embeddings", "FROM embeddings WHERE vec_id % 20 < 20 - (vec_id // 20) % 7")
oracle("best_path_cut", ORACLE["best_path"].replace(*CUT))
oracle(
    "crop_sequences",
    f"""WITH {DOC_WORDS}, s AS (SELECT *, (doc_id % (greatest(n - 64, 0) + 1))::INT AS start FROM dw)
SELECT doc_id, n::INT AS n_words, start, array_to_string(words[start + 1:start + 64], ' ') AS words FROM s""",
)


def targeted(extreme: str, limit: str) -> str:
    """``placed``: batched documents with their batch's target size and their crop start."""
    return f"""goal AS (SELECT batch_id, {limit.format(f'{extreme}(n)')} AS target FROM batched GROUP BY batch_id),
placed AS (
  SELECT batch_id, doc_id, words, n, target, (doc_id % (greatest(n - target, 0) + 1))::INT AS start
  FROM batched JOIN goal USING (batch_id) JOIN (SELECT doc_id, words FROM dw) USING (doc_id))"""


oracle(
    "pad_and_mask",
    f"""WITH {WORD_BATCHES}, {targeted('max', 'least({}, 256)')}, x AS (
  SELECT *, list_transform(words[start + 1:start + target], lambda w: length(w)) AS kept FROM placed)
SELECT batch_id, doc_id, start,
       array_to_string(list_concat(kept, list_transform(range(len(kept), target), lambda i: 0)), ' ') AS source,
       array_to_string(list_transform(range(0, target), lambda i: CASE WHEN i >= n THEN '1' ELSE '0' END), '') AS padding_mask
FROM x""",
)
oracle(
    "align_frame_labels",
    f"""WITH {WORD_BATCHES}, {targeted('min', 'least({}, 256)')}, lab AS (
  SELECT batch_id, doc_id, list_transform(list_filter(words, lambda w, i: i % 2 = 1), lambda w: length(w)) AS labels,
         round_even(start * 0.5::DOUBLE, 0)::INT AS label_start, round_even(target * 0.5::DOUBLE, 0)::INT AS wanted
  FROM placed),
lim AS (SELECT *, greatest(0, least(wanted, min(len(labels) - label_start) OVER (PARTITION BY batch_id))) AS size FROM lab),
cut AS (SELECT *, CASE WHEN size = 0 THEN [] ELSE labels[label_start + 1:label_start + size] END AS t FROM lim),
m AS (SELECT *, max(len(t)) OVER (PARTITION BY batch_id) AS longest FROM cut)
SELECT batch_id, doc_id, label_start, len(t)::INT AS target_length,
       coalesce(array_to_string(list_concat(t, list_transform(range(len(t), longest), lambda i: 1)), ' '), '') AS target FROM m""",
)
oracle(
    "pad_sequence_labels",
    f"""WITH {WORD_BATCHES}, m AS (
  SELECT batch_id, doc_id, n, list_transform(words, lambda w: length(w)) AS t,
         max(n) OVER (PARTITION BY batch_id) AS longest
  FROM batched JOIN (SELECT doc_id, words FROM dw) USING (doc_id))
SELECT batch_id, doc_id, n::INT AS target_length,
       array_to_string(list_concat(t, list_transform(range(n, longest), lambda i: 1)), ' ') AS target FROM m""",
)
oracle(
    "stride_labels",
    f"""WITH {DOC_WORDS}, s AS (SELECT doc_id, words, least((n + 1) // 2, n // 2) AS t FROM dw)
SELECT doc_id, t::INT AS n_frames, coalesce(array_to_string(list_transform(range(0, t), lambda i: length(words[i * 2 + 1])), ' '), '') AS target
FROM s""",
)
oracle("cross_entropy", f"WITH {LOGITS} SELECT vec_id, round({nll('0.1::DOUBLE')}, 6) AS nll FROM logits")
CTC = f"""WITH RECURSIVE {FRAMES}, probs AS (
  SELECT utt_id, frame_idx, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
    SELECT utt_id, frame_idx, list_transform(feat, lambda x: exp(x::DOUBLE)) AS e FROM frames)),
goal AS (SELECT utt_id, {collapsed('u')} AS target, n FROM (
  SELECT utt_id, list(unit ORDER BY frame_idx) AS u, count(*) AS n FROM frames GROUP BY utt_id)),
states AS (SELECT utt_id, n, list_append(flatten(list_transform(target, lambda x: [0, x])), 0) AS s FROM goal),
walk AS (
  SELECT utt_id, 0 AS t, list_transform(s, lambda x, i: CASE WHEN i <= 2 THEN p[x + 1] ELSE 0 END) AS a
  FROM states JOIN probs USING (utt_id) WHERE frame_idx = 0
  UNION ALL
  SELECT w.utt_id, w.t + 1, list_transform(s, lambda x, i: (a[i] + CASE WHEN i > 1 THEN a[i - 1] ELSE 0 END
           + CASE WHEN i > 2 AND x <> 0 AND x <> s[i - 2] THEN a[i - 2] ELSE 0 END) * p[x + 1])
  FROM walk w JOIN states ON states.utt_id = w.utt_id
  JOIN probs ON probs.utt_id = w.utt_id AND probs.frame_idx = w.t + 1),
scores AS (
  SELECT utt_id, n, len(s) // 2 AS n_tokens, -ln(a[-1] + CASE WHEN len(a) > 1 THEN a[-2] ELSE 0 END) AS nll
  FROM walk JOIN states USING (utt_id) WHERE t = n - 1)"""
oracle("ctc_score", f"{CTC} SELECT utt_id, round(nll, 6) AS nll FROM scores")
oracle("ctc_score_cut", ORACLE["ctc_score"].replace(*CUT))
oracle(
    "ctc_loss_report",
    f"""{CTC} SELECT round(sum(nll), 5) AS loss, sum(n_tokens)::BIGINT AS ntokens, count(*) AS nsentences,
       sum(n_tokens)::BIGINT AS sample_size FROM scores""",
)
LENGTHS = f"""{DOC_WORDS}, gaps AS (
  SELECT doc_id AS ind, 'phn' AS label_set, abs(n_chars / 100::DOUBLE - n / 20::DOUBLE) AS gap
  FROM documents JOIN dw USING (doc_id)
  UNION ALL SELECT doc_id, 'wp', NULL FROM documents)"""
oracle(
    "verify_label_lengths",
    f"WITH {LENGTHS} SELECT ind, label_set, round(gap, 6) AS gap_s, coalesce(gap > 0.1::DOUBLE, false) AS mismatch FROM gaps",
)
oracle(
    "label_length_summary",
    f"""WITH {LENGTHS} SELECT label_set, count(gap) AS n_checked, count(*) FILTER (WHERE gap > 0.1::DOUBLE) AS n_mismatch,
       round(max(gap), 6) AS max_gap_s FROM gaps GROUP BY label_set""",
)
oracle(
    "pool_padding_mask",
    f"""WITH {DOC_WORDS}, s AS (
  SELECT doc_id, list_transform(words, lambda w: length(w) < 5) AS m, ((n + 1) // 2 + 1) // 2 AS t, n FROM dw)
SELECT doc_id, array_to_string(list_transform(range(0, t), lambda i:
         CASE WHEN list_bool_and(m[i * (n // t) + 1:(i + 1) * (n // t)]) THEN '1' ELSE '0' END), '') AS mask FROM s""",
)
oracle("span_mask", f"WITH {DOC_WORDS}, {spans('dw', 'doc_id', 'n')} SELECT doc_id, n_masked, masked FROM masks")


def randint(bound: str, name: str, part: str, number: int) -> str:
    text = f"'{name}:{part}:{number}:1337:1:' || utt_id"
    return f"(CASE WHEN {bound} > 0 THEN {draw(text)} % ({bound}) ELSE 0 END)"


def banded(name: str, number: int, width: str, size: str, at: str) -> str:
    wide = randint(width, name, "width", number)
    first = randint(f"({size} - {wide})", name, "from", number)
    return f"({at} >= {first} AND {at} < {first} + {wide})"


oracle(
    "spec_augment",
    f"""WITH {FRAMES}, cells AS (
  SELECT utt_id, frame_idx, (generate_subscripts(feat, 1) - 1)::INT AS dim, unnest(feat)::DOUBLE AS x FROM frames),
per AS (SELECT utt_id, count(DISTINCT frame_idx) AS n, avg(x) AS mean FROM cells GROUP BY utt_id),
b AS (SELECT utt_id, dim FROM per, (SELECT unnest(range(0, 64)) AS dim)
      WHERE {banded('freq', 0, '30', '64', 'dim')} OR {banded('freq', 1, '30', '64', 'dim')}),
s AS (SELECT utt_id, frame_idx FROM per, (SELECT unnest(range(0, 20)) AS frame_idx)
      WHERE {banded('time', 0, 'least(40, n)', 'n', 'frame_idx')} OR {banded('time', 1, 'least(40, n)', 'n', 'frame_idx')})
SELECT cells.utt_id, cells.frame_idx, cells.dim,
       round(CASE WHEN b.dim IS NOT NULL OR s.frame_idx IS NOT NULL THEN mean ELSE x END, 6) AS x
FROM cells JOIN per ON cells.utt_id = per.utt_id
LEFT JOIN b ON b.utt_id = cells.utt_id AND b.dim = cells.dim
LEFT JOIN s ON s.utt_id = cells.utt_id AND s.frame_idx = cells.frame_idx""",
)
oracle(
    "to_mono",
    """WITH p AS (SELECT vec_id, embedding AS e, unnest(range(0, 32)) AS i FROM embeddings)
SELECT vec_id, i::INT AS sample_idx, round((e[i + 1]::DOUBLE + e[i + 33]::DOUBLE) / 2 * 32768, 6) AS sample FROM p""",
)
oracle(
    "resample_series",
    """WITH means AS (
  SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS bucket, avg(value) AS mean FROM events GROUP BY ALL),
ends AS (SELECT user_id, min(bucket) AS lo, max(bucket) AS hi FROM means GROUP BY user_id),
grid AS (SELECT user_id, unnest(range(lo, hi + 1)) AS grid FROM ends),
seen AS (
  SELECT grid.user_id, grid, mean,
         last_value(bucket IGNORE NULLS) OVER back AS b0, last_value(mean IGNORE NULLS) OVER back AS m0,
         first_value(bucket IGNORE NULLS) OVER ahead AS b1, first_value(mean IGNORE NULLS) OVER ahead AS m1
  FROM grid LEFT JOIN means ON means.user_id = grid.user_id AND bucket = grid
  WINDOW back AS (PARTITION BY grid.user_id ORDER BY grid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY grid.user_id ORDER BY grid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, grid, round(CASE WHEN mean IS NOT NULL THEN mean ELSE m0 + (m1 - m0) * ((grid - b0) / (b1 - b0)) END, 9) AS value,
       mean IS NULL AS is_filled FROM seen""",
)


def log_mel(raw: str, key: str) -> str:
    """``mels(key, frame_idx, mel, x)`` of the 16-sample frames in ``raw(key, frame_idx, x)``."""
    return f"""{raw},
centred AS (SELECT {key}, frame_idx, list_transform(x, lambda v: v - list_avg(x)) AS c FROM raw),
shaped AS (
  SELECT {key}, frame_idx, list_transform(c, lambda v, i: (v - 0.97::DOUBLE * c[greatest(i - 1, 1)])
           * pow(0.5 - 0.5 * cos(2 * pi() * (i - 1) / 15), 0.85)) AS s FROM centred),
power AS (
  SELECT {key}, frame_idx, k,
         pow(list_sum(list_transform(s, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 16))), 2)
         + pow(list_sum(list_transform(s, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 16))), 2) AS e
  FROM shaped, (SELECT unnest(range(0, 8)) AS k)),
ends AS (SELECT 1127 * ln(1 + 20 / 700) AS lo, 1127 * ln(1 + 8000 / 700) AS hi),
bands AS (
  SELECT mel, k, lo + (hi - lo) * mel / 5 AS l, lo + (hi - lo) * (mel + 1) / 5 AS c, lo + (hi - lo) * (mel + 2) / 5 AS r,
         1127 * ln(1 + k * 1000 / 700) AS b FROM ends, (SELECT unnest(range(0, 4)) AS mel), (SELECT unnest(range(0, 8)) AS k)),
weights AS (SELECT mel, k, greatest(0, least((b - l) / (c - l), (r - b) / (r - c))) AS w FROM bands),
mels AS (
  SELECT {key}, frame_idx, mel::INT AS mel, ln(greatest(sum(e * w), 1.1920928955078125e-07)) AS x
  FROM power JOIN weights USING (k) GROUP BY {key}, frame_idx, mel)"""


LOG_MEL = log_mel(
    f"""{SIGNAL}, f AS (
  SELECT user_id, unnest(range(0, (n - 16) // 8 + 1)) AS frame_idx FROM (SELECT DISTINCT user_id, n FROM sig) WHERE n >= 16),
raw AS (
  SELECT user_id, frame_idx, list(value ORDER BY p) AS x FROM f JOIN sig USING (user_id)
  WHERE p >= frame_idx * 8 AND p < frame_idx * 8 + 16 GROUP BY user_id, frame_idx)""",
    "user_id",
)
WAVE_MEL = log_mel(
    """raw AS (
  SELECT vec_id, f AS frame_idx, list_transform(range(0, 16), lambda i:
           (embedding[f * 8 + i + 1]::DOUBLE + embedding[f * 8 + i + 33]::DOUBLE) / 2 * 32768) AS x
  FROM embeddings, (SELECT unnest(range(0, 3)) AS f))""",
    "vec_id",
)
oracle("waveform_features", f"WITH {WAVE_MEL} SELECT vec_id, frame_idx, mel, round(x, 6) AS x FROM mels")
oracle("log_mel", f"WITH {LOG_MEL} SELECT user_id, frame_idx, mel, round(x, 6) AS x FROM mels")

# --- streams -----------------------------------------------------------------------------------

oracle("stream_cmvn", ORACLE["cmvn_stats"])
oracle("stream_wer", CORPUS_WER)
oracle(
    "stream_wer_missing",
    f"""{SENTENCES}, gaps AS (
  SELECT *, utt_id % 5 = 0 AS missing, least(max(utt_id) OVER (), max(utt_id) FILTER (WHERE utt_id % 5 <> 0) OVER ()) - 3600 AS mark
  FROM scored),
told AS (SELECT CASE WHEN missing THEN n_ref ELSE err END AS e, n_ref AS n FROM gaps WHERE NOT missing OR utt_id + 3600 < mark)
SELECT count(*) AS n_sent, sum(e)::BIGINT AS err, sum(n)::BIGINT AS n_ref,
       round(sum(e)::DOUBLE * 100 / sum(n)::DOUBLE, 6) AS wer FROM told""",
)
oracle(
    "stream_throughput",
    f"""WITH t AS (
  SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k,
         sum(value) AS s FROM events GROUP BY hour)
SELECT hour, n AS sentences, k AS tokens, {RATES} FROM t""",
)

# --- end-to-end jobs ---------------------------------------------------------------------------

oracle(
    "prepare_features",
    f"""WITH {LOG_MEL}, counts AS (SELECT user_id, count(DISTINCT frame_idx) AS k FROM mels GROUP BY user_id),
users AS (SELECT DISTINCT user_id FROM events)
SELECT row_number() OVER (ORDER BY user_id) - 1 AS ind, '/fbank/' || user_id || '.npy' AS path,
       coalesce(k, 0) AS n_frames FROM users LEFT JOIN counts USING (user_id)""",
)
oracle(
    "prepared_stats",
    f"""WITH {LOG_MEL}, stats AS (
  SELECT mel AS dim, count(*) AS n, sum(x) AS sum, sum(x * x) AS sumsq, sum(x) / count(*) AS mean FROM mels GROUP BY mel)
SELECT dim, n, round(sum, 4) AS sum, round(sumsq, 4) AS sumsq, round(mean::FLOAT::DOUBLE, 4) AS mean,
       round(sqrt(greatest(sumsq / n - mean * mean, 1e-8))::FLOAT::DOUBLE, 4) AS std FROM stats""",
)
oracle(
    "assemble_padded",
    f"""WITH {DOC_WORDS}, kept AS (SELECT doc_id, n FROM dw WHERE n >= 20),
{buckets('kept', 'doc_id', 'n', 8000, 32, 64)}, {targeted('max', 'least({}, 256)')},
stats AS (
  SELECT m::FLOAT AS mean, sqrt(greatest(q - m * m, 1e-8))::FLOAT AS std FROM (
    SELECT sum(l) / count(*) AS m, sum(l * l) / count(*) AS q FROM (
      SELECT length(unnest(words))::DOUBLE AS l FROM dw))),
cut AS (
  SELECT *, list_transform(words, lambda w: length(w)) AS every,
         round_even(start * 0.5::DOUBLE, 0)::INT AS ls, round_even(target * 0.5::DOUBLE, 0)::INT AS wanted FROM placed),
halved AS (
  SELECT *, list_filter(every, lambda x, i: i % 2 = 1)[ls + 1:ls + wanted] AS half FROM cut),
most AS (
  SELECT *, max(len(half)) OVER (PARTITION BY batch_id) AS most_half, max(n) OVER (PARTITION BY batch_id) AS most_every FROM halved),
rows AS (SELECT *, least((target + 1) // 2, most_half)::INT AS n_sub FROM most),
{spans('rows', 'doc_id', 'n_sub')}
SELECT batch_id, rows.doc_id, start, n_sub,
       array_to_string(list_concat(list_transform(every[start + 1:start + target], lambda x: round(((x::FLOAT - mean) / std)::DOUBLE * 1000)::BIGINT),
         list_transform(range(n, target), lambda i: 0::BIGINT)), ' ') AS source,
       array_to_string(list_transform(range(0, target), lambda i: CASE WHEN i >= n THEN '1' ELSE '0' END), '') AS padding_mask,
       array_to_string(list_concat(half, list_transform(range(len(half), most_half), lambda i: 1))[1:n_sub], ' ') AS half,
       len(half)::INT AS length_half,
       array_to_string(list_concat(every, list_transform(range(n, most_every), lambda i: 1)), ' ') AS every, n::INT AS length_every, masked
FROM rows JOIN masks ON masks.doc_id = rows.doc_id CROSS JOIN stats""",
)
oracle(
    "assemble_training_set",
    f"""WITH {DOC_WORDS}, kept AS (SELECT doc_id, n FROM dw WHERE n >= 20),
{buckets('kept', 'doc_id', 'n', 8000, 32, 64)}, {targeted('min', 'least({}, 256)')},
rows AS (
  SELECT batch_id, doc_id, start, least((target + 1) // 2, target // 2)::INT AS n_sub,
         list_transform(words[start + 1:start + target], lambda w: length(w)) AS cut FROM placed),
{spans('rows', 'doc_id', 'n_sub')}
SELECT batch_id, rows.doc_id, start, n_sub, array_to_string(cut, ' ') AS source,
       array_to_string(list_transform(range(0, n_sub), lambda i: cut[i * 2 + 1] * 2), ' ') AS target, masked
FROM rows JOIN masks ON masks.doc_id = rows.doc_id""",
)
oracle(
    "decode_and_score",
    f"""WITH RECURSIVE {HYP_REF}, {dictionary(1)}, {FRAMES},
paths AS (
  SELECT utt_id, list(unit ORDER BY frame_idx) AS u,
         list(list_position(feat, list_max(feat)) - 1 ORDER BY frame_idx) AS v FROM frames GROUP BY utt_id),
ids AS (SELECT utt_id, 'r' AS side, {collapsed('u')} AS i FROM paths
        UNION ALL SELECT utt_id, 'h', {collapsed('v')} FROM paths),
spread AS (SELECT utt_id, side, unnest(i) AS id, generate_subscripts(i, 1) AS pos FROM ids),
names AS (SELECT utt_id, side, string_agg(coalesce(symbol, '<unk>'), ' ' ORDER BY pos) AS t
  FROM spread LEFT JOIN dict USING (id) WHERE id NOT IN (0, 2) GROUP BY utt_id, side),
sides AS (SELECT p.utt_id, {split_words(words_of("coalesce(h.t, '')"))} AS hyp, {split_words("coalesce(r.t, '')")} AS ref
  FROM paths p LEFT JOIN names h ON h.utt_id = p.utt_id AND h.side = 'h' LEFT JOIN names r ON r.utt_id = p.utt_id AND r.side = 'r'),
pair AS (SELECT utt_id AS id, 'w' AS kind, hyp AS a, ref AS b FROM sides), {EDIT}
SELECT utt_id, {joined('hyp')} AS hyp, {joined('ref')} AS ref, err, len(ref)::BIGINT AS n_ref
FROM sides JOIN dist ON id = utt_id""",
)
BEST_LIST = "list(list_position(feat, list_max(feat)) - 1 ORDER BY frame_idx)"
oracle(
    "decode_and_score_cut",
    ORACLE["decode_and_score"].replace(
        BEST_LIST, f"{BEST_LIST} FILTER (WHERE frame_idx < 20 - utt_id % 7 OR utt_id % 9 = 0)"
    ),
)
