"""Token files: ids against whole-text encoding, exact round trip, reading single documents, the public format."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyarrow import fs
from tokenizers import Tokenizer

from phonolake.llm import token_files
from phonolake.llm.queries import LLM_QUERIES
from phonolake.llm.token_files import FileReader, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, ids string, part int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    words = ["Hello,", "it's", "'s", "don't!", "Ünïcode", "éa", "東京", "123abc", "<|endoftext|>", "<|start", " x y", "ΟΔΟΣ", "İ", "a'll've", "...'s", "́", "𝒳", "\x00", "\x1c", "​", "naïve'T", "I'M", "ÉTÉ,", "×a÷b", "İb,", "ŉx.", "aя,b", "<|ENDOFTEXT|>", "a|b", "x1y22.", "ǅe!", "ſt", "ªº"]
    rows = [(k, rng.choice([" ", "\n", "\t ", "\r\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "word " * 40_000), (404, "x" * 20_000), (None, "null id"), (-5, "below zero"), (7, rows[7][1])]
    return rows


def expected(tokenizer, rows, end=2):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out, start = [], 0
    for doc, text in ordered:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", "x", 0) for d, t in rows], SCHEMA)


def query(spark, rows, tmp_path):
    frame(spark, rows).repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/t/documents.parquet")
    got = LLM_QUERIES["op12_token_files"](spark, f"{tmp_path}/t").collect()
    return sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1])


def test_equals_whole_text_encoding(spark, tokenizer, tmp_path):
    rows = texts()
    assert query(spark, rows, tmp_path) == expected(tokenizer, rows)


def test_small_frames_and_files(spark, many_blocks, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    monkeypatch.setattr(token_files, "REMEMBER", 5)
    rows = texts()
    assert query(spark, rows, tmp_path) == expected(tokenizer, rows)


def test_pieces_equal_whole_texts(tokenizer):
    """Random strings over letters, marks, signs and cases near every border of the piece rules."""
    rng = random.Random(11)
    signs = [*"aZéÉßøØ×÷İıŉſǅɏɐÀ\u024f\u0301\u0307я東1²½'’|<>.,!-_\"\x00\x1c\x7f\u00a0\u200b 	\n", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|"]
    rows = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    encoder = token_files.Encoder(open(PATH).read())
    body = [r.encode() for r in rows]
    ids, counts = encoder.encode(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0] + [len(b) for b in body]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [tokenizer.encode(r, add_special_tokens=False).ids for r in rows]
    assert [(r, g, w) for r, g, w in zip(rows, got, want) if g != w][:3] == []


def test_other_tokenizers_take_whole_texts():
    definition = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    encoder, plain = token_files.Encoder(definition), Tokenizer.from_str(definition)
    body = "Two words,\n and  more".encode()
    ids, counts = encoder.encode(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert not encoder.pieces and ids.tolist() == plain.encode(body.decode(), add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_only_wanted_frames_are_read(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 200)
    rows = [(d, t) for d, t in texts() if d is not None][:300]
    folder = f"file://{tmp_path}/files"
    catalogue = write_token_files(frame(spark, rows).coalesce(1), PATH, 2, folder)
    want = {d: (s, n, c) for d, s, n, c in expected(tokenizer, rows)}
    got = {r.doc: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read_token_files(catalogue, [3, 250, 9999]).collect()}
    assert got == {d: want[d] for d in (3, 250)}
    assert read_token_files(catalogue, []).count() == 0
    file = max(catalogue.collect(), key=lambda r: r.n_docs)
    filesystem, path = fs.FileSystem.from_uri(file.file)
    reader = FileReader(filesystem, path)
    opened = reader.read
    docs = list(reader.documents(np.array([file.low])))
    assert [d.tolist() for d, *_ in docs] == [[file.low]]
    assert reader.read - opened == reader.packed[0] and reader.read < filesystem.get_file_info(path).size / 2


def test_public_format_and_checksums(spark, tmp_path):
    rows = [(k, f"some words of document {k}") for k in range(50)]
    catalogue = write_token_files(frame(spark, rows).coalesce(1), PATH, 2, f"file://{tmp_path}/files").collect()
    path = catalogue[0].file.removeprefix("file://")
    body = open(path, "rb").read()
    frames, flags, magic = struct.unpack("<IBI", body[-9:])
    assert magic == 0x8F92EAB1 and flags == 0x80
    size = 12 * frames + 9
    assert struct.unpack("<II", body[-size - 8 : -size]) == (0x184D2A5E, size)
    entries = [struct.unpack_from("<III", body, len(body) - size + 12 * k) for k in range(frames)]
    assert sum(e[0] for e in entries) == len(body) - size - 8
    plain = zstandard.ZstdDecompressor().decompress(body[: entries[0][0]])
    assert len(plain) == entries[0][1]
    assert zstandard.get_frame_parameters(body).has_checksum
    broken = bytearray(body)
    broken[entries[0][0] // 2] ^= 1
    open(path, "wb").write(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(FileReader(fs.LocalFileSystem(), path).documents())
