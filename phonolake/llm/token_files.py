"""Token ids of documents in binary files that can be read document by document.

A file is a row of independent zstandard frames. Each frame holds the ids of some
whole documents, little-endian, two bytes an id if the vocabulary allows, else four;
the frame after them is the directory: version and width, then the ids and lengths of
all documents of the file. Every frame carries zstandard's own checksum. A seek
table, in zstandard's public seekable format, ends the file: one entry per frame with
its compressed and plain size and checksum, then the number of frames. Plain zstandard
tools read such a file as the joined frames; a reader that wants some documents takes the
tail, the directory, and the frames that hold them.

Files are written by tasks next to each other; their names, ranges and counts are the
catalogue, a table. A file that no catalogue names, left by a lost task, is not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phonolake.llm.text import SPACE, chunks, cut_words, keyed, lower_ascii
from phonolake.operators.ordering import ordered_scan
from phonolake.session import materialise, scratch_path

#: A frame ends with the document that brings it to so many ids, a file with the frame that brings it to so many bytes.
FRAME_IDS = 1 << 17
FILE_BYTES = 64 << 20
#: Bytes of text that a task encodes at once.
CHUNK = 1 << 22
#: Distinct pieces whose ids a task remembers before it starts anew.
REMEMBER = 1 << 18
LEVEL = 3
VERSION = 1
# The public seekable format of zstandard.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER, FOOTER_BYTES = "<IBI", 9
ENTRY, ENTRY_BYTES = "<III", 12

# Fixed value: the pattern of the tokens in the tokenizer's definition.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_LETTERS = frozenset(ascii_lowercase)
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

CATALOGUE = "part int, seq int, file string, low long, high long, n_docs long, n_ids long"


def by_pieces(definition: dict) -> bool:
    """Whether the tokenizer is of the kind whose texts ``Encoder`` may encode piece by piece."""
    steps = definition["pre_tokenizer"].get("pretokenizers") or [{}]
    normal = [x["type"] for x in (definition["normalizer"] or {}).get("normalizers", [])]
    split = steps[0].get("pattern") == {"Regex": PIECES} and [x.get("type") for x in steps[1:]] == ["ByteLevel"]
    return split and normal == ["NFC", "Replace", "Lowercase"]


class Encoder:
    """Ids of texts. A piece's ids do not depend on its neighbours, so each distinct piece is encoded once.

    A piece is a stretch without ASCII white space. Where such a stretch consists of Latin letters and
    ASCII, without apostrophe or bar, its runs of letters and of other characters are pieces of their
    own: the tokenizer's pattern ends a token between them. Letters are lower-cased, as the tokenizer
    does, and go straight to its model, spelled in its alphabet of bytes. All other pieces take its
    whole way. Texts of a tokenizer of another kind are encoded whole.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.pieces = by_pieces(json.loads(definition))
        self.letters = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
        self.alphabet: dict[int, str] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first = np.zeros(1 << 16, np.int64)

    def spelled(self, letters: str) -> str:
        for x in set(letters) - ASCII_LETTERS:
            if ord(x) not in self.alphabet:
                normal = self.tokenizer.normalizer.normalize_str(x)
                self.alphabet[ord(x)] = "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return letters.translate(self.alphabet)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        out, rest, model = [], [], self.tokenizer.model
        for k, piece in enumerate(pieces):
            text = piece.decode("utf-8", "replace")
            if self.letters.fullmatch(text):
                out.append([x.id for x in model.tokenize(text if text.isascii() else self.spelled(text))])
            else:
                out.append([])
                rest.append((k, text))
        found = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        for (k, _), x in zip(rest, found):
            out[k] = x.ids
        return out

    def learn(self, pieces: list[bytes]) -> None:
        lists = self.ids_of(pieces)
        sizes = np.array([len(x) for x in lists], np.int64)
        n, new = len(self.known), int(sizes.sum())
        while self.used + new > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(lists) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + new] = np.fromiter(chain.from_iterable(lists), np.uint32, new)
        self.first[n + 1 : n + 1 + len(lists)] = self.used + np.cumsum(sizes)
        self.used += new
        self.known.update(zip(pieces, range(n, n + len(lists))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        if not self.pieces:
            texts = [data[lo:hi].tobytes().decode("utf-8", "replace") for lo, hi in zip(offsets[:-1], offsets[1:])]
            lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        body, starts, at = cut_pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = pa.py_buffer(np.append(starts, len(body)).astype(np.int64))
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(body)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBER:
            self.forget()
        found = list(map(self.known.get, distinct))
        fresh = [k for k, known in enumerate(found) if known is None]
        for number, k in enumerate(fresh, len(self.known)):
            found[k] = number
        self.learn([distinct[k] for k in fresh])
        place = np.array(found, np.int64)[coded.indices.to_numpy()]
        start, n = self.first[place], self.first[place + 1] - self.first[place]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(start - ends + n, n) + np.arange(int(ends[-1]))]
        return ids, np.diff(np.append(0, ends)[at])


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, where each begins, number of each row's first piece)."""
    words = cut_words(data, offsets)
    solid = ~SPACE[data]
    body = data[solid]
    size = words.ends - words.starts
    begin = np.cumsum(size) - size
    if not len(begin):
        return body, begin, np.zeros(len(offsets), np.int64)
    lead = (body >= 0xC3) & (body <= 0xC9)
    after = np.append(body[1:], np.uint8(0))
    lead &= ~((body == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((body == 0xC4) & (after == 0xB0))
    letter = LETTER[body] | lead
    letter[1:] |= lead[:-1]
    odd = ((body >= 0x80) & ~letter) | (body == 0x27) | (body == 0x7C)
    plain = np.repeat(np.add.reduceat(odd, begin, dtype=np.int64) == 0, size)
    fresh = np.zeros(len(body), bool)
    fresh[1:] = plain[1:] & (letter[1:] != letter[:-1])
    fresh[begin] = True
    starts = np.flatnonzero(fresh)
    body = np.where(plain, lower_ascii(body), body)
    return body, starts, np.searchsorted(starts, np.append(begin, len(body))[words.first])


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The rows' ids with the end id after each row."""
    return np.insert(ids, np.cumsum(counts), end) if len(counts) else ids


class FileWriter:
    """Writes one file: frames as documents come, directory and seek table at the end."""

    def __init__(self, filesystem: fs.FileSystem, path: str, width: int):
        self.out, self.width = filesystem.open_output_stream(path, compression=None), width
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.parts, self.waiting, self.entries, self.bytes = [], 0, [], 0
        self.docs, self.counts = [], []

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Whole documents: their ids, numbers of token ids, and those, joined."""
        self.docs.append(docs)
        self.counts.append(counts)
        cut, begun, lo = np.cumsum(counts), 0, 0
        while lo < len(counts):
            hi = min(int(np.searchsorted(cut, begun + FRAME_IDS - self.waiting)) + 1, len(counts))
            part = ids[begun : cut[hi - 1]]
            self.parts.append(part)
            self.waiting += len(part)
            begun, lo = int(cut[hi - 1]), hi
            if self.waiting >= FRAME_IDS:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.frame(np.concatenate(self.parts).astype(f"<u{self.width}").tobytes())
            self.parts, self.waiting = [], 0

    def frame(self, plain: bytes) -> None:
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.bytes += len(packed)
        self.entries.append(struct.pack(ENTRY, len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int, int, int]:
        """(smallest and largest document id, documents, ids)."""
        self.flush()
        docs, counts = np.concatenate(self.docs).astype("<i8"), np.concatenate(self.counts).astype("<i8")
        self.frame(struct.pack("<BB", VERSION, self.width) + docs.tobytes() + counts.tobytes())
        table = b"".join(self.entries) + struct.pack(FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return int(docs.min()), int(docs.max()), len(docs), int(counts.sum())


class FileReader:
    """Reads one file from its end; ``read`` counts the bytes taken."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.source, self.path, self.read = filesystem.open_input_file(path), path, 0
        size = self.source.size()
        frames, flags, magic = struct.unpack(FOOTER, self.take(size - FOOTER_BYTES, FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table with checksums")
        table = self.take(size - FOOTER_BYTES - frames * ENTRY_BYTES, frames * ENTRY_BYTES)
        entries = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.plain, self.check = entries.T
        self.at = np.cumsum(self.packed) - self.packed
        directory = self.frame(frames - 1)
        version, self.width = struct.unpack_from("<BB", directory)
        if version != VERSION:
            raise ValueError(f"{path} has version {version}")
        self.docs, self.counts = np.frombuffer(directory, "<i8", offset=2).reshape(2, -1)
        self.before = np.cumsum(self.counts) - self.counts
        self.frame_from = np.cumsum(self.plain[:-1] // self.width) - self.plain[:-1] // self.width

    def take(self, at: int, size: int) -> bytes:
        self.read += size
        return self.source.read_at(size, at)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self.take(int(self.at[k]), int(self.packed[k])))
        if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.check[k]:
            raise ValueError(f"frame {k} of {self.path} does not fit its checksum")
        return plain

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, ids before each in the file, numbers of ids, joined ids) of each frame that holds a wanted document."""
        some = np.ones(len(self.docs), bool) if wanted is None else np.isin(self.docs, wanted)
        frame = np.searchsorted(self.frame_from, self.before, "right") - 1
        for k in np.unique(frame[some]).tolist():
            ids = np.frombuffer(self.frame(k), f"<u{self.width}").astype("<u4")
            rows = np.flatnonzero(some & (frame == k))
            start, n = self.before[rows], self.counts[rows]
            if int(n.sum()) != len(ids):
                ends = np.cumsum(n)
                ids = ids[np.repeat(start - self.frame_from[k] - ends + n, n) + np.arange(int(ends[-1]))]
            yield self.docs[rows], start, n, ids


def write_token_files(
    docs: DataFrame, tokenizer: str, end: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts, append ``end`` to each, and write the files in ascending id order; returns their catalogue.

    ``tokenizer`` is the path of a definition whose tokens end at white space; the definition goes to the
    tasks. Files go under ``path``, which every executor must reach, by default a fresh folder of the shared one.
    The catalogue has ``part, seq, file, low, high, n_docs, n_ids`` and ``base``, the ids of all files before.
    Null and empty texts have the end id alone; a null id comes last; rows of one id go by a hash of the text. A long
    text is a frame of its own. An empty table has an empty catalogue.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size() - 1, end) < 1 << 16 else 4
    folder = path or scratch_path(spark, "token-files")
    shared = spark.sparkContext.broadcast(definition)
    frame_ids, file_bytes = FRAME_IDS, FILE_BYTES

    def task(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        part, made, writer, encoder, name = TaskContext.get().partitionId(), 0, None, None, ""

        def closed():
            row = (part, made, name, *writer.close())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS)], NAMES)

        for batch in batches:
            encoder = encoder or Encoder(shared.value)
            ids_of_rows = batch.column(0).to_numpy()
            for base, data, offsets in chunks(batch.column(1), CHUNK):
                ids, counts = encoder.encode(data, offsets)
                if writer is None:
                    name = f"{part:05}-{made:05}-{uuid.uuid4().hex}.ids.zst"
                    writer = FileWriter(filesystem, f"{root}/{name}", width)
                writer.add(ids_of_rows[base : base + len(counts)], counts + 1, with_end(ids, counts, end))
                if writer.bytes >= file_bytes:
                    yield closed()
                    made, writer = made + 1, None
        if writer is not None:
            yield closed()

    texts = keyed(docs, doc_id, text).select("doc", "text", "tag")
    ordered = texts.repartitionByRange("doc", "tag").sortWithinPartitions("doc", "tag").select("doc", "text")
    written = materialise(ordered.mapInArrow(task, CATALOGUE), "token-catalogue")
    named = written.withColumn("file", F.concat(F.lit(folder + "/"), "file"))
    return ordered_scan(named, [F.col("part"), F.col("seq")], sums={"base": "n_ids"})


NAMES = [x.split(" ")[0] for x in CATALOGUE.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]


def read_token_files(catalogue: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """``doc, start, n_tokens, ids``: documents from the files, ids as little-endian unsigned 32-bit integers.

    With ``wanted``, a bounded list of document ids, only files whose range holds one are opened, and
    only the frames with those documents are read and decompressed. Checksums are verified.
    """
    only = None if wanted is None else np.array(sorted(wanted), np.int64)
    files = catalogue.select("file", "base", "low", "high")
    if only is not None:
        inside = F.exists(F.lit(only.tolist()) if len(only) else F.array().cast("array<bigint>"), lambda d: (d >= F.col("low")) & (d <= F.col("high")))
        files = files.filter(inside)
    spread = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                filesystem, path = fs.FileSystem.from_uri(file)
                for docs, start, n, ids in FileReader(filesystem, path).documents(only):
                    ends = pa.py_buffer(np.append(0, np.cumsum(4 * n)).astype(np.int32))
                    body = pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(np.ascontiguousarray(ids))])
                    columns = [pa.array(docs), pa.array(start + base), pa.array(n), body]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "n_tokens", "ids"])

    schema = "doc long, start long, n_tokens long, ids binary"
    return files.repartition(spread, "file").mapInArrow(task, schema)
