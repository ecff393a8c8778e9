"""Lines of text files by byte range: where each line is, and reading only wanted ones.

``line_ranges`` is a data source whose partitions are byte ranges of the files, so that a line's
place is known from the bytes before it in its range alone, with no running sum over a file.
``read_ranges`` reads lines by their places, neighbouring ones in one go. Paths are URIs that
``pyarrow.fs`` opens; a path without scheme is local.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 32 << 20
#: Bytes read at a time where the end of a line is searched.
STEP = 1 << 20
#: Wanted lines with at most so many bytes between them are read together.
GAP = 4 << 10
#: Bytes read in one go, unless a single line is longer.
MOST = 8 << 20
NEWLINE = 10


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, also in the form ``file:/folder``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def text_files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of the data files under a path, hidden ones left out."""
    system, place = file_system(path)
    found = [system.get_file_info(place)]
    if found[0].type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path[: path.index(":") + 1] + "//" if ":" in path else ""
    names = [(x.path, x.size) for x in found if x.type == fs.FileType.File]
    plain = [(p, n) for p, n in names if not any(part[:1] in "._" for part in p.removeprefix(place).split("/") if part)]
    return [(prefix + p if prefix else p, n) for p, n in sorted(plain)]


def newline_from(file, at: int, size: int) -> int:
    """Place of the first newline at or after ``at``; the file's size if there is none."""
    while at < size:
        part = file.read_at(min(STEP, size - at), at)
        found = part.find(b"\n")
        if found >= 0:
            return at + found
        at += len(part)
    return size


def lines_starting_in(file, begin: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(starts, ends, bytes, place of the first byte) of the lines that begin in [begin, end)."""
    first = newline_from(file, begin - 1, size) + 1 if begin else 0
    none = np.zeros(0, np.int64)
    if first >= min(end, size):
        return none, none, np.zeros(0, np.uint8), first
    last = newline_from(file, end - 1, size)
    data = np.frombuffer(file.read_at(last - first, first), np.uint8)
    stops = np.append(np.flatnonzero(data == NEWLINE), len(data)) + first
    starts = np.append(first, stops[:-1] + 1)
    if starts[-1] == size:  # the file ends with a newline
        starts, stops = starts[:-1], stops[:-1]
    return starts, stops, data, first


def line_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lines at places of ``data`` that ascend, without a carriage return at the end."""
    cut = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 13) if len(data) else np.zeros(len(starts), bool)
    sizes = ends - cut - starts
    stops = np.cumsum(sizes)
    body = data[np.repeat(starts - stops + sizes, sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
    offsets = pa.py_buffer(np.append(0, stops).astype(np.int64))
    lines = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(np.ascontiguousarray(body))])
    return lines.cast(pa.binary()).cast(pa.string())


class LineRanges(DataSource):
    """``file, start, end, line`` of all lines under ``path``; ``line`` is null with the option ``text=false``.

    ``end`` is the place of the newline. ``block_bytes`` sets the size of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "file string, start bigint, end bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return LineRangeReader(self.options)


class ByteRange(InputPartition):
    def __init__(self, file: str, begin: int, end: int, size: int):
        super().__init__(None)
        self.file, self.begin, self.end, self.size = file, begin, end, size


class LineRangeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.block = int(options.get("block_bytes", BLOCK_BYTES))
        self.text = options.get("text", "true") != "false"

    def partitions(self) -> list[InputPartition]:
        out = []
        for file, size in text_files(self.path):
            out += [ByteRange(file, at, min(at + self.block, size), size) for at in range(0, size, self.block)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, place = file_system(partition.file)
        with system.open_input_file(place) as file:
            starts, ends, data, first = lines_starting_in(file, partition.begin, partition.end, partition.size)
        for lo in range(0, len(starts), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            n = len(starts[some])
            lines = line_column(data, starts[some] - first, ends[some] - first) if self.text else pa.nulls(n, pa.string())
            files = pa.array([partition.file] * n, pa.string())
            yield pa.RecordBatch.from_arrays([files, pa.array(starts[some]), pa.array(ends[some]), lines], ["file", "start", "end", "line"])


def scan_line_ranges(spark: SparkSession, path: str, text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, start, end, line`` of the text files under ``path``."""
    spark.dataSource.register(LineRanges)
    options = {"text": str(text).lower(), "block_bytes": block_bytes}
    return spark.read.format("line_ranges").options(**options).load(path)


def runs_of(starts: np.ndarray, ends: np.ndarray) -> list[slice]:
    """Ascending ranges in groups to read in one go: little between them, bounded bytes in all."""
    out, lo = [], 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or starts[k] - ends[k - 1] > GAP or ends[k] - starts[lo] > MOST:
            out.append(slice(lo, k))
            lo = k
    return out


def read_ranges(spans: DataFrame, file: str = "file", start: str = "start", end: str = "end", line: str = "line") -> DataFrame:
    """``spans`` with ``line``, the bytes [start, end) of each row's file as text, and ``bytes_read``.

    Rows go by range of (file, start), so that a task opens few files and reads forward; ``bytes_read``
    holds on the first row of each run what the run took.
    """
    at = [spans.columns.index(c) for c in (file, start, end)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            files = batch.column(at[0]).to_pylist()
            starts, ends = (batch.column(i).to_numpy(zero_copy_only=False) for i in at[1:])
            begin = [0, *[k for k in range(1, len(files)) if files[k] != files[k - 1]], len(files)]
            texts, taken = [], np.zeros(len(files), np.int64)
            for lo, hi in zip(begin[:-1], begin[1:]):
                if lo == hi:
                    continue
                if files[lo] != opened:
                    system, place = file_system(files[lo])
                    opened, source = files[lo], system.open_input_file(place)
                for run in runs_of(starts[lo:hi], ends[lo:hi]):
                    some = slice(lo + run.start, lo + run.stop)
                    base = int(starts[some][0])
                    data = np.frombuffer(source.read_at(int(ends[some].max()) - base, base), np.uint8)
                    taken[some.start] = len(data)
                    texts.append(line_column(data, starts[some] - base, ends[some] - base))
            lines = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lines, pa.array(taken)], [*batch.schema.names, line, "bytes_read"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)
    ordered = spans.repartitionByRange(F.col(file), F.col(start)).sortWithinPartitions(file, start)
    return ordered.mapInArrow(task, f"{schema}, `{line}` string, bytes_read bigint")
