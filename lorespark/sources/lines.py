"""Lines of growing files, exact to the byte: cut before they are decoded, so that a byte that is no UTF-8 neither ends a job nor moves a cursor.

A line ends with its line break. What follows the last one is unfinished and waits, unless it is whole JSON. A file that is shorter than its cursor was cut off or replaced: it is read from its
start again. ``new_lines`` reads on from a table of cursors; ``LineSource`` is the same as a data source, for batches and for streams, whose offsets are the cursors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bounds of one read of a file, and of one stop of a stream over all files.
BATCH_ROWS, BATCH_BYTES, STOP_BYTES = 200, 1 << 20, 64 << 20
LINE = "path string, start bigint, end bigint, value string, valid boolean, fresh boolean"


def whole_json(tail: bytes) -> bool:
    try:
        json.loads(tail)
    except (ValueError, RecursionError):
        return False
    return True


def cut(content: bytes, at: int, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines from byte ``at`` on, at most ``rows`` and ``size`` bytes, one line at least; blank lines count and are given."""
    first, n = at, 0
    while at < len(content) and n < rows:
        end = content.find(b"\n", at) + 1
        if not end:
            if not content[at:].strip() or not whole_json(content[at:]):
                return
            end = len(content)
        if n and end - first > size:
            return
        yield at, end
        at, n = end, n + 1


def told(line: bytes) -> tuple[str, bool]:
    """A line's text without its break, and whether all of it is UTF-8; what is not is replaced by marks."""
    line = line.removesuffix(b"\n").removesuffix(b"\r")
    try:
        return line.decode(), True
    except UnicodeDecodeError:
        return line.decode(errors="replace"), False


def new_lines(files: DataFrame, cursors: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, start, value, end, valid, fresh) of lines behind each file's cursor, and the cursors (path, offset) behind them. A read has at most ``rows`` lines and ``size`` bytes of a file,
    one line at least; blank lines give no row and move the cursor. valid: the line is UTF-8; fresh: the file was read from its start since it is shorter than its cursor. files: path, content
    (binary); cursors: path, offset in bytes. Each file is read by itself, whatever others hold."""
    known = cursors.groupBy("path").agg(F.max("offset").cast("bigint").alias("offset"))

    def run(batches):
        for batch in batches:
            out = []
            for path, offset, content in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "content")), strict=True):
                content, offset = content or b"", offset or 0
                fresh = offset > len(content)
                at = 0 if fresh else offset
                for start, end in cut(content, at, rows, size):
                    at = end
                    if content[start:end].strip():
                        out.append((path, start, end, *told(content[start:end]), fresh))
                out.append((path, None, at, None, None, fresh))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "start", "end", "value", "valid", "fresh"])

    got = files.select("path", "content").join(known, "path", "left").select("path", "offset", "content").mapInArrow(run, LINE)
    return got.where("start is not null").select("path", "start", "value", "end", "valid", "fresh"), got.where("start is null").select("path", F.col("end").alias("offset"))


# ---- the data source -------------------------------------------------------------------------------


def _open(path: str):
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> dict[str, int]:
    """Files under a folder (or one file), and their sizes."""
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        return {}
    if info.type == pafs.FileType.File:
        return {info.path: info.size}
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix)}


def _last_end(fs, path: str, size: int, block: int = 1 << 16) -> int:
    """Where the last whole line of a file's first ``size`` bytes ends."""
    with fs.open_input_file(path) as f:
        tail, at = b"", size
        while at > 0:
            step = min(block, at)
            part = f.read_at(step, at - step)
            hit = part.rfind(b"\n")
            if hit >= 0:
                at, tail = at - step + hit + 1, part[hit + 1 :] + tail
                break
            at, tail, block = at - step, part + tail, block * 2
    return size if tail.strip() and whole_json(tail) else at


class Span(InputPartition):
    """The lines of a file that start in [start, end); ``stop``: where its whole lines end."""

    def __init__(self, path: str, start: int, end: int, stop: int, fresh: bool, first: bool):
        self.path, self.start, self.end, self.stop, self.fresh, self.first = path, start, end, stop, fresh, first


def _spans(path: str, start: int, stop: int, fresh: bool, size: int = BATCH_BYTES) -> list[Span]:
    return [Span(path, a, min(a + size, stop), stop, fresh, a == start) for a in range(start, stop, size)]


def _read(root: str, span: Span) -> Iterator[tuple]:
    fs, _ = _open(root)
    with fs.open_input_file(span.path) as f:
        at, rest, far = span.start, b"", span.start
        if not span.first:  # the line under way belongs to the span before
            at = far = span.start - 1
        skip = not span.first
        while at < span.end:
            hit = rest.find(b"\n")
            while hit < 0 and far < span.stop:
                part = f.read_at(min(1 << 18, span.stop - far), far)
                if not part:
                    break
                far += len(part)
                seen = len(rest)
                rest += part
                hit = rest.find(b"\n", seen)
            end = hit + 1 if hit >= 0 else len(rest)
            line, rest = rest[:end], rest[end:]
            if not line:
                return
            if not skip and line.strip():
                yield span.path, at, at + len(line), *told(line), span.fresh
            at, skip = at + len(line), False


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")

    def partitions(self) -> list[Span]:
        fs, _ = _open(self.path)
        return [s for p, n in sorted(_files(self.path, self.suffix).items()) for s in _spans(p, 0, _last_end(fs, p, n), False)] or [Span("", 0, 0, 0, False, True)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _read(self.path, partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the cursors of files, each with the number of times the file was begun anew. A stop takes STOP_BYTES of all files at most, one line of each at least; the first stop of a run, which
    does not know yet where the last run ended, takes what there is."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.most = options["path"], options.get("suffix", ".jsonl"), int(options.get("stopBytes", STOP_BYTES))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = _open(self.path)
        out, left = dict(self.at or {}), self.most
        for path, size in sorted(_files(self.path, self.suffix).items()):
            start = (self.at or {}).get(path, 0)
            begun = start if size >= start else 0
            stop = _last_end(fs, path, size)
            if self.at is not None and stop - begun > left:
                stop = max(_last_end(fs, path, begun + max(0, left)), begun)
            left -= stop - begun
            # a file that shrank is begun anew even where nothing can be taken yet
            out[path] = stop if stop > begun or size < start else start
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = self.at or dict(end)
        spans = []
        for path, stop in end.items():
            begun = start.get(path, 0)
            fresh = stop < begun
            spans += _spans(path, 0 if fresh else begun, stop, fresh)
        return spans or [Span("", 0, 0, 0, False, True)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _read(self.path, partition) if partition.path else iter(())


class LineSource(DataSource):
    """``spark.read.format("byte_lines")`` and ``spark.readStream...``: path, start, end, value, valid, fresh of whole lines of files under ``path`` (option ``suffix``: .jsonl); read in spans of
    1 MiB by the executors. On a stream, option ``stopBytes`` bounds a stop."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineSource)
