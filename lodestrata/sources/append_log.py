"""Format `append_log`: lines of append-only files, read by byte offsets, as a stream or a batch.

A poll takes what has been appended to each file since the last one, up to the
last whole line; a line whose end isn't written yet waits. What is taken is cut
into ranges of bytes, which tasks read side by side: a line belongs to the range
in which its first byte lies. The offsets are the checkpoint's, so a query that
starts again gives each line once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, bytes that are read at once, lines of a batch.
RANGE_BYTES, READ_BYTES, BATCH_LINES = 32 << 20, 1 << 20, 8192
SCHEMA = "file string, byte_offset long, line string"


class ByteRange(InputPartition):
    """Lines whose first byte lies in [lo, hi) of a file that is read up to end; lo is a line's beginning if first is true."""

    def __init__(self, file: str, lo: int, hi: int, end: int, first: bool):
        self.file, self.lo, self.hi, self.end, self.first = file, lo, hi, end, first


class AppendLog(DataSource):
    """Options: path (a folder or a file, on any file system that pyarrow opens), suffix (.jsonl), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


class _Files:
    def __init__(self, options: dict):
        self.uri, self.suffix, self.step = options["path"], options.get("suffix", ".jsonl"), int(options.get("rangeBytes", RANGE_BYTES))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if self.uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def ends(self, since: dict[str, int]) -> dict[str, int]:
        """Of each file, where its last whole line ends; a file that is shorter than what was read of it is refused."""
        fs, root = self._open()
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return dict(since)
        listed = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]
        out = dict(since)
        for f in listed:
            read = since.get(f.path, 0)
            if f.size < read:
                raise ValueError(f"{f.path} has shrunk from {read} to {f.size} bytes; an append-only file can't")
            out[f.path] = self._last_line(fs, f.path, read, f.size) if f.size > read else read
        return out

    def _last_line(self, fs: pafs.FileSystem, path: str, read: int, size: int) -> int:
        with fs.open_input_file(path) as file:
            hi = size
            while hi > read:
                lo = max(read, hi - READ_BYTES)
                at = file.read_at(hi - lo, lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                hi = lo
        return read

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[ByteRange]:
        return [ByteRange(f, lo, min(lo + self.step, stop), stop, lo == start.get(f, 0)) for f, stop in sorted(end.items()) for lo in range(start.get(f, 0), stop, self.step)]

    def lines(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        """The lines of a range; a byte that is no UTF-8 becomes the replacement character, empty lines are left out."""
        if part is None:  # nothing to read
            return
        fs, _ = self._open()
        offsets, said = [], []
        with fs.open_input_file(part.file) as file:
            at, held, skip = (part.lo, b"", False) if part.first else (part.lo - 1, b"", True)
            where = at
            while where < part.end and (not held or at < part.hi):
                block = file.read_at(min(READ_BYTES, part.end - where), where)
                if not block:
                    break
                where += len(block)
                *whole, held = (held + block).split(b"\n")
                for line in whole:
                    if skip:  # the line that ends here began in the range before
                        skip = False
                    elif at < part.hi:
                        text = line.removesuffix(b"\r")
                        if text:
                            offsets.append(at)
                            said.append(text.decode("utf-8", "replace"))
                    at += len(line) + 1
                    if len(said) >= BATCH_LINES:
                        yield _batch(part.file, offsets, said)
                        offsets, said = [], []
                if at >= part.hi:
                    break
        if said:
            yield _batch(part.file, offsets, said)


def _batch(file: str, offsets: list[int], said: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(said), pa.string()), pa.array(offsets, pa.int64()), pa.array(said, pa.string())], names=["file", "byte_offset", "line"])


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[ByteRange]:
        return self.files.ranges({}, self.files.ends({}))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.files.lines(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.last = _Files(options), {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self.last = self.files.ends(self.last)
        return self.last

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        shrunk = [f for f, n in start.items() if end.get(f, n) < n]
        if shrunk:
            raise ValueError(f"{shrunk[0]} has shrunk below what was read of it; an append-only file can't")
        return self.files.ranges(start, end)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.files.lines(partition)

    def commit(self, end: dict) -> None:
        pass


def tail(spark: SparkSession, path: str, schema: str, stream: bool = True, **options: str) -> DataFrame:
    """Rows of schema from JSON lines of append-only files, with file and byte_offset; a line that is no JSON object is left out."""
    spark.dataSource.register(AppendLog)
    lines = (spark.readStream if stream else spark.read).format("append_log").option("path", path).options(**options).load()
    told = lines.select("file", "byte_offset", F.from_json("line", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return told.where("r is not null and r.__bad is null").select("file", "byte_offset", "r.*").drop("__bad")
