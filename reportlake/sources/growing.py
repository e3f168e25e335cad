"""Files that grow while they are read.

``growing_lines`` is a streaming source whose offset is a byte position for each file: a micro-batch holds the whole lines
that were appended since the last one, whatever their files' size, and a line that is still being written waits for its line
break. Byte ranges of about ``part_bytes`` are one task each; a range holds the lines that begin in it.

Columns: ``file_path``, ``block_start`` (where the range begins) and ``line``, as the readers of closed files give them. A
range that doesn't begin its file also gives the file's first line, at block_start -1: the layout that
:func:`reportlake.sources.report_files.file_layouts` needs and no row.

Files are reached through ``pyarrow.fs`` (paths, or URIs such as ``file:``, ``s3:``, ``hdfs:``) by the driver and all executors.
A file that shrinks is an error: it was replaced, not appended to.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PART_BYTES = 32 << 20
_STEP = 1 << 20


class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def _after_break(f: pa.NativeFile, low: int, high: int) -> int:
    """Where the last whole line of [low, high) ends, ``low`` if no line does."""
    while high > low:
        at = max(low, high - _STEP)
        f.seek(at)
        found = f.read(high - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


def _lines(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), without their line breaks."""
    if end <= start:
        return
    tail, base, skip = b"", start, False
    if start:
        f.seek(start - 1)
        skip = f.read(1) != b"\n"  # the line before reaches in
    f.seek(start)
    while base < end:
        block = f.read(_STEP)
        *whole, tail = (tail + block).split(b"\n")
        for line in whole:
            if base >= end:
                return
            if not skip:
                yield line.removesuffix(b"\r")
            skip, base = False, base + len(line) + 1
        if not block:
            return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, part_bytes: int):
        self.path, self.pattern, self.part_bytes = path, pattern, part_bytes

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return {x.path: x.size for x in found if x.is_file and fnmatch.fnmatch(x.base_name, self.pattern)}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file; only what follows the last offset asked for is looked at."""
        seen = getattr(self, "_seen", {})
        fs, _ = _opened(self.path)
        ends = {}
        for path, size in sorted(self._files().items()):
            low = seen.get(path, 0)
            if size > low:
                with fs.open_input_file(path) as f:
                    low = _after_break(f, low, size)
            if low:
                ends[path] = low
        self._seen = ends
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, high in end.items():
            low = start.get(path, 0)
            if high < low:
                raise ValueError(f"{path} is shorter than what was read of it")
            out += [Range(path, a, min(a + self.part_bytes, high)) for a in range(low, high, self.part_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        with fs.open_input_file(partition.path) as f:
            held, size = [], 0
            names = ["file_path", "block_start", "line"]

            def batch(rows: list[bytes], at: int) -> pa.RecordBatch:
                text = pa.array([x.decode("utf-8", "replace") for x in rows], pa.string())
                return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([at] * len(rows), pa.int64()), text], names=names)

            if partition.start:
                head = next((x for x in _lines(f, 0, partition.start) if x.strip()), None)
                if head is not None:
                    yield batch([head], -1)
            for line in _lines(f, partition.start, partition.end):
                held.append(line)
                size += len(line)
                if size > _STEP:
                    yield batch(held, partition.start)
                    held, size = [], 0
            if held:
                yield batch(held, partition.start)


class GrowingLines(DataSource):
    """Options: ``path`` (a folder), ``pattern`` of file names (``*.csv``), ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file_path string, block_start long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], self.options.get("pattern", "*.csv"), int(self.options.get("part_bytes", PART_BYTES)))


def growing_lines(spark: SparkSession, path: str, pattern: str = "*.csv", part_bytes: int = PART_BYTES) -> DataFrame:
    """Streaming lines appended to the files of a folder, for :func:`reportlake.streaming.reports.ingest_stream`."""
    from reportlake.session import ship_package

    ship_package(spark)
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", path).option("pattern", pattern)
    return reader.option("part_bytes", str(part_bytes)).load()
