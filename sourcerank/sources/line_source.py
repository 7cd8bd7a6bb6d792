"""A data source of text lines with their true numbers, read in byte splits.

A splittable scan does not know how many lines lie before a split.  So the files are planned
as byte ranges and read twice: the first scan counts the lines that begin in each range, a
running sum over the ranges of a file gives each its first number, and the second scan hands
out lines numbered from there.  Ranges of one file are read by different tasks both times;
between the scans only one row for each range is kept, in a table in the shared folder.
A task takes many small ranges, so that the number of tasks does not grow with them, and the
second scan reads ranges that follow each other as one.

A line ends with a line feed; a carriage return before it is cut off.  The last line needs
no end.  Bytes that are not UTF-8 become replacement characters.  Files whose name ends in
.gz, .bz2 or .zst are one range each, since they cannot be entered in the middle.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import shared_folder

SPLIT_BYTES = 64 << 20
# Ranges of fewer bytes are dealt to tasks together: so many tasks, but no share below the least.
_TASKS = 512
_LEAST_SHARE = 256 << 10
_CHUNK = 1 << 20
_ROWS = 8192
_PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
COUNTED = "file string, start long, stop long, lines long"
NUMBERED = "file string, line_no long, line string"


@dataclass
class Split(InputPartition):
    """Lines that begin in the bytes [start, stop) of a file; ``first`` is the number of the first one."""

    file: str
    start: int
    stop: int
    first: int = 1

    def __post_init__(self):
        super().__init__(self.file)


@dataclass
class Share(InputPartition):
    """The ranges that one task reads, one after the other."""

    splits: list[Split]

    def __post_init__(self):
        super().__init__(self.splits[0].file)


def shares(splits: list[Split], tasks: int = _TASKS, least: int = _LEAST_SHARE) -> list[Share]:
    """Ranges dealt to tasks in their order: about ``tasks`` of them, none above ``SPLIT_BYTES`` unless one range is."""
    total = sum(s.stop - s.start for s in splits)
    most = min(SPLIT_BYTES, max(least, total // tasks))
    dealt: list[list[Split]] = []
    held = most
    for s in splits:
        if held + s.stop - s.start > most:
            dealt.append([])
            held = 0
        dealt[-1].append(s)
        held += s.stop - s.start
    return [Share(d) for d in dealt]


def followed(splits: list[Split]) -> list[Split]:
    """Numbered ranges, those that begin where the one before ends as one."""
    out: list[Split] = []
    for s in splits:
        if out and out[-1].file == s.file and out[-1].stop == s.start:
            out[-1] = Split(s.file, out[-1].start, s.stop, out[-1].first)
        else:
            out.append(s)
    return out


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; a path without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def plan_splits(path: str, split_bytes: int, pattern: str = "*") -> list[Split]:
    """Byte ranges of a file, or of the files of a folder tree whose names match; hidden ones are left out."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    splits = []
    for f in sorted(files, key=lambda f: f.path):
        parts = f.path[len(inner) :].split("/")
        if not f.is_file or any(p[:1] in ("_", ".") for p in parts) or (not info.is_file and not fnmatch.fnmatch(f.base_name, pattern)):
            continue
        step = max(1, f.size if _codec(f.path) else split_bytes)
        splits += [Split(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
    return splits


def _codec(path: str) -> str | None:
    return next((c for ending, c in _PACKED.items() if path.endswith(ending)), None)


def _pieces(system: pafs.FileSystem, split: Split) -> Iterator[bytes]:
    """The bytes of the file from the split's start on; a split inside a file begins one byte early."""
    codec = _codec(split.file)
    source = system.open_input_stream(split.file, compression=codec) if codec else system.open_input_file(split.file)
    with source as f:
        if split.start:
            f.seek(split.start - 1)
        # A short range is not read far beyond its end; a line that goes on is read in growing pieces.
        size = _CHUNK if codec else min(_CHUNK, split.stop - split.start + 1)
        while piece := f.read(size):
            yield piece
            size = min(_CHUNK, 2 * size)


def split_lines(system: pafs.FileSystem, split: Split) -> Iterator[bytes]:
    """The lines that begin in a split, without their ends."""
    # The bytes up to the first line feed belong to a line that began before the split.
    skip = split.start > 0
    at = split.start - 1 if skip else 0
    stop = 1 << 62 if _codec(split.file) else split.stop
    left: list[bytes] = []
    for piece in _pieces(system, split):
        *lines, rest = piece.split(b"\n")
        for line in lines:
            if left:
                line = b"".join([*left, line])
                left = []
            if at >= stop:
                return
            at += len(line) + 1
            if skip:
                skip = False
            else:
                yield line[:-1] if line.endswith(b"\r") else line
        left.append(rest)
        if (at >= stop and not skip) or (skip and at + sum(map(len, left)) >= stop):
            return
    line = b"".join(left)
    if line and not skip and at < stop:
        yield line[:-1] if line.endswith(b"\r") else line


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.split_bytes = int(options.get("split_bytes", str(SPLIT_BYTES)))
        self.plan = options.get("plan")

    def partitions(self) -> list[Share]:
        if self.plan is None:
            return shares(plan_splits(self.path, self.split_bytes, self.pattern)) or [Share([Split("", 0, 0)])]
        # One row for each range, written by the first scan.
        system, inner = located(self.plan)
        table = pq.read_table(inner, filesystem=system, use_threads=False).sort_by([("file", "ascending"), ("start", "ascending")])
        splits = [Split(*r) for r in zip(*(table.column(c).to_pylist() for c in ("file", "start", "stop", "first")))]
        return [Share(followed(s.splits)) for s in shares(splits)] or [Share([Split("", 0, 0)])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        splits = [s for s in share.splits if s.file]
        if self.plan is not None:
            for split in splits:
                yield from self._numbered(system, split)
        elif splits:
            counts = [sum(1 for _ in split_lines(system, s)) for s in splits]
            columns = [pa.array([getattr(s, c) for s in splits]) for c in ("file", "start", "stop")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], ["file", "start", "stop", "lines"])

    def _numbered(self, system: pafs.FileSystem, split: Split) -> Iterator[pa.RecordBatch]:
        number, held, size = split.first, [], 0
        for line in split_lines(system, split):
            held.append(line.decode("utf-8", "replace"))
            size += len(line)
            if len(held) >= _ROWS or size >= _CHUNK:
                yield self._batch(split.file, number, held)
                number, held, size = number + len(held), [], 0
        if held:
            yield self._batch(split.file, number, held)

    def _batch(self, file: str, first: int, lines: list[str]) -> pa.RecordBatch:
        columns = [pa.array([file] * len(lines)), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "line_no", "line"])


class LineSource(DataSource):
    """``numbered_lines``: with option ``plan`` numbered lines, without it the count of each range."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return NUMBERED if "plan" in self.options else COUNTED

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


def count_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, pattern: str = "*") -> DataFrame:
    """(file, start, stop, lines, first): the byte ranges with the number of their first line."""
    spark.dataSource.register(LineSource)
    reader = spark.read.format("numbered_lines").option("path", path).option("pattern", pattern)
    counts = reader.option("split_bytes", str(split_bytes)).load()
    # A window over the ranges of one file: one row for each `split_bytes` of it.
    before = F.sum("lines").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    return counts.withColumn("first", F.coalesce(before, F.lit(0)) + 1)


def numbered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, pattern: str = "*") -> DataFrame:
    """(file, line_no, line): every line of the files at ``path``, blank ones too, numbered from 1 in its file."""
    plan = shared_folder(spark, "splits")
    count_splits(spark, path, split_bytes, pattern).write.parquet(plan)
    reader = spark.read.format("numbered_lines").option("path", path).option("plan", plan)
    return reader.load()
