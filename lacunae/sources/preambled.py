"""A Spark data source for CSV files whose header follows lines of preamble, files of any size.

    spark.dataSource.register(PreambledCsv)
    spark.read.format("preambled_csv").option("columns", '{"Time and Date": "time"}').load(path)

Files are cut into byte ranges, one partition each; a range reads the lines that begin in it, in blocks, so no file has to fit a task.
Each finds its file's header by itself: the first line of the file's first HEAD bytes that has the first wanted column among its cells;
names and order may differ from file to file. Of a line only the wanted columns are kept. A file that can't be read or has no such header
gives one row with the reason and nothing else, and doesn't stop the others.

Rows: file, at (the byte at which the line begins, so it orders the lines of a file), preamble (the file's first line), the columns as text
(null where the file has no such column or the line no such cell), reason. Cells may be quoted and then hold commas, but no line ends.
"""

from __future__ import annotations

import csv
import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = 1 << 16
BLOCK = 1 << 20
RANGE_BYTES = 64 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def place_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it of a URI or a local path."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def files_of(path: str) -> list[tuple[str, int]]:
    """Files and sizes below a folder, or of a file or a pattern of names in a folder. Names that begin with _ or . don't count."""
    fs, own = place_of(path)
    prefix = path[: len(path) - len(own)]
    info, pattern = fs.get_file_info(own), "*"
    if info.type == pyarrow.fs.FileType.NotFound and any(c in own for c in "*?["):
        own, _, pattern = own.rpartition("/")
        info = fs.get_file_info(own)
    if info.type == pyarrow.fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(own, recursive=True)) if f.type == pyarrow.fs.FileType.File]
    shown = [f for f in found if fnmatch.fnmatch(f.base_name, pattern) and not any(x[:1] in "_." for x in f.path[len(own) :].strip("/").split("/"))]
    return sorted((prefix + f.path, f.size) for f in shown)


def lines_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in [start, end), each with its place. start is a line's beginning, or else that line is another range's."""
    at, rest = start, b""
    if start:
        stream.seek(start - 1)
        at, rest = start - 1, b""
    else:
        stream.seek(0)
    skip = bool(start)
    while at < end:
        block = stream.read(BLOCK)
        rest += block
        *whole, rest = rest.split(b"\n")
        if not block:
            whole, rest = ([rest] if rest else []), b""
        for line in whole:
            if skip:
                skip = False
            elif at < end:
                yield at, line.removesuffix(b"\r")
            at += len(line) + 1
        if not block:
            return


def cells_of(line: bytes) -> list[str]:
    return [c.strip() for c in next(csv.reader([line.decode("utf-8", "replace")]), [])]


class PreambledReader(DataSourceReader):
    def __init__(self, path: str, columns: dict[str, str], range_bytes: int):
        self.path, self.columns, self.range_bytes = path, columns, range_bytes
        self.schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("preamble", pa.string()), *[(c, pa.string()) for c in columns.values()], ("reason", pa.string())])

    def partitions(self) -> list[Range]:
        return [Range(f, at, min(size, at + self.range_bytes)) for f, size in files_of(self.path) for at in range(0, max(size, 1), self.range_bytes)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        try:
            for row in self.rows(part):
                rows.append(row)
                if len(rows) == 10_000:
                    yield self.batch(rows)
                    rows = []
        except Exception as failed:  # noqa: BLE001  whatever is wrong with one file is told in its row
            rows.append((part.file, None, None, *[None] * len(self.columns), f"{type(failed).__name__}: {failed}"))
        if rows:
            yield self.batch(rows)

    def rows(self, part: Range) -> Iterator[tuple]:
        fs, own = place_of(part.file)
        with fs.open_input_file(own) as stream:
            wanted, first, header = list(self.columns), None, None
            for at, line in lines_of(stream, 0, HEAD):
                cells = cells_of(line)
                first = line.decode("utf-8", "replace") if first is None else first
                if wanted[0] in cells:
                    header, begin = cells, at + len(line) + 1
                    break
            if header is None:
                if part.start == 0:
                    yield part.file, None, first, *[None] * len(wanted), "no such header"
                return
            places = [header.index(w) if w in header else None for w in wanted]
            if part.end <= begin:
                return
            for at, line in lines_of(stream, part.start if part.start >= begin else 0, part.end):
                if at >= begin and line:
                    cells = cells_of(line)
                    yield part.file, at, first, *[cells[k] if k is not None and k < len(cells) else None for k in places], None

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class PreambledCsv(DataSource):
    """Options: path; columns, a JSON object of the files' column names and ours; rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "preambled_csv"

    def columns(self) -> dict[str, str]:
        return json.loads(self.options["columns"])

    def schema(self) -> str:
        return ", ".join(["file string", "at bigint", "preamble string", *[f"`{c}` string" for c in self.columns().values()], "reason string"])

    def reader(self, schema) -> DataSourceReader:
        return PreambledReader(self.options["path"], self.columns(), int(self.options.get("rangeBytes", RANGE_BYTES)))
