"""Attribute text as a data source: ``spark.read.format("attribute_text")``, also to write and to stream.

Files are cut into byte ranges. A range has the sequences that begin in it: its reader goes on to the first
line behind an empty one, and over its end to that of the last sequence. Lines end in LF, CRLF or CR, and any
number of empty lines parts sequences. A sequence is numbered by the byte at which it begins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "attribute_text"
SCHEMA = "grp string, block long, pos int, label string, feats array<struct<attr:string,value:double>>"
#: Bytes of a range, and bytes that are read at a time.
RANGE = 64 << 20
CHUNK = 1 << 20
#: Rows of a batch.
ROWS = 4096
LINE_END = re.compile(rb"\r\n|\n|\r")
#: The name of a field, up to a colon without a backslash, and a number behind it.
FIELD = re.compile(r"((?:[^:\\]|\\.|\\$)*)(?::(.*))?", re.S)
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
ESCAPED = re.compile(r"\\([:\\])")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path)) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def files(path: str) -> list[fs.FileInfo]:
    """The files of a folder, or the file itself; names that begin with _ or . are passed over."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = re.compile(r"/[_.]")
    return sorted((f for f in found if f.is_file and not hidden.search(f.path[len(inner) :])), key=lambda f: f.path)


# -- lines and sequences of a range


def lines(source, begin: int) -> Iterator[tuple[int, bytes]]:
    """Lines with the places at which they begin, from a place on at which one does."""
    source.seek(begin)
    held, more = b"", True
    while more:
        new = source.read(CHUNK)
        more = bool(new)
        held += new
        at = 0
        for end in LINE_END.finditer(held):
            if more and end.end() == len(held):
                break  # a CR may be half of a line end
            yield begin + at, held[at : end.start()]
            at = end.end()
        begin, held = begin + at, held[at:]
    if held:
        last = LINE_END.search(held)
        yield begin, held[: last.start()] if last else held


def first_line(source, begin: int) -> tuple[int, bool]:
    """Where the first line begins that does not begin before a place, and whether an empty one is before it."""
    if not begin:
        return 0, True
    at = max(0, begin - 6)
    before = -1 if at else 0  # where the line end before ended
    source.seek(at)
    held, more = b"", True
    while more:
        new = source.read(CHUNK)
        more = bool(new)
        held += new
        seen = 0
        for end in LINE_END.finditer(held):
            if more and end.end() == len(held):
                break  # a CR may be half of a line end
            if at + end.end() >= begin:
                return at + end.end(), at + end.start() == before
            seen = end.end()
            before = at + seen
        # what is left is the beginning of a line; of a long one its end is enough
        cut = max(seen, len(held) - 2)
        at, held = at + cut, held[cut:]
    return at + len(held), False


def sequences(source, begin: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """The sequences that begin in a range: the place of the first line and all lines."""
    at, fresh = first_line(source, begin)
    first, held = -1, []
    for place, line in lines(source, at):
        if not line:
            if held:
                yield first, held
            first, held, fresh = -1, [], True
            if place >= end:
                return
        elif held:
            held.append(line)
        elif fresh:
            if place >= end:
                return
            first, held, fresh = place, [line], False
        elif place >= end:
            return  # the range has a sequence of an earlier one alone
    if held:
        yield first, held


def parsed(line: bytes) -> tuple[str, list[dict]] | None:
    """Label and attributes of a line; None for one without a label. A value that is not written is 1, one that is no number null."""
    fields = [f for f in line.decode("utf-8", "replace").split("\t") if f]
    if not fields:
        return None
    out = []
    for field in fields:
        name, value = FIELD.match(field).groups()
        number = 1.0 if value is None else float(value) if NUMBER.fullmatch(value) else None
        out.append({"attr": ESCAPED.sub(r"\1", name), "value": number})
    return (out[0]["attr"], out[1:]) if out[0]["attr"] else None


def rows_of(path: str, begin: int, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    system, inner = opened(path)
    out: list[dict] = []
    with system.open_input_file(inner) as source:
        for block, held in sequences(source, begin, end):
            for pos, line in enumerate(held):
                if item := parsed(line):
                    out.append({"grp": path, "block": block, "pos": pos, "label": item[0], "feats": item[1]})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


ARROW = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("pos", pa.int32()), ("label", pa.string()), ("feats", pa.list_(pa.struct([("attr", pa.string()), ("value", pa.float64())])))])


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _ranges(found: list[fs.FileInfo], size: int) -> list[Range]:
    return [Range(f.path, at, min(at + size, f.size)) for f in found for at in range(0, f.size, size)]


# -- what Spark asks for


class AttributeText(DataSource):
    """Options: ``path``, and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _prefix(self) -> str:
        """What the file system takes off a path."""
        scheme = re.match(r"\w+://[^/]*", self.options["path"])
        return scheme[0] if scheme and opened(self.options["path"])[0].type_name != "local" else ""

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._prefix(), int(self.options.get("rangeBytes", RANGE)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._prefix(), int(self.options.get("rangeBytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, prefix: str, size: int):
        self.path, self.prefix, self.size = path, prefix, size

    def partitions(self) -> list[Range]:
        return _ranges(files(self.path), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.prefix + partition.path, partition.begin, partition.end, ARROW)


class _StreamReader(DataSourceStreamReader):
    """Files that have come since; an offset is the time and the name of the last one."""

    def __init__(self, path: str, prefix: str, size: int):
        self.path, self.prefix, self.size = path, prefix, size

    def initialOffset(self) -> dict:
        return {"last": [0, ""]}

    def _files(self) -> list[tuple[list, fs.FileInfo]]:
        return sorted((([f.mtime_ns or 0, f.path], f) for f in files(self.path)), key=lambda x: x[0])

    def latestOffset(self) -> dict:
        found = self._files()
        return {"last": found[-1][0]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([f for at, f in self._files() if start["last"] < at <= end["last"]], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        for batch in rows_of(self.prefix + partition.path, partition.begin, partition.end, ARROW):
            for row in batch.to_pylist():
                yield (row["grp"], row["block"], row["pos"], row["label"], [(f["attr"], f["value"]) for f in row["feats"]])


@dataclass
class _Written(WriterCommitMessage):
    path: str


def line_of(label: str, feats: list) -> str:
    """A line of text; the value 1 is left out."""
    def escaped(text: str) -> str:
        return re.sub(r"([:\\])", r"\\\1", text)

    return "\t".join([escaped(label), *(escaped(f["attr"]) + ("" if f["value"] is None or f["value"] == 1 else f":{f['value']!r}") for f in feats or [])])


class _Writer(DataSourceWriter):
    """Rows (seq, pos, label, feats), those of a sequence one after another. Files appear when all of them are written."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> _Written:
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/_temporary")
        path = f"{inner}/_temporary/part-{uuid.uuid4().hex}.txt"
        last = None
        with system.open_output_stream(path) as out:
            for row in iterator:
                if last is not None and row["seq"] != last:
                    out.write(b"\n")
                last = row["seq"]
                out.write((line_of(row["label"], row["feats"]) + "\n").encode())
        return _Written(path)

    def commit(self, messages: list) -> None:
        system, inner = opened(self.path)
        if self.overwrite:
            for old in files(self.path):
                system.delete_file(old.path)
        for m in messages:
            if m is not None and system.get_file_info(m.path).size:
                system.move(m.path, m.path.replace("/_temporary/", "/"))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, inner = opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.path).is_file:
                system.delete_file(m.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AttributeText)


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """``grp, block, pos, label, feats`` of the files under a path."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(path)


def save(rows: DataFrame, path: str) -> None:
    """Write (seq, pos, label, feats); sequences are brought together and put in order of pos."""
    register(rows.sparkSession)
    held = rows.select("seq", "pos", "label", "feats").repartition("seq").sortWithinPartitions("seq", "pos")
    held.write.format(NAME).mode("append").save(path)
