"""Line dedup with content-defined chunks: repeated multi-line chunks are removed after byte comparison.

A rolling hash, two lines wide, runs over the hashes of the lines that hold text. A boundary stands
between two lines wherever their window's hash is found nowhere else, so chunks are the longest runs
of lines that other places share: nothing outside a shared passage moves its boundaries, and a passage
of two lines is found as one of many. (Boundaries at local minima of the rolling hash, as usual for
chunks, depend on lines around the passage and miss most passages of a few lines.) Lines of white
space make no chunk and go with the chunk that they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seqloom.llm.common import Carried, flat, from_offsets, fresh, quoted, range_hashes, slices, sums, whole_text, write_table

#: Bytes of white space.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Lines:
    """The lines of some texts: byte starts and ends, the texts' bounds in lines, and the numbers of lines with text."""

    def __init__(self, texts: pa.Array):
        self.buf, self.off = flat(texts)
        breaks = np.flatnonzero(self.buf == 10)
        self.starts = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([self.off[1:], breaks]), kind="stable")
        self.bounds = np.concatenate([[0], np.cumsum(1 + np.searchsorted(breaks, self.off[1:]) - np.searchsorted(breaks, self.off[:-1]))])
        ink = np.concatenate([[0], np.cumsum(~BLANK[self.buf], dtype=np.int64)])
        self.full = np.flatnonzero(ink[self.ends] > ink[self.starts])
        self.text = np.searchsorted(self.bounds, self.full, side="right") - 1  # whose they are

    def hashes(self, bits: int = 64) -> np.ndarray:
        """Hashes of the lines with text; fewer bits only to try the byte comparison."""
        found = range_hashes(self.buf, self.starts[self.full], self.ends[self.full])
        return (found & np.uint64((1 << bits) - 1)).view(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``full`` where a window begins, its text, and the first line of it, counted in the text."""
        at = np.flatnonzero(self.text[1:] == self.text[:-1])
        return at, self.text[at], self.full[at] - self.bounds[self.text[at]]

    def of(self, lists: pa.Array) -> np.ndarray:
        """Places in ``full`` of the windows whose first lines the lists name, text by text."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        lines = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.searchsorted(self.full, np.repeat(self.bounds[:-1], sizes) + lines)

    def without(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts without the windows' lines (and those between), and how many lines each text lost."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(edge, self.full[windows], 1)
        np.add.at(edge, self.full[windows + 1] + 1, -1)
        stays = np.cumsum(edge[:-1]) == 0
        lost = sums((~stays).astype(np.int64), self.bounds)
        kept = np.flatnonzero(stays)
        owner = np.searchsorted(self.bounds, kept, side="right") - 1
        # a line that is not the first one left takes the line break before it along
        led = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(kept) else np.zeros(0, bool)
        mark = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(mark, self.starts[kept] - led, 1)
        np.add.at(mark, self.ends[kept], -1)
        keep = np.cumsum(mark[:-1]) > 0
        return self.buf[keep], np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[self.off], lost


def _fingerprint(text: str) -> Column:
    """What tells rows of one key apart."""
    return F.unhex(F.md5(whole_text(text)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and ``n_lines``, ``n_removed`` (lines).

    A chunk stays where it stands first, by key (null last), then text (by digest), then place in the
    text, and goes everywhere else, in one document too; a line's first place is never removed. Of
    rows equal in key and text one is first. Texts with less than two lines that hold text have no
    chunks and stay; a copy of a whole text ends empty, or with what blank lines it began and ended.
    A null text counts as empty and stays null. Columns that have the names of results are replaced;
    any other column keeps its name and values. Empty tables give empty tables.
    """
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    equal = docs.select(quoted(key).alias("k"), _fingerprint(text).alias("p")).groupBy("k", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "p")
    equal = write_table(equal, "equal_rows")
    if equal.isEmpty():
        return _dedup(docs, key, text, bits)
    # rows equal in key and text: a written number says which is first, the others lose all their chunks
    mark, row = fresh(docs.columns, "print"), fresh(docs.columns, "row")
    told = docs.withColumn(mark, _fingerprint(text))
    on = quoted(key).eqNullSafe(equal["k"]) & told[mark].eqNullSafe(equal["p"])
    held = write_table(told.join(equal, on, "left_semi").withColumn(row, F.monotonically_increasing_id()), "equal_texts")
    first = held.groupBy(quoted(key), quoted(mark)).agg(F.min(row).alias(row)).select(row)
    columns = [quoted(c) for c in docs.columns]
    rest = held.join(first, row, "left_anti").select(*columns)
    others = told.join(equal, on, "left_anti").select(*columns).unionByName(held.join(first, row, "left_semi").select(*columns))
    return _dedup(others, key, text, bits).unionByName(_applied(rest, text))


def _windows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(key, print, text) to the windows of the text: first line and the hashes of both lines."""
    for part in slices(batches, 2):
        lines = Lines(part.column(2))
        at, who, line = lines.windows()
        h = lines.hashes(bits)
        own = pa.array(who)
        yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(line.astype(np.int32)), pa.array(h[at]), pa.array(h[at + 1])], names=["k", "p", "line", "a", "b"])


def _dedup(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """dedup() of rows that differ in key or text."""
    texts = docs.select(quoted(key).alias("k"), _fingerprint(text).alias("p"), whole_text(text).alias("t"))
    schema = texts.select("k", "p", F.lit(0).alias("line"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).schema
    windows = write_table(texts.mapInArrow(lambda batches: _windows(batches, bits), schema), "windows")
    place = F.struct(F.col("k").isNull().alias("none"), "k", "p", "line")
    often = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that both sides of the join come as they are and its hot keys can be dealt out
    often = write_table(often.select(F.col("a").alias("oa"), F.col("b").alias("ob"), "first"), "windows_often")
    both = windows.join(often, (F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob")))
    twins = write_table(both.select("k", "p", "line", "a", "b", (place == F.col("first")).alias("stays")), "windows_twins")
    clash = write_table(_clashes(docs, key, text, twins, bits), "line_clashes")
    gone = twins.where("not stays").select("k", "p", "line")
    if not clash.isEmpty():  # lines that differ share a hash: their windows are judged by their bytes
        odd = [twins.join(clash, twins[c] == clash["h"], "left_semi") for c in "ab"]
        odd = write_table(odd[0].union(odd[1]).select("k", "p", "line").distinct(), "windows_odd")
        same = lambda x, y: x["k"].eqNullSafe(y["k"]) & (x["p"] == y["p"]) & (x["line"] == y["line"])
        shown = _by_row(docs, key, text, odd).mapInArrow(_window_bytes, texts.select("k", "p", F.lit(0).alias("line"), F.lit(b"").alias("bytes")).schema)
        first = shown.groupBy("bytes").agg(F.min(place).alias("f")).select("f.k", "f.p", "f.line")
        gone = gone.join(odd, same(gone, odd), "left_anti").unionByName(odd.join(first, same(odd, first), "left_anti"))
    return _applied(docs, text, key, gone)


def _with_lists(docs: DataFrame, key: str, text: str, windows: DataFrame, how: str) -> tuple[DataFrame, str]:
    """``docs`` with the first lines of each row's windows, and that column's name. Equal keys and null ones are parted by the
    text's digest; lists grow with the corpus, so they are not broadcast."""
    mark = fresh(docs.columns, "print")
    lists = windows.groupBy("k", "p").agg(F.collect_list("line").alias("lines"))
    names = [fresh([*docs.columns, mark], n) for n in lists.columns]
    lists = lists.toDF(*names).hint("merge")
    told = docs.withColumn(mark, _fingerprint(text))
    met = told.join(lists, quoted(key).eqNullSafe(F.col(names[0])) & F.col(mark).eqNullSafe(F.col(names[1])), how)
    return met, names[2]


def _by_row(docs: DataFrame, key: str, text: str, windows: DataFrame) -> DataFrame:
    """(key, print, text, lines): the rows that hold some of the windows, with the first lines of those."""
    met, lines = _with_lists(docs, key, text, windows, "inner")
    return met.select(quoted(key).alias("k"), F.col(fresh(docs.columns, "print")).alias("p"), whole_text(text).alias("t"), F.col(lines).alias("lines"))


def _clashes(docs: DataFrame, key: str, text: str, twins: DataFrame, bits: int) -> DataFrame:
    """``h``: hashes of lines in repeated windows that lines of different bytes have."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            lines = Lines(part.column(2))
            at = lines.of(part.column(3))
            at = np.unique(np.concatenate([at, at + 1]))
            h, starts, ends = lines.hashes(bits)[at], lines.starts[lines.full[at]], lines.ends[lines.full[at]]
            # copies within the slice travel once
            edges = np.stack([starts, ends], 1).ravel()
            shown = from_offsets(lines.buf, np.concatenate([edges, [len(lines.buf)]])) if len(at) else pa.array([], pa.binary())
            shown = shown.take(pa.array(np.arange(len(at)) * 2))
            once = pa.table({"h": pa.array(h), "bytes": shown}).group_by(["h", "bytes"]).aggregate([])
            yield from once.to_batches()

    found = _by_row(docs, key, text, twins).mapInArrow(fetch, "h long, bytes binary")
    return found.groupBy("h").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low <> high").select("h")


def _window_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print, text, lines) to the bytes of both lines of each window."""
    for part in slices(batches, 2):
        lines = Lines(part.column(2))
        at = lines.of(part.column(3))
        who, cut = lines.text[at], lambda k: lines.buf[lines.starts[k] : lines.ends[k]].tobytes()
        shown = [cut(a) + b"\n" + cut(b) for a, b in zip(lines.full[at].tolist(), lines.full[at + 1].tolist())]
        own = pa.array(who)
        line = (lines.full[at] - lines.bounds[who]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(line), pa.array(shown, pa.binary())], names=["k", "p", "line", "bytes"])


def _applied(docs: DataFrame, text: str, key: str | None = None, gone: DataFrame | None = None) -> DataFrame:
    """``docs`` without the windows that ``gone`` (key, print, line) names; without it, without any window."""
    results = [("n_lines", LongType()), ("n_removed", LongType())]
    if gone is None:
        carried = Carried(docs, text, results)
    else:
        met, lists = _with_lists(docs, key, text, gone, "left")
        carried = Carried(met, text, results, [F.col(lists)], docs.columns)
    schema = StructType([StructField(f.name, StringType() if f.name == text else f.dataType) for f in carried.schema])
    every = gone is None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in carried.slices(batches):
            lines = Lines(texts)
            at = lines.windows()[0] if every else lines.of(part.column(carried.more))
            out, lost = part.column(carried.at), np.zeros(part.num_rows, np.int64)
            if len(at):
                buf, off, lost = lines.without(at)
                out = pa.compute.if_else(pa.array(lost > 0), from_offsets(buf, off, pa.string()), out)
            columns = [out if c == text else part.column(k) for k, c in enumerate(carried.kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(lines.bounds)), pa.array(lost)], names=carried.names)

    return carried.source.mapInArrow(apply, schema)
