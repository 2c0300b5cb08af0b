"""Vector codes: parts of vectors by the nearest entries of codebooks, which Elkan's form of Lloyd's rounds fits to all vectors.

Components become integers, so distances are exact. Vectors stand in blocks with, for each part, its
entry, an upper bound of the distance to it and a lower bound of the distance to each entry. A round
shifts the bounds by what entries have moved and looks only at entries that the bounds do not rule out:
an entry goes when its lower bound, or half its distance from the part's own entry, is strictly above the
upper bound, so that no tie is missed. Bounds are whole numbers, rounded to the safe side. Blocks are
written and read each round; what meets on the driver is the sums of the entries' parts alone.

Left out are vectors that are null, hold null or non-finite components or components beyond what exact
integers can hold (some 2**27 after scaling), or whose length is no multiple of the parts or another than
that of the first vector. With fewer vectors than entries there are as many entries as vectors; first
are the smallest keys, of equal keys the smaller vector, and null keys come last. Repeated rows count
each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from seqloom.llm.common import drop_table, quoted, write_table

#: Vectors of a block.
BLOCK = 4096
#: Integer components at most: squared distances of parts of up to 32 then fit 63 bits.
LARGEST = 1 << 27
#: Groups whose totals are broadcast; more are joined in salted shuffles.
MOST_GROUPS = 1 << 16
SALTS = 16


# -- bounds


def root_down(square: np.ndarray) -> np.ndarray:
    """The largest integers whose squares are not above these."""
    r = np.sqrt(square.astype(np.float64)).astype(np.int64)
    r -= r * r > square
    r += (r + 1) * (r + 1) <= square
    return r


def root_up(square: np.ndarray) -> np.ndarray:
    r = root_down(square)
    return r + (r * r < square)


@dataclass
class Bounds:
    """Of n vectors and one part: entry, upper bound (n), lower bounds (n, entries)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def first_bounds(x: np.ndarray, entries: np.ndarray) -> Bounds:
    d = squares(x, entries)
    code = d.argmin(1)
    return Bounds(code, root_up(d[np.arange(len(x)), code]), root_down(d))


def shifted(b: Bounds, moved: np.ndarray) -> Bounds:
    """Bounds that hold after entries have moved by these distances at most."""
    return Bounds(b.code, b.upper + moved[b.code], np.maximum(b.lower - moved, 0))


def reassign(x: np.ndarray, entries: np.ndarray, b: Bounds) -> int:
    """Move rows to their nearest entries, of equally near ones to the first; renews the bounds and returns how many distances it took."""
    between = squares(entries, entries)

    def left(rows: np.ndarray) -> np.ndarray:
        """(rows, entries): those that the bounds do not rule out, the own entry aside."""
        u = b.upper[rows, None]
        out = (u >= b.lower[rows]) & (4 * u * u >= between[b.code[rows]])
        out[np.arange(len(rows)), b.code[rows]] = False
        return out

    apart = between + np.where(np.eye(len(entries), dtype=bool), np.iinfo(np.int64).max, 0) if len(entries) > 1 else np.full((1, 1), np.iinfo(np.int64).max)
    rows = np.flatnonzero(4 * b.upper * b.upper >= apart.min(1)[b.code])
    rows = rows[left(rows).any(1)]
    own = ((x[rows] - entries[b.code[rows]]) ** 2).sum(1)
    b.upper[rows] = root_up(own)
    b.lower[rows, b.code[rows]] = root_down(own)
    i, k = np.nonzero(left(rows))
    exact = ((x[rows[i]] - entries[k]) ** 2).sum(1)
    b.lower[rows[i], k] = root_down(exact)
    table = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
    table[np.arange(len(rows)), b.code[rows]] = own
    table[i, k] = exact
    code = table.argmin(1)
    b.code[rows] = code
    b.upper[rows] = root_up(table[np.arange(len(rows)), code])
    return len(rows) + len(i)


# -- blocks


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, the size in front."""
    least, most = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in ("bhi" if least < 0 else "BHI") + "q" if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return kind.encode() + values.astype(kind).tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, chr(held[0]), offset=1).astype(np.int64)


def _fields(rows: StructType) -> StructType:
    return StructType([StructField("rows", ArrayType(rows)), *(StructField(n, BinaryType()) for n in ("ints", "codes", "uppers", "lowers")), StructField("sums", ArrayType(LongType()))])


def part_sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(parts, entries, width + 1): sums of the parts of each entry, and how many there are."""
    parts, _, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        np.add.at(out[p, :, :width], codes[p], x[p])
        out[p, :, width] = np.bincount(codes[p], minlength=entries)
    return out


def _block(rows: pa.Array, x: np.ndarray, bounds: list[Bounds], entries: int) -> pa.RecordBatch:
    codes = np.stack([b.code for b in bounds])
    held = [packed(v) for v in (x, codes, np.stack([b.upper for b in bounds]), np.stack([b.lower for b in bounds]))]
    total = part_sums(x, codes, entries).ravel()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (rows, pa.array(total))]
    return pa.RecordBatch.from_arrays([lists[0], *(pa.array([v], pa.binary()) for v in held), lists[1]], names=["rows", "ints", "codes", "uppers", "lowers", "sums"])


def _opened(batch: pa.RecordBatch, k: int, shape: tuple[int, int, int]) -> tuple[pa.Array, np.ndarray, list[Bounds]]:
    """Rows, integers (parts, n, width) and bounds of a written block."""
    parts, entries, width = shape
    x, codes, uppers, lowers = (unpacked(batch.column(n)[k].as_py()) for n in ("ints", "codes", "uppers", "lowers"))
    codes, uppers = codes.reshape(parts, -1), uppers.reshape(parts, -1)
    lowers = lowers.reshape(parts, -1, entries)
    return batch.column("rows")[k].values, x.reshape(parts, -1, width), [Bounds(*b) for b in zip(codes, uppers, lowers)]


def _totals(state: DataFrame, size: int) -> np.ndarray:
    """The blocks' sums, added up by task and then over tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, size).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int64)), pa.array(total)], names=["place", "total"])

    out = np.zeros(size, np.int64)
    for r in state.select("sums").mapInArrow(add, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out


# -- the operator


@dataclass
class Codes:
    """``rows``: the columns kept, ``code`` (two hex digits a part) and ``error``; ``entries``: (parts, entries, width)."""

    rows: DataFrame
    entries: np.ndarray

    def text(self) -> str:
        """All components of all entries by part, entry and position."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = (), parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> Codes:
    """Codes of all vectors, and the codebooks after so many rounds."""
    names = [key, *(c for c in keep if c != key)]
    v = quoted(vector)
    usable = vectors.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(names)), v.cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: F.coalesce(F.abs(x) < LARGEST / scale, F.lit(False)) & ~F.isnan(x))
    usable = usable.where(F.col("v").isNotNull() & fits & (F.size("v") > 0) & (F.size("v") % parts == 0))
    ints = F.transform("v", lambda x: F.floor(x * scale)).alias("ints")

    def smallest(df: DataFrame) -> list:
        return df.select("c0", ints).orderBy(F.col("c0").asc_nulls_last(), "ints").limit(entries).collect()

    kept = StructType([StructField(f"c{k}", vectors.schema[c].dataType) for k, c in enumerate(names)])
    out = StructType([StructField(c, vectors.schema[c].dataType) for c in names] + [StructField("code", vectors.sparkSession.range(0).select(F.lit("")).schema[0].dataType), StructField("error", LongType())])
    first = smallest(usable)
    if not first:
        return Codes(vectors.sparkSession.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64))
    dims = len(first[0]["ints"])
    usable = usable.where(F.size("v") == dims)
    if any(len(r["ints"]) != dims for r in first):
        first = smallest(usable)
    width = dims // parts
    book = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width).swapaxes(0, 1)
    shape = (parts, len(first), width)
    schema = _fields(kept)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = np.floor(some.column("v").flatten().to_numpy() * scale).astype(np.int64).reshape(-1, parts, width).swapaxes(0, 1)
                rows = pa.StructArray.from_arrays([some.column(f.name) for f in kept], [f.name for f in kept])
                yield _block(rows, x, [first_bounds(x[p], book[p]) for p in range(parts)], shape[1])

    state = write_table(usable.mapInArrow(begin, schema), "codes")
    for k in range(rounds):
        total = _totals(state, int(np.prod(shape[:2]) * (width + 1))).reshape(parts, -1, width + 1)
        many = total[:, :, width:]
        new = np.where(many > 0, total[:, :, :width] // np.maximum(many, 1), book)
        moved, book = root_up(((new - book) ** 2).sum(2)), new
        last = k + 1 == rounds
        renewed = state.mapInArrow(_finish(shape, book, moved, names) if last else _renew(shape, book, moved), out if last else schema)
        older, state = state, write_table(renewed, "codes")
        drop_table(older)
    if not rounds:
        older, state = state, write_table(state.mapInArrow(_finish(shape, book, np.zeros(shape[:2], np.int64), names), out), "codes")
        drop_table(older)
    return Codes(state, book)


def _renew(shape: tuple, book: np.ndarray, moved: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, x, bounds = _opened(batch, k, shape)
                bounds = [shifted(b, moved[p]) for p, b in enumerate(bounds)]
                for p, b in enumerate(bounds):
                    reassign(x[p], book[p], b)
                yield _block(rows, x, bounds, shape[1])

    return work


def _finish(shape: tuple, book: np.ndarray, moved: np.ndarray, names: list[str]):
    """As _renew(), to one row per vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, x, bounds = _opened(batch, k, shape)
                error = np.zeros(len(rows), np.int64)
                codes = np.zeros((len(rows), shape[0]), np.uint8)
                for p, b in enumerate(bounds):
                    b = shifted(b, moved[p])
                    reassign(x[p], book[p], b)
                    error += ((x[p] - book[p][b.code]) ** 2).sum(1)
                    codes[:, p] = b.code
                text = pa.array([c.tobytes().hex() for c in codes])
                yield pa.RecordBatch.from_arrays([*rows.flatten(), text, pa.array(error)], names=[*names, "code", "error"])

    return work


def with_totals(rows: DataFrame, group: str, value: str, name: str, most: int = MOST_GROUPS) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of equal ``group``, nulls together. No group is gathered in one task."""
    totals = write_table(rows.groupBy(quoted(group).alias("__g")).agg(F.sum(quoted(value)).alias(name)), "totals")
    same = quoted(group).eqNullSafe(F.col("__g"))
    if totals.count() <= most:
        return rows.join(F.broadcast(totals), same).drop("__g")
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(*map(quoted, rows.columns)), F.lit(SALTS)).cast("int"))
    spread = totals.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col("__s") == F.col("__t"))).drop("__g", "__s", "__t")
