"""What the operators share: tables in the cluster's shared folder, and texts as flat byte buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one task works on at a time.
SLICE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _one_machine() -> str:
    return tempfile.mkdtemp(prefix="seqloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of this machine only where that is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (master := spark.sparkContext.master).startswith("local") or not named and master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(named or _one_machine()).rstrip('/')}/seqloom"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of write_table() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._seqloom_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, behind as many underscores as keep it apart from the columns there are."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


class Carried:
    """Rows that pass through Python tasks: the columns kept, where the text stands, and the schema with the results.

    Columns that have the names of results are replaced; ``keep`` names those that stay if not all do.
    The text travels once; only one that is no string, or is replaced itself, has a copy of its own.
    """

    def __init__(self, docs: DataFrame, text: str, results: Sequence[tuple], more: Sequence[Column] = (), keep: Sequence[str] | None = None):
        gone = {name.lower() for name, _ in results}
        self.kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in gone]
        own = text in self.kept and docs.schema[text].dataType.simpleString() == "string"
        self.names = [*self.kept, *(name for name, _ in results)]
        self.at = self.kept.index(text) if own else len(self.kept)
        columns = [*map(quoted, self.kept), *([] if own else [quoted(text).cast("string")])]
        self.more = len(columns)  # where further columns begin
        # plain names on the way in, as mapInArrow() takes no others
        self.source = docs.select(*(c.alias(f"c{k}") for k, c in enumerate([*columns, *more])))
        self.schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in self.kept), *(StructField(n, t) for n, t in results)])

    def __getstate__(self) -> dict:
        """What tasks need."""
        return {k: v for k, v in self.__dict__.items() if k not in ("source", "schema")}

    def slices(self, batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        """Parts of the batches with their texts, empty where they are null."""
        for part in slices(batches, self.at, most):
            yield part, part.column(self.at).fill_null("")

    def batch(self, part: pa.RecordBatch, results: Sequence[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns[: len(self.kept)], *results], names=self.names)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array without nulls as UTF-8 bytes and int64 offsets that start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one come to ``most`` bytes, or are a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def from_offsets(buf: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Views of ``buf`` between successive bounds, without a copy of the bytes."""
    return pa.Array.from_buffers(kind or pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive bounds; empty ranges give 0."""
    run = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return run[bounds[1:]] - run[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes of a word, A-Z lower-cased; 0 for bytes that part words. Letters, digits and all bytes of non-ASCII characters.
WORD_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and each text's first word number (with the total at the end)."""
    low = WORD_BYTES[buf]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    begins = inside[1:-1] & ~inside[:-2]
    begins[off[:-1][off[:-1] < len(low)]] |= inside[1:-1][off[:-1][off[:-1] < len(low)]]
    starts = np.flatnonzero(begins)
    last = inside[1:-1] & ~inside[2:]
    cut = off[1:][(off[1:] > 0)] - 1
    last[cut] |= inside[1:-1][cut]
    return low, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


#: Base of the polynomial hash, odd and so invertible modulo 2**64, and the bytes over which it runs at a time.
BASE = 0x9E3779B97F4A7C15
WINDOW = 1 << 17
#: A random word per byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse that a window needs, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        run = np.full(WINDOW + 1, base, np.uint64)
        run[0] = 1
        out.append(np.multiply.accumulate(run))
    return out[0], out[1]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that follow one another: equal bytes give equal hashes wherever they stand.

    Memory is that of one window, however long the texts; ranges longer than it are hashed window by window.
    """
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)

    def hashed(lo: int, hi: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        terms = BYTE_WORDS[buf[lo:hi]]
        terms *= up[: hi - lo]
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(terms, out=run[1:])
        return mix((run[b - lo] - run[a - lo]) * down[a - lo] + (b - a).astype(np.uint64))

    k = 0
    while k < len(starts):
        lo = int(starts[k])
        j = max(k + 1, int(np.searchsorted(ends, lo + WINDOW, side="right")))
        if ends[k] - lo <= WINDOW:
            out[k:j] = hashed(lo, int(ends[j - 1]), starts[k:j], ends[k:j])
        else:
            j, whole = k + 1, np.zeros(1, np.uint64)
            for a in range(lo, int(ends[k]), WINDOW):
                b = min(a + WINDOW, int(ends[k]))
                whole = mix(whole * np.uint64(BASE) + hashed(a, b, np.array([a]), np.array([b])))
            out[k] = whole[0]
        k = j
    return out
