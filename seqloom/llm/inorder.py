"""Documents beside their successors in the order of a key, without a sort of all rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from seqloom.llm.common import quoted, slices, whole_text, write_table

#: Keys that are sampled for each range.
SAMPLED = 64


def _ordered(key: np.ndarray, known: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Bytes that compare as (null first, key, tie) do."""
    out = np.zeros(len(key), [("known", "u1"), ("key", ">u8"), ("tie", ">u8"), ("end", "u1")])
    top = np.uint64(1 << 63)
    out["known"], out["key"], out["tie"], out["end"] = known, key.astype(np.int64).view(np.uint64) ^ top, tie.astype(np.int64).view(np.uint64) ^ top, 1
    out["key"][~known] = 0
    return out.view("S18")


def packed(texts: pa.Array) -> pa.Array:
    """Texts without nulls as binaries of zstd, each by itself."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(held: pa.Array) -> pa.Array:
    """The texts of packed()."""
    loosen = zstandard.ZstdDecompressor()
    return pa.array([loosen.decompress(z) for z in held.to_pylist()], pa.binary()).cast(pa.string())


def _bounds(keys: DataFrame, ranges: int) -> np.ndarray:
    """Where ranges begin, from a sample of ``k, h``; fewer than ``ranges``."""
    share = min(1.0, SAMPLED * ranges / max(1, keys.count()))
    some = keys.where(F.pmod(F.hash("k", "h", F.monotonically_increasing_id()), F.lit(1 << 20)) < share * (1 << 20)).toPandas()
    order = np.sort(_ordered(some["k"].fillna(0).to_numpy(np.int64), some["k"].notna().to_numpy(), some["h"].to_numpy()))
    return np.unique(order[np.linspace(0, len(order), ranges, endpoint=False).astype(int)[1:]]) if len(order) else order


def _places(bounds: np.ndarray, key: pa.Array, tie: pa.Array) -> pa.Array:
    """The range of each key, nulls in the first."""
    order = _ordered(key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False), tie.to_numpy())
    return pa.array(np.searchsorted(bounds, order, side="right").astype(np.int32))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "next_text", ranges: int = 0) -> DataFrame:
    """``docs`` with the text of the row that follows in the order of a whole-number ``key``; the first follows the last.

    Both texts are packed(). Null keys come first, rows of one key in the order of a hash of their texts;
    null texts are empty. Bounds of ranges are sampled from keys and hashes, so that a key of any number of
    rows is dealt out too. The first row of a range goes, as a second copy, to the end of the range before,
    so texts are shuffled once. ``ranges`` is the number of shuffle partitions unless given.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(whole_text(text)).alias("h")
    at = quoted(key).cast("long").alias("k")
    keys = write_table(docs.select(at, tie), "keys")
    bounds = _bounds(keys, ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _places(bounds, *batch.columns)], names=["k", "h", "r"])

    # the first row of each range: no more rows than ranges
    least = F.min(F.struct(F.col("k").isNotNull().alias("known"), "k", "h")).alias("f")
    first = keys.mapInArrow(place, "k long, h long, r int").groupBy("r").agg(least).orderBy("r").collect()
    firsts = spark.createDataFrame([(r["f"]["k"], r["f"]["h"], first[i - 1]["r"]) for i, r in enumerate(first)], "__k long, __h long, __to int")
    others = [c for c in docs.columns if c != text]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            rows, k, h, texts = part.columns
            yield pa.RecordBatch.from_arrays([rows, k, h, packed(texts), _places(bounds, k, h)], names=["row", "k", "h", "z", "r"])

    row = F.struct(*map(quoted, others)) if others else F.struct(F.lit(None).cast("int").alias("none"))
    held = docs.select(row.alias("row"), at, tie, whole_text(text).alias("t"))
    held = held.mapInArrow(pack, StructType([*held.schema.fields[:3], StructField("z", BinaryType()), StructField("r", IntegerType())]))
    held = held.join(F.broadcast(firsts), F.col("k").eqNullSafe(F.col("__k")) & (F.col("h") == F.col("__h")), "left")
    copies = F.when(F.col("__to").isNull(), F.array(F.struct("r", F.lit(0).alias("copy")))).otherwise(F.array(F.struct("r", F.lit(0).alias("copy")), F.struct(F.col("__to").alias("r"), F.lit(1).alias("copy"))))
    dealt = held.select("row", "k", "h", "z", F.explode(copies).alias("at")).select("row", "k", "h", "z", "at.r", "at.copy")
    after = F.lead("z").over(Window.partitionBy("r").orderBy("copy", F.col("k").asc_nulls_first(), "h"))
    return dealt.withColumn("after", after).where("copy = 0").select(*(F.col("z").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns), F.col("after").alias(name))
