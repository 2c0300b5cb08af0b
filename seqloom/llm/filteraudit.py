"""Filter interaction audit: what each filter removes, in every order in which the filters could run.

A document is reduced to a mask, whose bit k says that it fails filter k. Masks are counted by part, for
all documents and for those that labels mark; the histograms are stacked as rows and multiplied by 0/1
matrices with a row per mask and a column per order and step. Texts are read once, and what is shuffled is
a digest, the key and the mask of each document.

Null texts are empty, null parts are the empty string. A document without a key is no copy of another and
has no labels; of rows that share a key, none is a copy of the other. Rows of labels that share a key mark
a document if one of them does. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import quoted, whole_text, write_table

#: Filters at most: there are n! orders.
MOST = 6
#: Parts whose rows are made at a time.
AT_A_TIME = 64
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: What parts words.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def incidence(n: int) -> dict[str, np.ndarray]:
    """0/1 matrices by outcome, (masks, orders times steps): whether documents of a mask have that outcome at that step."""
    masks = np.arange(1 << n)
    out = {k: np.zeros((1 << n, factorial(n) * n), np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    for k, order in enumerate(permutations(range(n))):
        gone = np.zeros(1 << n, bool)
        for column, f in enumerate(order, k * n):
            fails = masks >> f & 1 == 1
            out["removed"][:, column] = fails & ~gone
            out["redundant"][:, column] = fails & gone
            out["unique_fails"][:, column] = masks == 1 << f
            gone |= fails
            out["kept"][:, column] = ~gone
    return out


def masks(docs: DataFrame, labels: DataFrame, conditions: Sequence[Column | None], text: str = "text", key: str = "doc_id", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``part, mask, good, toxic`` of every document. ``conditions`` say of the column ``text`` which filters fail, over ``words`` too;
    None stands for the filter that fails copies of the text of a smaller key."""
    plain = [(k, c) for k, c in enumerate(conditions) if c is not None]
    held = docs.select(quoted(key).alias("key"), F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in plain), F.lit(0))
    held = held.withColumn("words", words(F.col("text"))).select("key", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    held = write_table(held, "masks")
    known = held.where("key is not null")
    copy = sum(1 << k for k, c in enumerate(conditions) if c is None)
    if copy:
        # the first of each text meets itself by digest and key, so that no group of copies is gathered
        first = known.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
        known = known.join(first, ["digest", "key"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(copy))
    marks = labels.select(quoted(key).alias("key"), (quoted(good) == 1).alias("good"), (quoted(toxic) == 1).alias("toxic")).where("key is not null")
    marks = marks.groupBy("key").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    known = known.join(marks, "key", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return known.unionByName(held.where("key is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def outcomes(masked: DataFrame, names: str) -> DataFrame:
    """OUT from ``part, mask, good, toxic``: a row for each part, order and step; the filters' names are single letters, the first for bit 0."""
    n = len(names)
    if not 1 <= n <= MOST:
        raise ValueError(f"1 to {MOST} filters have orders that can be listed")
    counted = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # as many as there are masks, at most
    orders = ["".join(names[f] for f in o) for o in permutations(range(n))]
    at = np.array([f for o in permutations(range(n)) for f in o])  # the filter of each column

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = incidence(n)
        same = (at[:, None] == np.arange(n)).astype(np.int64)
        written = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(orders), dtype=np.int32), n)), pa.array(orders)).cast(pa.string())
        for whole in batches:
            for begin in range(0, whole.num_rows, AT_A_TIME):
                batch = whole.slice(begin, AT_A_TIME)
                h = batch.column("h")
                owner = h.value_parent_indices().to_numpy()
                cells = h.flatten()
                stacked = np.zeros((3, batch.num_rows, 1 << n), np.int64)
                for k, name in enumerate(("n", "good", "toxic")):
                    stacked[k, owner, cells.field("mask").to_numpy()] = cells.field(name).to_numpy()
                found = {name: stacked[0] @ m for name, m in matrices.items()}
                found["good_lost"], found["toxic_lost"] = stacked[1] @ matrices["removed"], stacked[2] @ matrices["removed"]
                found["shapley"] = (found["removed"] @ same)[:, at]
                many = batch.num_rows
                columns = [batch.column("part").take(pa.array(np.repeat(np.arange(many), len(at)))), pa.concat_arrays([written] * many), pa.array(np.tile(np.arange(len(at)) % n + 1, many).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v.ravel()) for v in found.values())], names=["part", "filter_order", "step", *found])

    return rows.mapInArrow(multiply, OUT)


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column | None], **columns: str) -> DataFrame:
    """outcomes() of masks() for filters by name; the columns' names are those of masks()."""
    return outcomes(masks(docs, labels, list(conditions.values()), **columns), "".join(conditions))
