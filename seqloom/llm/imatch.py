"""I-Match fingerprints: hashes of a document's distinct terms of medium document frequency, over randomised parts of the lexicon.

The lexicon holds the terms in a band of inverse document frequency: at most a tenth of the documents
have them, and at least the mean number of distinct terms a document has, over LEXICON, of them do. As
frequencies add up to that mean, the lexicon has LEXICON terms at most, however many documents there are;
so it is broadcast as sorted 64-bit hashes.

A fingerprint has a signature for each of up to 32 random disjoint subsets of the lexicon: the hash of the
document's sorted distinct terms that are in the subset. Subsets are halved until a document has one or
two terms in each (its level), so that an edit spares some signatures of a document of any length; the
signatures of the next three levels stand beside them, so that texts of different levels can be
compared. The likeness of two fingerprints is the share of equal signatures at the levels that both have,
of those for which either has a term.

Documents with fewer than FEW terms in the band use all of their distinct terms, those without any term
(no letter or digit) their whole text. Null texts are empty, and empty texts have no signature. Equal
texts have equal fingerprints, and equal fingerprints a likeness of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqloom.llm.common import flat, mix, quoted, range_hashes, slices, whole_text, words_of, write_table

#: Terms of a lexicon at most.
LEXICON = 1 << 20
#: Share of the documents above which a term is too common.
COMMON = 0.1
#: Subsets of a level, as a power of two.
SUBSETS = 5
#: Levels of a fingerprint.
LEVELS = 4
#: Terms in the band below which all of a text's terms count.
FEW = 8
#: Hashes that a task holds before it adds them up.
PENDING = 1 << 21
SALT = np.uint64(0x5851F42D4C957F2D)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of each text and the texts' numbers, in that order of both."""
    buf, off = flat(texts)
    low, starts, ends, first = words_of(buf, off)
    hashes, owner = range_hashes(low, starts, ends), np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, n``: documents that have a term (its hash); the null term has the sum over all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

        def given(found: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many)], names=["term", "n"])

        for part in slices(batches, 0):
            found, _ = terms(part.column(0))
            total += len(found)
            found, many = np.unique(found, return_counts=True)
            hashes.append(found)
            counts.append(many)
            if sum(map(len, hashes)) > PENDING:
                found, many = _added(hashes, counts)
                hashes, counts = [found], [many]
                if len(found) > PENDING // 2:
                    yield given(found, many)
                    hashes, counts = [found[:0]], [many[:0]]
        yield given(*_added(hashes, counts))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], names=["term", "n"])

    rows = docs.select(whole_text(text).alias("t")).mapInArrow(count, "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lexicon: int = LEXICON, common: float = COMMON) -> np.ndarray:
    """The lexicon: sorted hashes of the terms in the band."""
    n = docs.count()
    # every document has a term, or else the bound is lower still
    held = write_table(document_frequencies(docs, text).where(F.col("n") * lexicon >= n), "frequencies")
    total = max([n, *(r["n"] for r in held.where("term is null").collect())])
    band = held.where("term is not null").where((F.col("n") * lexicon >= total) & (F.col("n") <= common * n))
    return np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def _inside(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == values


def _signatures(hashes: np.ndarray, owner: np.ndarray, level: np.ndarray) -> np.ndarray:
    """(texts, subsets) of 16-bit signatures at each text's level, 0 where a subset has no term of it."""
    many = 1 << SUBSETS
    g = mix(hashes ^ SALT)
    mine = level[owner].astype(np.uint64)
    low = np.minimum(mine, np.uint64(SUBSETS))
    bucket = g & ((np.uint64(1) << low) - np.uint64(1))
    used = (g >> np.uint64(SUBSETS)) & ((np.uint64(1) << (mine - low)) - np.uint64(1)) == 0
    group = owner[used] * many + bucket[used].astype(np.int64)
    order = np.lexsort((hashes[used], group))
    group, sorted_ = group[order], hashes[used][order]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(group)].astype(np.int64)
    found = (range_hashes(sorted_.view(np.uint8), begin * 8, end * 8) & np.uint64(0xFFFF)).astype(np.uint16)
    out = np.zeros(len(level) * many, np.uint16)
    out[group[begin]] = np.maximum(found, 1)
    return out.reshape(-1, many)


def fingerprints(texts: pa.Array, lexicon: np.ndarray) -> list[str]:
    """Level (two hex digits), its signatures and those of the next levels (four hex digits each)."""
    n = len(texts)
    hashes, owner = terms(texts)
    inside = _inside(lexicon, hashes)
    thin = np.bincount(owner[inside], minlength=n) < FEW
    keep = inside | thin[owner]
    hashes, owner = hashes[keep], owner[keep]
    size = np.bincount(owner, minlength=n)
    buf, off = flat(texts)
    bare = np.flatnonzero((size == 0) & (np.diff(off) > 0))
    if len(bare):
        hashes = np.concatenate([hashes, range_hashes(buf, off[bare], off[bare + 1])])
        owner = np.concatenate([owner, bare])
        size[bare] = 1
    level = np.array([int(s).bit_length() - 1 if s else 0 for s in size], np.int64)
    found = [_signatures(hashes, owner, level + k).astype(">u2") for k in range(LEVELS)]
    return [f"{v:02x}" + b"".join(f[i, : 1 << v + k].tobytes() for k, f in enumerate(found)).hex() for i, v in enumerate(level.tolist())]


def opened(fingerprint: str) -> dict[int, np.ndarray]:
    """Signatures by level."""
    level = int(fingerprint[:2], 16)
    held = np.frombuffer(bytes.fromhex(fingerprint[2:]), ">u2")
    ends = np.cumsum([0] + [min(1 << level + k, 1 << SUBSETS) for k in range(LEVELS)])
    return {level + k: held[ends[k] : ends[k + 1]] for k in range(LEVELS)}


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    a, b = opened(one), opened(other)
    equal = either = 0
    for level in a.keys() & b.keys():
        x, y = a[level], b[level]
        either += int(((x > 0) | (y > 0)).sum())
        equal += int(((x == y) & (x > 0)).sum())
    return equal / either if either else 0.0


def add_fingerprints(docs: DataFrame, lexicon: np.ndarray, columns: dict[str, str]) -> DataFrame:
    """``docs`` with the fingerprints of text columns: ``columns`` has the name of the text by the name of the fingerprint,
    in whose place another column of that name goes."""
    gone = {c.lower() for c in columns}
    kept = [c for c in docs.columns if c.lower() not in gone]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    source = docs.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(kept)), *(whole_text(t).alias(f"t{k}") for k, t in enumerate(columns.values())))
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in kept), *(StructField(c, StringType()) for c in columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in batch.columns[len(kept) :]:
                one = pa.RecordBatch.from_arrays([texts], names=["t"])
                found.append(pa.array([f for part in slices(iter([one]), 0) for f in fingerprints(part.column(0), shared.value)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names=[*kept, *columns])

    return source.mapInArrow(work, schema)
