"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly.

A text is the bag of its words' subwords: each word whole and its character 3- to 5-grams between
word marks, hashed to rows of one embedding table. Their average goes through a linear softmax with
two classes. As both parts are linear, scoring needs one number per subword (its embedding times the
difference of the class vectors), and words that were never seen share the numbers of their grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from seqloom.llm.common import Carried, flat, from_offsets, mix, quoted, sums, whole_text, words_of

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Bounds of the training sample: labelled documents of each class, and characters of one (longer ones are not learnt from).
PER_CLASS, LONGEST = 3000, 30_000
THRESHOLD = 0.3
#: What the mean is multiplied by, and the texts at which a subword is half trusted.
SCALE, TRUST = 30, 15


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, and each word's bounds in them."""
    buf, off = flat(words)
    n = len(off) - 1
    buf = np.insert(buf, np.concatenate([off[:-1], off[1:]]), np.repeat(np.array([60, 62], np.uint8), n))  # <word>
    # insertion keeps the order of equal places: an end mark stands before the next word's begin mark only if it is put first
    off = off + 2 * np.arange(n + 1)
    if n:
        buf[off[:-1]], buf[off[1:] - 1] = 60, 62
    size = np.diff(off)
    value = buf.astype(np.uint64) + np.uint64(1)
    per_word = 1 + sum(np.maximum(size - g + 1, 0) for g in GRAMS)
    bounds = np.concatenate([[0], np.cumsum(per_word)])
    out = np.empty(bounds[-1], np.uint64)
    place = bounds[:-1].copy()
    # the whole word
    step = np.uint64(0x9E3779B97F4A7C15)
    spread = mix(value * step + (np.arange(len(value)) - np.repeat(off[:-1], size)).astype(np.uint64))
    out[place] = mix(np.add.reduceat(spread, off[:-1]) if n else spread[:0]) ^ np.uint64(1)
    place += 1
    for g in GRAMS:
        many = np.maximum(size - g + 1, 0)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(off[:-1], many) + at
        key = np.zeros(len(begin), np.uint64)
        for k in range(g):
            key = key * np.uint64(257) + value[begin + k]
        out[np.repeat(place, many) + at] = mix(key * step + np.uint64(g))
        place += many
    return (out >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1), bounds


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The table of distinct words, the number of each word in it, and the texts' bounds in words."""
    buf, off = flat(texts)
    low, starts, ends, bounds = words_of(buf, off)
    # a word's view must end where the next begins, so the bytes between words are taken out
    keep = low != 0
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = from_offsets(low[keep], edges).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), bounds


def bag(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, weights (shares of the text's subwords) and the texts' bounds: one entry per bucket and text."""
    words, at, bounds = distinct_words(texts)
    rows, edges = subwords(words)
    heads, weights, ends = [], [], [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        word, times = np.unique(at[a:b], return_counts=True)
        many = edges[word + 1] - edges[word]
        index = np.repeat(edges[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
        count = np.bincount(rows[index], np.repeat(times, many).astype(np.float32), BUCKETS) if len(index) else np.zeros(BUCKETS)
        used = np.flatnonzero(count)
        heads.append(used.astype(np.int32))
        weights.append((count[used] / max(1.0, count.sum())).astype(np.float32))
        ends.append(ends[-1] + len(used))
    return np.concatenate(heads), np.concatenate(weights), np.array(ends)


def train(texts: list[str], labels: np.ndarray, prior: float, dim: int = 8, epochs: int = 6, rate: float = 0.02, decay: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax jointly (Adam on mini-batches); return the number per bucket and the bias.

    A subword's gradient is scaled down where few of the sample's texts have it, so that texts are not
    learnt by heart. ``prior`` is the share of class 1 among all labelled rows; the sample's own share
    is taken out of the bias.
    """
    heads, weights, ends = [], [], [np.zeros(1, np.int64)]
    for k in range(0, len(texts), 256):
        h, w, e = bag(pa.array(texts[k : k + 256], pa.string()))
        heads.append(h), weights.append(w), ends.append(ends[-1][-1] + e[1:])
    heads, weights, ends = np.concatenate(heads), np.concatenate(weights), np.concatenate(ends)
    texts = len(texts)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    top, bias = rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    common = np.bincount(heads, minlength=BUCKETS).astype(np.float32)
    slow = (common / (common + TRUST))[:, None]
    table *= slow
    params = [table, top, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(texts)
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            many = ends[rows + 1] - ends[rows]
            at = np.repeat(ends[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
            head, weight = heads[at], weights[at]
            owner = np.repeat(np.arange(len(rows)), many)
            # scaled up, as a text's mean moves little with a few words
            mean = np.stack([np.bincount(owner, table[head, d] * weight, len(rows)) for d in range(dim)], 1).astype(np.float32) * SCALE
            logits = mean @ top + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            slope = odds / odds.sum(1, keepdims=True)
            slope[np.arange(len(rows)), labels[rows]] -= 1
            slope /= len(rows)
            back = slope @ top.T * SCALE
            grad = np.stack([np.bincount(head, back[owner, d] * weight, BUCKETS) for d in range(dim)], 1).astype(np.float32)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for (m, v), p, g, r in zip(moments, params, (grad, mean.T @ slope, slope.sum(0)), (rate * slow, rate / 10, rate)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= r * (fix * m / (np.sqrt(v) + 1e-8) + decay * p)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return (SCALE * table @ (top[:, 1] - top[:, 0])).astype(np.float64), float(bias[1] - bias[0] + shift)


def held_out(key: str = "doc_id"):
    """Rows that labels are never learnt from: crc32 of the key's text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(quoted(key).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled rows: PER_CLASS of either class, by the hash of their keys.

    Null keys and labels other than 0 and 1 are left out; a key with different labels counts as 1. Columns
    may have any names.
    Without rows of both classes all scores come to the prior.
    """
    told = labels.where(quoted(label).isin(0, 1) & quoted(key).isNotNull()).where(~held_out(key))
    told = told.select(quoted(key).alias("k"), quoted(label).alias("y")).groupBy("k").agg(F.max("y").cast("int").alias("y"))
    shares = {r["y"]: r["count"] for r in told.groupBy("y").count().collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    body = docs.select(quoted(key).alias("k"), whole_text(text).alias("t")).where(F.length("t") <= LONGEST)
    # the sample's keys first, so that only its texts travel
    picked = None
    for y in (0, 1):
        some = told.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(PER_CLASS)
        picked = some if picked is None else picked.union(some)
    rows = body.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min("t").alias("t")).orderBy("k").collect()  # 2 * PER_CLASS keys at most
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    return train([r["t"] for r in rows], y, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` for every whole text.

    Null and empty texts, and those without words, get the score of the bias. Columns of those names
    are replaced, repeated rows stay.
    """
    carried = Carried(docs, text, [("score", DoubleType()), ("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for part, texts in carried.slices(batches):
            words, at, bounds = distinct_words(texts)
            rows, edges = subwords(words)
            total, many = sums(weight[rows], edges), np.diff(edges)
            logit = sums(total[at], bounds) / np.maximum(1, sums(many[at], bounds)) + bias
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield carried.batch(part, [pa.array(p), pa.array((p >= threshold).astype(np.int32))])

    return carried.source.mapInArrow(work, carried.schema)
