"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampled LSH, exact edit distance.

A CGK walk reads a sequence with one pointer: step j puts out the word under the pointer and moves
on or stays by a random bit of (j, word). Sequences at a small edit distance fall back into step, so
their outputs differ in few places, and a hash of sampled output places is equal with good chance.

A window of an item's size is embedded by the walks from each of its words, so that an edit spoils
only the walks that run over it; one hash samples the outputs of one of them. Every word of every
document starts walks too. A hit at word a of an item lines the whole item up with the document, and
the edit distance of the item-sized window decides. How many independent walks an item gets follows
from its size, by hit rates measured with as many edits as the similarity allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Carried, drop_table, flat, mix, quoted, range_hashes, words_of, write_table

#: Least similarity of a window: 1 - edits / words of the item.
SIMILARITY = 0.8
#: Output places of a walk, and places sampled by its hash.
STEPS, SAMPLED = 6, 4
#: Recall aimed at over an item's walks.
RECALL = 0.9999
#: By least words of an item: words that a hash must have sampled (fewer would hit everywhere), and the chance that one walk
#: finds the item with all edits allowed, at random or even places, whichever is less (measured 0.51, 0.73 and 0.95 on 200 items a size).
RATES = [(5, 2, 0.5), (9, 3, 0.7), (20, 3, 0.9)]
#: Items of one broadcast index; more are worked through in blocks of about so many.
BLOCK = 20_000


def class_of(size: int) -> int:
    """The row of RATES for an item of so many words; -1 for items of less, which may have no edits and have windows of their own size."""
    return sum(size >= least for least, _, _ in RATES) - 1


def walks_for(size: int, recall: float = RECALL) -> int:
    """Independent walks with which items of so many words reach the recall; one is enough where no edit is allowed."""
    k = class_of(size)
    return 1 if k < 0 else max(1, ceil(log(1 - recall) / log(1 - RATES[k][2])))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash per word, the texts' bounds in words, and the words' byte starts and ends."""
    buf, off = flat(texts)
    low, starts, ends, bounds = words_of(buf, off)
    return range_hashes(low, starts, ends), bounds, starts, ends


def walk_keys(words: np.ndarray, walk: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one walk from every word: the hash of its sampled outputs, the words sampled, and past which word it has read.

    With a ``size``, windows are of so many words and what is behind them reads as one padding symbol.
    """
    n = len(words)
    padded = np.concatenate([words, np.zeros(STEPS + 1, np.uint64)])
    rng = np.random.default_rng(1000 + walk)
    draws = rng.integers(1, 2**63, STEPS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    picks = set(np.random.default_rng(5000 + walk).choice(STEPS, SAMPLED, replace=False).tolist())
    keys, seen_words, last = np.full(n, walk + 1, np.uint64), np.zeros(n, np.int8), np.full(n, -1)
    at = np.arange(n)
    stops = None if size is None else at + size
    for j in range(STEPS):
        seen = padded[at]
        if stops is not None:
            seen[at >= stops] = 0
        if j in picks:
            keys *= np.uint64(0x9E3779B97F4A7C15)
            keys += seen
            seen_words += at != last
            last = at.copy()
        seen *= draws[j]
        seen >>= np.uint64(63)
        at += seen.view(np.int64)
    return mix(keys), seen_words, at


def slack_of(size: int, similarity: float) -> int:
    """Most edits of an item of so many words."""
    return int((1 - similarity) * size + 1e-9)


class Table:
    """Sorted keys of item words, with a filter before them."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]
        self.filter = np.zeros(1 << 18, bool)
        self.filter[keys >> np.uint64(46)] = True

    def hits(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``mine`` and the item words of the same key."""
        maybe = np.flatnonzero(self.filter[mine >> np.uint64(46)])
        left, right = np.searchsorted(self.keys, mine[maybe], "left"), np.searchsorted(self.keys, mine[maybe], "right")
        many = right - left
        return np.repeat(maybe, many), self.rows[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]


class Index:
    """The items' words and a table per walk; items of less words than any of RATES have tables per size."""

    def __init__(self, items: list[tuple], recall: float = RECALL, similarity: float = SIMILARITY):
        self.ids = [i for i, _ in items]
        self.similarity = similarity
        words, bounds, _, _ = hashed_words(pa.array([t for _, t in items], pa.string()))
        self.words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.sets = [set(w.tolist()) for w in self.words]
        self.owner = np.repeat(np.arange(len(items)), np.diff(bounds))
        self.nth = np.arange(len(words)) - bounds[self.owner]
        sizes = np.diff(bounds)
        size = sizes[self.owner]
        least = np.array([RATES[class_of(n)][1] for n in range(size.max(initial=0) + 1)])[size]
        walks = np.array([walks_for(n, recall) for n in range(size.max(initial=0) + 1)])[size]
        whole = size >= RATES[0][0]
        self.tables: list[tuple[int | None, int, Table]] = []  # window size, walk, table
        for walk in range(int(walks[whole].max(initial=0))):
            keys, told, past = walk_keys(words, walk)
            rows = np.flatnonzero(whole & (walks > walk) & (told >= least) & (past < bounds[1:][self.owner]))
            self.tables.append((None, walk, Table(keys[rows], rows)))
        for n in np.unique(size[~whole]).tolist():
            rows = np.flatnonzero((size == n) & (self.nth == 0))
            self.tables.append((n, 0, Table(walk_keys(words, 0, n)[0][rows], rows)))


def candidates(index: Index, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, item, word of the text where the item would begin), sorted, of all hits in any table."""
    out = [np.zeros((0, 3), np.int64)]
    for size, walk, table in index.tables:
        place, row = table.hits(walk_keys(words, walk, size)[0])
        text = np.searchsorted(bounds, place, side="right") - 1
        out.append(np.unique(np.stack([text, index.owner[row], place - index.nth[row] - bounds[text]], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def edits(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a run of words in the window, with the run's first and past-last word."""
    at = {int(w): window == w for w in np.unique(item)}
    cost = np.zeros(len(window) + 1, np.int32)
    begin = np.arange(len(window) + 1)
    ramp = np.arange(len(window) + 1)
    for w in item.tolist():
        change, drop = cost[:-1] + ~at[w], cost + 1
        best = drop.copy()
        from_ = begin.copy()
        better = change < best[1:]
        best[1:][better] = change[better]
        from_[1:][better] = begin[:-1][better]
        # words that only the window has: running minimum along it
        low = np.minimum.accumulate(best - ramp)
        source = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost, begin = low + ramp, from_[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def verified(index: Index, words: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, past-last word, edits) of the candidates within the similarity: for each text and item the
    closest place, and every other that overlaps none closer."""
    places: dict[tuple[int, int], set] = {}
    reached: dict[tuple[int, int], int] = {}
    for t, i, begin in found.tolist():
        item = index.words[i]
        slack = slack_of(len(item), index.similarity)
        if reached.get((t, i), begin - 1) >= begin:  # the window before reached as far
            continue
        # begins up to the slack further on fall into one window
        a, b = max(0, begin - slack), min(bounds[t + 1] - bounds[t], begin + len(item) + 2 * slack)
        if b <= a:
            continue
        reached[t, i] = begin + slack
        window = words[bounds[t] + a : bounds[t] + b]
        # each word of the item that the window lacks is an edit
        if len(index.sets[i].difference(window.tolist())) > slack:
            continue
        cost, first, end = edits(item, window)
        if cost <= slack:
            places.setdefault((t, i), set()).add((cost, a + first, a + end))
    out = []
    for (t, i), some in places.items():
        taken: list[tuple[int, int]] = []
        for cost, first, end in sorted(some):
            if all(end <= a or b <= first for a, b in taken):
                taken.append((first, end))
                out.append((t, i, first, end, cost))
    return out


#: The index that this worker used last.
_held: dict[str, Index] = {}


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Add ``matches`` to ``docs``: an array of (item, start, end, edits), by item and start; empty where nothing is found.

    start and end are the byte places of the matched words in the UTF-8 text; words are runs of
    letters, digits and non-ASCII characters with A-Z lower-cased. An item counts at each place where
    it stands. Null and empty texts match nothing; items without words, or with a null id, are never
    found. Of repeated item ids every text counts. A column named matches is replaced, repeated rows
    stay. Items are broadcast in blocks of about ``block``, one at a time: a larger benchmark takes a
    pass over the documents for each block, written between them.
    """
    rows = items.where(quoted(item).isNotNull() & quoted(item_text).isNotNull()).select(quoted(item).alias("id"), quoted(item_text).cast("string").alias("text")).distinct()
    kind = docs.sparkSession.createDataFrame([], rows.schema).select(F.array(F.struct(F.col("id").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("edits"))).alias("m")).schema["m"].dataType
    blocks = max(1, -(-rows.count() // block))
    before = docs.select(*[quoted(c) for c in docs.columns if c.lower() != "matches"]).withColumn("matches", F.array().cast(kind))
    for k in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        after = _pass(before, sorted((tuple(r) for r in some.collect()), key=lambda r: (r[0], r[1])), text, kind, similarity, recall)
        if k + 1 < blocks:
            after = write_table(after, "leaks")
            if k:
                drop_table(before)
        before = after
    return before


def _pass(docs: DataFrame, rows: list[tuple], text: str, kind, similarity: float, recall: float) -> DataFrame:
    """``docs`` with the matches of one block of items added to those that there are."""
    from pyspark.sql.pandas.types import to_arrow_type

    carried = Carried(docs, text, [("matches", kind)], [F.col("matches")])
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    arrow, token = to_arrow_type(kind), uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _held:
            _held.clear()
            _held[token] = Index([r for r in shared.value if words_of(*flat(pa.array([r[1]])))[1].size], recall, similarity)
        index = _held[token]
        for part, texts in carried.slices(batches):
            words, bounds, starts, ends = hashed_words(texts)
            off = flat(texts)[1]
            found = verified(index, words, bounds, candidates(index, words, bounds))
            old = part.column(carried.more)
            if not found:
                yield carried.batch(part, [old])
                continue
            out = old.to_pylist()
            for t, i, first, end, cost in found:
                at = bounds[t]
                out[t].append({"item": index.ids[i], "start": int(starts[at + first] - off[t]), "end": int(ends[at + end - 1] - off[t]), "edits": cost})
            for t in {f[0] for f in found}:
                out[t].sort(key=lambda m: (m["item"], m["start"]))
            yield carried.batch(part, [pa.array(out, arrow)])

    return carried.source.mapInArrow(work, carried.schema)
