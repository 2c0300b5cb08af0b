"""Edit-aware token counts: a segment tree of pre-tokens per document, mended where edits touch it.

A pre-token depends only on the text from its start on, so after an edit the old cuts hold before the
pre-token that reaches the edit, and again from the first cut behind it that the new text shares.
Leaves hold runs of pre-tokens; inner nodes hold sums of characters and tokens. An edit descends to
the leaves that it touches by character sums, splits and counts that stretch anew, and renews the
sums on the way up.

build() makes the trees of a table of documents: columns that are kept beside the text, so edits that
come later find the sums there. recount() applies edits to them and gives the table of the new trees.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from seqloom.llm.common import Carried

#: Pre-tokens of a leaf when a tree is built.
LEAF = 64
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 1 << 20

Edit = tuple[int, int, str]  # start, end (code points of the text before all edits), replacement


class Counter:
    """Pre-token cuts and token counts of one vocabulary."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, parts: Sequence[str]) -> list[int]:
        known = self.known
        for part in set(parts).difference(known):
            known[part] = len(self.coder.encode_ordinary(part))
        found = [known[p] for p in parts]
        if len(known) > REMEMBERED:
            known.clear()
        return found


@lru_cache(maxsize=2)
def counter(ranks_file: str, pattern: str) -> Counter:
    return Counter(ranks_file, pattern)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, behind a byte that says how many."""
    top = int(values.max(initial=0))
    wide = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([wide]) + values.astype(f"<u{wide}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Tree:
    """Pre-tokens of one text. ``chars`` and ``tokens`` are heaps of sums; leaf k is entry ``wide + k``.

    A leaf that no edit has come near is a range of the text; its pre-tokens are cut out when they are needed.
    """

    def __init__(self, text: str, sizes: np.ndarray, counts: np.ndarray, coder: Counter, heaps: tuple[list[int], list[int]] | None = None):
        self.coder, self.text, self.sizes, self.numbers = coder, text, sizes, counts
        many = max(1, -(-len(sizes) // LEAF))
        self.wide = 1 << (many - 1).bit_length()
        self.cut: dict[int, tuple[list[str], list[int]]] = {} if len(sizes) else {0: ([], [])}
        self.many, self.recounted = many, 0
        if heaps is None:
            heaps = [0] * (2 * self.wide), [0] * (2 * self.wide)
            edges = np.arange(0, len(sizes), LEAF)
            for heap, values in zip(heaps, (sizes, counts)):
                if len(edges):
                    heap[self.wide : self.wide + many] = np.add.reduceat(values, edges).tolist()
                for k in range(self.wide - 1, 0, -1):
                    heap[k] = heap[2 * k] + heap[2 * k + 1]
        self.chars, self.tokens = heaps
        self.begins = None

    @classmethod
    def of(cls, text: str, coder: Counter) -> Tree:
        parts = coder.split.findall(text)
        return cls(text, np.fromiter(map(len, parts), np.int64, len(parts)), np.array(coder.counts(parts), np.int64), coder)

    @classmethod
    def load(cls, text: str, stored: dict, coder: Counter) -> Tree:
        chars, tokens = (unpacked(stored[c]).tolist() for c in ("chars", "tokens"))
        return cls(text, unpacked(stored["sizes"]), unpacked(stored["counts"]), coder, (chars, tokens))

    def store(self) -> dict:
        """What load() reads beside the text; leaves are made even again, which counts nothing anew."""
        tree = self if not self.recounted else Tree(*self.flat(), self.coder)
        return {"sizes": packed(tree.sizes), "counts": packed(tree.numbers), "chars": packed(np.array(tree.chars)), "tokens": packed(np.array(tree.tokens))}

    def flat(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text as it is now, with sizes and counts of its pre-tokens."""
        leaves = [self.leaf(k) for k in range(self.many)]
        text = "".join(p for parts, _ in leaves for p in parts)
        sizes = np.array([len(p) for parts, _ in leaves for p in parts], np.int64)
        return text, sizes, np.array([c for _, counts in leaves for c in counts], np.int64)

    def leaf(self, k: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and counts of a leaf."""
        if k not in self.cut:
            if self.begins is None:
                self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
            edges = self.begins[k * LEAF : (k + 1) * LEAF + 1].tolist()
            self.cut[k] = [self.text[a:b] for a, b in zip(edges, edges[1:])], self.numbers[k * LEAF : (k + 1) * LEAF].tolist()
        return self.cut[k]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token, its first character) of the character at ``at``; past the end, the last leaf's end."""
        node, begin = 1, 0
        while node < self.wide:
            left = self.chars[2 * node]
            # the last character belongs to the right only if there is one
            if at >= begin + left and self.chars[2 * node + 1]:
                node, begin = 2 * node + 1, begin + left
            else:
                node = 2 * node
        leaf = node - self.wide
        parts, _ = self.leaf(leaf)
        for k, part in enumerate(parts):
            if at < begin + len(part):
                return leaf, k, begin
            begin += len(part)
        return leaf, len(parts), begin

    def _back(self, leaf: int, k: int, begin: int) -> tuple[int, int, int]:
        """The pre-token before, if there is one."""
        while k == 0 and leaf > 0:
            leaf -= 1
            k = len(self.leaf(leaf)[0])
        return (leaf, k - 1, begin - len(self.leaf(leaf)[0][k - 1])) if k else (leaf, 0, begin)

    def _store(self, leaf: int, parts: list[str], counts: list[int]) -> None:
        self.cut[leaf] = parts, counts
        k = self.wide + leaf
        self.chars[k], self.tokens[k] = sum(map(len, parts)), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def apply(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end``; only the stretch that the edit can change is split anew."""
        # two pre-tokens of context: one may reach the edit, the one before may have looked at its first character
        first, k, begin = self._back(*self._back(*self.locate(start)))
        shift = len(new) - (end - start)
        ahead = self._from(first, k)
        taken: list[tuple[int, int, str]] = []
        cuts = {begin: 0}  # old cuts by place, with the pre-tokens taken up to there
        reach, want, more = begin, end, 2
        while True:
            for leaf, j, part in ahead:
                taken.append((leaf, j, part))
                reach += len(part)
                cuts[reach] = len(taken)
                if reach >= want:
                    more -= 1
                    if more <= 0:
                        break
            else:
                more = -1  # the text is at its end
            old = "".join(p for _, _, p in taken)
            parts = self.coder.split.findall(old[: start - begin] + new + old[end - begin :])
            # the first new cut behind the edit that was one before; what follows it is as it was
            place, n = begin, 0
            for n, part in enumerate(parts, 1):
                place += len(part)
                if place - shift >= end and place - shift in cuts and place < reach + shift:
                    break
            else:
                if more >= 0:
                    want, more = reach + 1, 2 * len(taken)
                    continue
                n, place = len(parts), reach + shift
            break
        gone = cuts[place - shift]
        self.recounted += n
        last, over = (taken[gone - 1][0], taken[gone - 1][1] + 1) if gone else (first, k)
        counts = self.coder.counts(parts[:n])
        tail = tuple(x[over:] for x in self.leaf(last))
        for leaf in range(first + 1, last + 1):
            self._store(leaf, *(tail if leaf == last else ([], [])))
        ends = tail if last == first else ([], [])
        head = self.leaf(first)
        self._store(first, head[0][:k] + parts[:n] + ends[0], head[1][:k] + counts + ends[1])

    def _from(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        """Pre-tokens from a place on, with their places."""
        for at in range(leaf, self.many):
            parts, _ = self.leaf(at)
            for j in range(k if at == leaf else 0, len(parts)):
                yield at, j, parts[j]


def apply_edits(text: str, edits: Sequence[Edit]) -> str:
    """The text after all edits; places are those of the text before them."""
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        text = text[:start] + new + text[end:]
    return text


def usable(edits: Sequence[Edit], length: int) -> list[Edit]:
    """Edits clipped to the text, in order from its end; of edits that overlap an earlier one, the later go."""
    out, done = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1], e[2])):
        start, end = min(max(0, start), length), min(max(start, end, 0), length)
        if start >= done:
            out.append((start, end, new))
            done = max(end, start)
    return out[::-1]


TREE = StructType([StructField(n, BinaryType()) for n in ("sizes", "counts", "chars", "tokens")])
ARROW_TREE = pa.struct([(n, pa.binary()) for n in TREE.names])


def build(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the segment tree of every text (``tree``), ``n_pretokens`` and ``n_tokens``; write it to keep the trees.

    Null texts count as empty. Columns with the names of results are replaced; repeated rows stay.
    """
    carried = Carried(docs, text, [("tree", TREE), ("n_pretokens", LongType()), ("n_tokens", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = counter(ranks_file, pattern)
        for part, texts in carried.slices(batches):
            trees = [Tree.of(t, coder) for t in texts.to_pylist()]
            yield carried.batch(part, [pa.array([t.store() for t in trees], ARROW_TREE), pa.array([len(t.sizes) for t in trees], pa.int64()), pa.array([t.total for t in trees], pa.int64())])

    return carried.source.mapInArrow(work, carried.schema)


def recount(trees: DataFrame, edits: Column, ranks_file: str, pattern: str, text: str = "text", updated: bool = True) -> DataFrame:
    """Add ``n_before``, ``n_after`` (tokens) and ``n_recounted`` (pre-tokens counted anew) to the rows of build().

    ``edits`` is an array of (start, end, replacement) per row, in code points of the text as it is;
    edits are clipped to the text, and those that overlap an earlier one are left out. Null edits
    count as none, a null replacement as empty. With ``updated``, text, tree, n_pretokens and n_tokens
    become those after the edits, so that the result takes the place of the table of trees; without,
    they stay out. A row without a tree (null) has one made first. Columns with the names of results
    are replaced; repeated rows stay.
    """
    numbers = ["n_before", "n_after", "n_recounted"]
    results = [(n, LongType()) for n in numbers]
    if updated:
        results = [(text, StringType()), ("tree", TREE), ("n_pretokens", LongType()), ("n_tokens", LongType()), *results]
    shown = F.coalesce(edits, F.array()).cast("array<struct<start:int,end:int,new:string>>")
    keep = [c for c in trees.columns if c not in (text, "tree", "n_tokens")]
    carried = Carried(trees, text, results, [F.col("tree"), shown], keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = counter(ranks_file, pattern)
        for part, texts in carried.slices(batches):
            stored, lists = (part.column(carried.more + k).to_pylist() for k in (0, 1))
            new, rows = [], []
            for body, held, list_ in zip(texts.to_pylist(), stored, lists):
                tree = Tree.load(body, held, coder) if held else Tree.of(body, coder)
                before = tree.total
                for start, end, put in usable([(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in list_ if e], len(body)):
                    tree.apply(start, end, put)
                rows.append((before, tree.total, tree.recounted))
                if updated:
                    after, sizes, _ = tree.flat()
                    new.append((after, tree.store(), len(sizes), tree.total))
            counts = np.array(rows, np.int64).reshape(-1, 3)
            columns = [pa.array(np.ascontiguousarray(counts[:, j])) for j in range(3)]
            if updated:
                columns = [pa.array(c, k) for c, k in zip(zip(*new), (pa.string(), ARROW_TREE, pa.int64(), pa.int64()))] + columns
            yield carried.batch(part, columns)

    return carried.source.mapInArrow(work, carried.schema)
