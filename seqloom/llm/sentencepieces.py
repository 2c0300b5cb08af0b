"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary continues past a whitespace marker or holds a newline, so merges in one
chunk (a run of markers with the text after it, or a newline with the text after it) never touch
those of another. A worker keeps the distinct chunks that it meets in one table, segments each once
with the library and joins ids and decoded bytes back to the texts by chunk position. The table is
kept over slices and tasks up to a bound of memory and then begun anew; nothing is shuffled, as a
join with one table of the whole corpus would have to send every word of every text twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from seqloom.llm.common import Carried, flat, from_offsets

MARK = "▁"
#: Bytes of text that are worked on at a time, and (estimated) bytes of a worker's table of chunks.
SLICE_BYTES, MOST_BYTES = 2 << 20, 96 << 20


def processor(model: str):
    """The library's processor; pieces must not cross markers or newlines, which is checked here."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or ("\n" in piece and not sp.is_byte(i)):
            raise ValueError(f"piece {i} crosses a chunk boundary; the chunk table needs a model split by whitespace")
    if sp.decode(sp.encode("  a \n  b ")) != "  a \n  b ":
        raise ValueError("the model's normaliser rewrites white space; the chunk table needs one that keeps it")
    return sp


class ChunkTable:
    """Distinct chunks that this worker has met, each segmented once: bytes to (ids, decoded bytes)."""

    def __init__(self, model: str, most: int = MOST_BYTES):
        self.sp, self.most = processor(model), most
        self.known: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.held = 0

    def look_up(self, chunks: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
        """Entries of the chunks; those not yet known are segmented as they are inside a longer text."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if new:
            if self.held > self.most:  # begun anew, so that memory is bounded however many words there are
                known.clear()
                self.held, new = 0, chunks
            mark = self.sp.piece_to_id(MARK)
            shown = [c.decode() for c in new]
            opened = [c[0] in (" ", MARK) for c in shown]  # the library itself puts a marker in front
            ids = self.sp.encode([c[1:] if o else c for c, o in zip(shown, opened)], num_threads=1)
            ids = [(i or [mark]) if o else i[1:] for i, o in zip(ids, opened)]
            texts = self.sp.decode(ids, num_threads=1)
            for c, i, t, o in zip(new, ids, texts, opened):
                known[c] = np.array(i, np.int32), (" " + t if o else t).encode()
            self.held += sum(map(len, new)) * 3 + 300 * len(new)
        return [known[c] for c in chunks]


@lru_cache(maxsize=1)
def chunk_table(model: str) -> ChunkTable:
    """The table of this worker, kept for later slices and tasks."""
    return ChunkTable(model)


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks begin: at text starts, at the first marker of a run and at newlines."""
    marker = buf == 32
    after = np.zeros(len(buf) + 3, bool)
    after[1 : len(buf) + 1] = marker
    if (buf == 0xE2).any():  # the marker's own character in a text
        bar = np.zeros(len(buf), bool)
        bar[:-2] = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
        marker |= bar
        after[3 : len(buf) + 3] |= bar
    starts = marker & ~after[: len(buf)] | (buf == 10)
    starts[off[:-1][off[1:] > off[:-1]]] = True
    return np.flatnonzero(starts)


def encode_slice(table: ChunkTable, texts: pa.Array, end_id: bool) -> tuple[pa.Array, pa.Array]:
    buf, off = flat(texts)
    full = off[1:] > off[:-1]
    led = np.insert(buf, off[:-1][full], 32)  # the marker that the library puts before a text
    shift = np.concatenate([[0], np.cumsum(full)])
    off = off + shift
    starts = chunk_starts(led, off)
    coded = from_offsets(led, np.append(starts, len(led))).dictionary_encode()
    entries = table.look_up(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy()
    bounds = np.searchsorted(starts, off)
    # ids, joined back by position
    sizes = np.fromiter((len(i) for i, _ in entries), np.int64, len(entries))
    first = np.concatenate([[0], np.cumsum(sizes)])
    pool = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in entries)])
    size = sizes[at]
    to = np.concatenate([[0], np.cumsum(size)])
    every = pool[np.arange(to[-1]) + np.repeat(first[at] - to[:-1], size)]
    ends = to[bounds]
    if end_id:
        every = np.insert(every, ends[1:], table.sp.eos_id())
        ends = ends + np.arange(len(ends))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(every))
    # decoded text: without the marker that the library put there
    bytes_, edges = flat(pa.array([d for _, d in entries], pa.large_binary()).take(pa.array(at, pa.int64())))
    edges = edges[bounds]
    keep = np.ones(len(bytes_), bool)
    keep[edges[:-1][full]] = False
    edges = edges - shift
    return lists, from_offsets(bytes_[keep], edges, pa.string())


def encode(docs: DataFrame, model: str, end_id: bool = True, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (array of int) and ``decoded`` (the decoding of those ids) to ``docs``.

    Null and empty texts give the end id alone and an empty decoding. Columns of ``docs`` that have
    the names of results are replaced; repeated rows stay.
    """
    carried = Carried(docs, text, [("token_ids", ArrayType(IntegerType())), ("decoded", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for part, texts in carried.slices(batches, SLICE_BYTES):
            yield carried.batch(part, encode_slice(table, texts, end_id))

    return carried.source.mapInArrow(work, carried.schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and hashes of the ids and the decoded text of encode()."""
    return encoded.select(
        key,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
