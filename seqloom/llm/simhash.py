"""SimHash near-duplicates: fingerprints, and vantage-point trees for the pairs within a Hamming radius.

A small tree over a bounded sample of fingerprints parts the Hamming space into shards. Each
fingerprint lives in one shard and visits the shards that its ball may reach, as the triangle
inequality tells at every vantage point; between two residents only the outer one visits. Inside a
shard the same rule prunes a tree built over the residents, down to leaves that are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqloom.llm.common import Carried, fresh, quoted, whole_text, write_table
from seqloom.llm.components import components

#: Differing bits at which fingerprints link.
RADIUS = 3
#: Residents that a shard is meant to hold (few large shards are visited less often), the most that one is worked on with,
#: and the fingerprints sampled of one that is parted.
SHARD, MOST, SAMPLE = 1 << 15, 1 << 17, 1 << 12
#: Residents of a leaf inside a shard.
LEAF = 192
#: For each byte, its eight bits as eight 8-bit lanes of a word.
LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int = 3) -> list[int]:
    """XXH64 (seed 42) of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if len(parts) <= words:
        return [xxh64_intdigest(b" ".join(parts), 42)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: -words]])
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For successive groups of hashes, the word of bits that over half of them have; 0 for empty groups."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    full = sizes > 0
    n = sizes[full]
    # lanes hold up to 255, so long groups are summed in blocks
    blocks = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(first, blocks) + 255 * nth, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    out[full] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit fingerprint (as a signed long) of every whole text; 0 where it has no words."""
    carried = Carried(docs, text, [(name, LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in carried.slices(batches):
            found = [np.array(shingle_hashes(t, words), np.uint64) for t in texts.cast(pa.binary()).to_pylist()]
            bits = majority(np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))
            yield carried.batch(part, [pa.array(bits.view(np.int64))])

    return carried.source.mapInArrow(work, carried.schema)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fp`` of every row."""
    return with_fingerprint(docs.select(quoted(key), quoted(text)), text, words).select(quoted(key), "fp")


def _distance(points: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ pivot).astype(np.int16)


def _pivot(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage point whose split lets the fewest fingerprints reach over it, and the median; None if nothing splits."""
    step = max(1, len(points) // 16)
    looked = points[:: max(1, len(points) // 2048)]
    best = None
    for pivot in points[::step][:16]:
        d = _distance(looked, pivot)
        mid = int(np.median(d))
        if d.max() == mid:
            mid -= 1
        inside = np.count_nonzero(d <= mid) / len(d)
        if not 0 < inside < 1:
            continue
        cost = np.count_nonzero((d > mid - RADIUS) & (d <= mid + RADIUS)) / len(d) + 2 * abs(inside - 0.5)
        if best is None or cost < best[0]:
            best = (cost, pivot, mid)
    return best and best[1:]


def _spread(d: np.ndarray, mid: int, residents: np.ndarray, n: int, radius: int) -> tuple:
    """Of entries with distances ``d`` (the first ``n`` are residents): who goes inside and outside, as residents and visitors."""
    own, seen = d[:n], d[n:]
    return (
        np.flatnonzero(own <= mid),
        np.concatenate([np.flatnonzero((own > mid) & (own <= mid + radius)), n + np.flatnonzero(seen <= mid + radius)]),
        np.flatnonzero(own > mid),
        n + np.flatnonzero(seen > mid - radius),
    )


def shard_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Nodes (pivot, median, inside, outside) over a sample; a negative child ``-1 - s`` is shard ``s``. No nodes: one shard."""
    nodes: list[list] = []
    todo, made = [(np.unique(sample), shards, None, 0)], 0
    while todo:
        points, want, parent, side = todo.pop()
        split = _pivot(points) if want > 1 and len(points) > 8 else None
        if split is None:
            ref, made = -1 - made, made + 1
        else:
            ref = len(nodes)
            nodes.append([split[0], split[1], None, None])
            d = _distance(points, split[0])
            todo += [(points[d <= split[1]], want // 2, ref, 2), (points[d > split[1]], want - want // 2, ref, 3)]
        if parent is not None:
            nodes[parent][side] = ref
    return [tuple(n) for n in nodes]


def route(nodes: list[tuple], points: np.ndarray, radius: int = RADIUS, visiting: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (shard, number of the point, home): each point once at home, and once in every shard that it visits; those that
    are ``visiting`` already have no home."""
    everyone = np.arange(len(points))
    todo = [(0 if nodes else -1, everyone, 0 if visiting else len(points))]
    shards, who, home = [], [], []
    while todo:
        ref, ids, n = todo.pop()
        if not len(ids):
            continue
        if ref < 0:
            shards.append(np.full(len(ids), -1 - ref, np.int32))
            who.append(ids)
            home.append(np.arange(len(ids)) < n)
            continue
        pivot, mid, inside, outside = nodes[ref]
        a, b, c, e = _spread(_distance(points[ids], pivot), mid, ids, n, radius)
        todo += [(inside, ids[np.concatenate([a, b])], len(a)), (outside, ids[np.concatenate([c, e])], len(c))]
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((shards, np.int32), (who, np.int64), (home, bool)))


def close_pairs(points: np.ndarray, residents: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of pairs within ``radius``, in blocks: residents (the first ones) with each other, and with visitors."""
    todo = [(np.arange(len(points)), residents)]
    while todo:
        ids, n = todo.pop()
        if n == 0 or len(ids) < 2:
            continue
        split = _pivot(points[ids[:n]]) if n > LEAF else None
        if split is None:
            own, every = points[ids[:n]], points[ids]
            rows = max(1, (1 << 20) // len(every))
            for k in range(0, n, rows):
                i, j = np.nonzero(np.bitwise_count(own[k : k + rows, None] ^ every[None, :]) <= radius)
                keep = i + k < j
                if keep.any():
                    yield ids[i[keep] + k], ids[j[keep]]
            continue
        a, b, c, e = _spread(_distance(points[ids], split[0]), split[1], ids, n, radius)
        todo += [(ids[np.concatenate([a, b])], len(a)), (ids[np.concatenate([c, e])], len(c))]


def _forest(points: np.ndarray, residents: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked point with the first point of its group in this shard: as connected as the pairs, and never more than the points."""
    root = np.arange(len(points))

    def top(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(y := root[x], x):
            x = y
        return x

    for i, j in close_pairs(points, residents, radius):
        while True:
            a, b = top(i), top(j)
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            i, j = i[apart], j[apart]
    ends = top(np.arange(len(points)))
    moved = np.flatnonzero(ends != np.arange(len(points)))
    return moved, ends[moved]


def _sharded(distinct: DataFrame, radius: int) -> DataFrame:
    """``shard, fp, home``: every fingerprint once at home, and once in every shard that its ball may reach.

    A shard with more than MOST residents is parted by a tree over a sample of them, round by round, so
    that no shard grows with the corpus. Samples have some 2 * SAMPLE fingerprints of each such shard.
    """
    spark = distinct.sparkSession
    rows = distinct.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(True).alias("home"))
    large, made, stuck = {0: distinct.count()}, 1, set()
    while large:
        share = F.create_map(*[F.lit(x) for s, n in large.items() for x in (s, min(1.0, 2 * SAMPLE / max(1, n)))])
        held = rows.where(F.col("home") & F.col("shard").isin(*large)).where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= share[F.col("shard")] * (1 << 30))
        sample: dict[int, list[int]] = {}
        for r in held.select("shard", "fp").toLocalIterator():
            sample.setdefault(r["shard"], []).append(r["fp"])
        trees = {}
        for shard, n in large.items():
            tree = shard_tree(np.array(sample.get(shard, []), np.int64).view(np.uint64), min(-(-n // SHARD), SAMPLE // 8))
            if tree:
                trees[shard] = (tree, made)
                made += len(tree) + 1
            else:
                stuck.add(shard)  # nothing parts it: as good as equal
        if not trees:
            return rows
        shared = spark.sparkContext.broadcast(trees)

        def scatter(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old, points, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                parts = [np.flatnonzero(~np.isin(old, list(shared.value)))]
                out = [(old[parts[0]], points[parts[0]], home[parts[0]])]
                for shard, (tree, first) in shared.value.items():
                    mine = np.flatnonzero(old == shard)
                    for own in (mine[home[mine]], mine[~home[mine]]):  # visitors have no home here either
                        for k in range(0, len(own), 4096):
                            at = own[k : k + 4096]
                            where, who, there = route(tree, points[at].view(np.uint64), radius, visiting=not home[own[0]])
                            out.append((where + first, points[at][who], there))
                shard, fp, home = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fp), pa.array(home.astype(bool))], names=["shard", "fp", "home"])

        rows = rows.mapInArrow(scatter, "shard long, fp long, home boolean")
        if max(large.values()) <= MOST:
            return rows
        rows = write_table(rows, "shards")
        large = {r["shard"]: r["n"] for r in rows.where("home").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).collect() if r["shard"] not in stuck}
    return rows


def links(prints: DataFrame, radius: int = RADIUS, every: bool = False) -> DataFrame:
    """``a, b``: links between different fingerprints (column fp) within ``radius`` bits.

    By default those of a spanning forest of each shard: as connected as all of them, and no more
    than fingerprints and visits. ``every`` gives each pair once. Empty input gives no rows.
    """
    distinct = prints.select("fp").distinct()
    spread = _sharded(distinct, radius)

    def gather(group: pa.Table) -> pa.Table:
        points, home = np.asarray(group["fp"]).view(np.uint64), np.asarray(group["home"])
        order = np.lexsort((points, ~home))
        points, n = points[order], int(home.sum())
        if every:
            found = [*starmap(lambda i, j: (points[i], points[j]), close_pairs(points, n, radius))]
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (points[:0], points[:0])
        else:
            i, j = _forest(points, n, radius)
            a, b = points[i], points[j]
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return spread.groupBy("shard").applyInArrow(gather, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``key, fp, component_id``: for every row the fingerprint and the smallest key reachable by links, itself included.

    Null and empty texts, and those of white space, have fingerprint 0 and link like any other. A
    null key is never the smallest; a group without any other has a null component. Repeated rows
    stay, and extra columns are left out. Rows with one key and different texts belong to the group
    of their own text.
    """
    prints = write_table(fingerprints(docs, key, text, words), "fingerprints")
    named = _classes(prints.groupBy("fp").agg(F.min(quoted(key)).alias("least")), prints, radius)
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(quoted(key), "fp", "component_id")


def _classes(distinct: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """``fp, least, root`` of the distinct fingerprints (fp, least)."""
    roots = components(links(prints, radius))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every near-duplicate group: that of the smallest key, then the least digest of the text.

    Of rows equal in both one stays. Rows without a key stay, and are never taken for copies. Columns
    keep their names and values; an empty table gives an empty one.
    """
    fp, row = fresh(docs.columns, "fp"), fresh(docs.columns, "row")
    held = write_table(with_fingerprint(docs, text, name=fp).withColumn(row, F.monotonically_increasing_id()), "printed")
    slim = held.select(quoted(key).alias("k"), F.col(fp).alias("fp"), F.md5(whole_text(text)).alias("digest"), F.col(row).alias("row"))
    place = F.struct("k", "digest", "row")
    # copies fall together before their group is looked up, so no group is in one task
    least = write_table(slim.where("k is not null").groupBy("fp").agg(F.min(place).alias("least")), "print_heads")
    heads = _classes(least, slim, RADIUS).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("head"))
    nulls = held.where(quoted(key).isNull())
    found = held.where(quoted(key).isNotNull()).join(heads, F.col(row) == F.col("head"), "left_semi")
    return found.unionByName(nulls).select(*map(quoted, docs.columns))
