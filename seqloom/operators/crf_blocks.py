"""Chains whose weights no driver or worker holds whole: sequences in shards, weights in blocks.

A shard is one row with all that is needed of some sequences: their items, the features that their
attributes have, and those features' ids. For an evaluation each block sends each shard the weights it
asks for, and gets the gradient's entries back; labels and pairs of labels alone are known everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.operators.blockvectors import Gradient
from seqloom.operators.chain import Chain, best_path
from seqloom.operators.crf_layout import Layout, likelihood, stacks
from seqloom.sources.staging import dropped, staged

#: Attribute values of a shard, some; one sequence is never parted.
SHARD = 1 << 18
TAGS = "__seq string, pred array<string>, marginal array<double>, probability double, all array<double>"
SHARDS = "shard long, seqs array<string>, lengths binary, y binary, sizes binary, aids binary, values binary, fids binary, first binary, lids binary, moves binary, weights binary"


def _dealt(packed: DataFrame, features: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Packed sequences with their ``shard``, and ``of, aid, fid, lid, weight``: the features that each shard's attributes have."""
    packed = staged(packed, "packed")
    many = packed.agg(F.sum(F.size("aids")).alias("n")).first()["n"] or 0
    count = max(1, -(-many // size))
    seqs = packed.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(count)))
    asked = seqs.select("shard", F.explode(F.array_distinct("aids")).alias("s")).distinct().withColumn("s", F.col("s").cast("long"))
    return seqs, asked.join(features.where("type = 0").select("s", "fid", "d", "weight"), "s").select(F.col("shard").alias("of"), F.col("s").alias("aid"), "fid", F.col("d").alias("lid"), "weight")


def _arrays(some: pd.DataFrame, feats: pd.DataFrame, own: np.ndarray) -> dict[str, bytes]:
    """The binary columns of SHARDS of some sequences; ``own`` are the ids of the label pairs."""
    feats = feats.sort_values("fid")
    aids = np.concatenate([np.zeros(0, np.int64), *some["aids"]]).astype(np.int64)
    names, local = np.unique(aids, return_inverse=True)
    first = np.searchsorted(feats["aid"].to_numpy(np.int64), np.append(names, np.iinfo(np.int64).max))
    fids = np.concatenate([feats["fid"].to_numpy(np.int64), own])
    joined = {k: np.concatenate([np.zeros(0), *some[k]]) for k in ("y", "sizes", "values")}
    arrays = {"lengths": some["y"].map(len).to_numpy(np.int64), "y": joined["y"].astype(np.int64), "sizes": joined["sizes"].astype(np.int64), "aids": local.astype(np.int64), "values": joined["values"].astype(np.float64)}
    arrays |= {"fids": fids, "first": first.astype(np.int64), "lids": feats["lid"].to_numpy(np.int64), "moves": np.arange(len(feats), len(fids)), "weights": feats["weight"].to_numpy(np.float64)}
    return {k: v.tobytes() for k, v in arrays.items()}


def shards(packed: DataFrame, features: DataFrame, moves: list[tuple[int, int, int]], size: int = SHARD) -> DataFrame:
    """SHARDS of packed sequences (crf.pack) for features ``fid, type, s, d, weight``; ``moves`` are the label pairs' (fid, from, to)."""
    seqs, known = _dealt(packed, features, size)
    own = np.array([m[0] for m in moves], np.int64)

    def build(key: tuple, some: pd.DataFrame, feats: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame()
        some = some.sort_values("seq")
        return pd.DataFrame({"shard": [key[0]], "seqs": [some["seq"].tolist()], **{k: [v] for k, v in _arrays(some, feats, own).items()}})

    return seqs.groupBy("shard").cogroup(known.groupBy("of")).applyInPandas(build, SHARDS)


class Shard:
    """A row of shards(), opened: its sequences, and a Layout over the features it asks for."""

    def __init__(self, row: dict, moves: np.ndarray, labels: int):
        ints = {k: np.frombuffer(row[k], np.int64) for k in ("lengths", "y", "sizes", "aids", "fids", "first", "lids", "moves")}
        self.fids, self.seqs = ints["fids"], row["seqs"]
        values = np.frombuffer(row["values"], np.float64)
        self.weights = np.frombuffer(row["weights"], np.float64)
        table = np.zeros((len(self.fids), 4), np.int64)
        table[:, 0] = np.arange(len(self.fids))
        held = len(self.fids) - len(moves)
        table[:held, 2], table[:held, 3] = np.repeat(np.arange(len(ints["first"]) - 1), np.diff(ints["first"])), ints["lids"]
        table[held:, 1] = 1
        table[held:, 2:] = moves[:, 1:]
        self.layout = Layout(table, len(ints["first"]) - 1, labels)
        ends, value_ends = np.cumsum(ints["lengths"]), np.append(0, np.cumsum(ints["sizes"]))
        self.items = []
        for n, end in zip(ints["lengths"], ends):
            a, b = value_ends[end - n], value_ends[end]
            sizes = ints["sizes"][end - n : end]
            self.items.append({"y": ints["y"][end - n : end], "sizes": sizes, "at": np.repeat(np.arange(n), sizes), "aids": ints["aids"][a:b], "values": values[a:b]})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def objective(held: DataFrame, moves: list[tuple[int, int, int]], labels: int, size: int, block: int, c2: float) -> tuple[Gradient, Callable[[], None]]:
    """Loss and gradient of a vector of ``size`` in blocks over SHARDS, with the squared norm; and what frees the tables it keeps."""
    pairs = np.array(moves, np.int64).reshape(-1, 3)
    many = held.count()
    groups = max(1, int(np.sqrt(many)))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            fids = np.frombuffer(row["fids"], np.int64)
            blocks, begin = np.unique(fids // block, return_index=True)
            places = [(fids[a:b] % block).astype(np.int32).tobytes() for a, b in zip(begin, [*begin[1:], len(fids)])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(blocks), row["shard"], np.int64)), pa.array(places, pa.binary())], names=["block", "shard", "places"])

    needs = held.select("shard", "fids").mapInArrow(asks, "block long, shard long, places binary")
    needs = needs.repartition("block").persist()
    kept = held.repartition("shard").persist()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = np.frombuffer(row["w"], np.float64)[np.frombuffer(row["places"], np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), pa.array([row["block"]]), pa.array([w.tobytes()])], names=["shard", "block", "w"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = Shard(row, pairs, labels)
            w = np.concatenate([*(np.frombuffer(p["w"], np.float64) for p in row["sent"] or []), np.zeros(1)])
            grad, loss = np.zeros(len(w)), 0.0
            for item in stacks(shard.items, labels):
                loss += likelihood(shard.layout, w, item, grad)
            blocks, begin = np.unique(shard.fids // block, return_index=True)
            cut = [*zip(begin, [*begin[1:], len(shard.fids)])]
            parts = [grad[a:b].tobytes() for a, b in cut]
            places = [(shard.fids[a:b] % block).astype(np.int32).tobytes() for a, b in cut]
            # the loss goes as block -1
            yield pa.RecordBatch.from_arrays([pa.array([-1, *blocks.tolist()]), pa.array([row["shard"] % groups] * (len(cut) + 1)), pa.array([np.zeros(1, np.int32).tobytes(), *places]), pa.array([np.array([loss]).tobytes(), *parts])], names=["block", "k", "places", "g"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        b = key[-1]
        total = np.zeros(1 if b < 0 else min(block, size - b * block))
        for places, g in sorted(zip(frame["places"], frame["g"])):  # in an order that no shuffle changes
            np.add.at(total, np.frombuffer(places, np.int32), np.frombuffer(g, np.float64))
        return pd.DataFrame({"block": [b], "places": [np.arange(len(total), dtype=np.int32).tobytes()], "g": [total.tobytes()]})

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = np.frombuffer(row["w"], np.float64)
            g = (np.frombuffer(row["g"], np.float64) if row["g"] else 0.0) + 2 * c2 * w
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([g.tobytes()]), pa.array([c2 * float(w @ w)])], names=["block", "g", "norm"])

    last: list[DataFrame] = []

    def evaluate(vector: DataFrame) -> tuple[float, DataFrame]:
        while last:
            dropped(last.pop())
        sent = vector.join(needs, "block").mapInArrow(send, "shard long, block long, w binary")
        sent = sent.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("block", "w"))).alias("sent"))
        parts = kept.join(sent, "shard", "left").mapInArrow(work, "block long, k long, places binary, g binary")
        schema = "block long, places binary, g binary"
        if groups > 1:
            parts = parts.groupBy("k", "block").applyInPandas(add, schema)
        sums = staged(parts.groupBy("block").applyInPandas(add, schema), "gradient")
        loss = sum(np.frombuffer(r["g"], np.float64)[0] for r in sums.where("block < 0").collect())
        full = vector.join(sums.where("block >= 0").select("block", "g"), "block", "left")
        out = staged(full.mapInArrow(regular, "block long, g binary, norm double"), "gradient")
        dropped(sums)
        last.append(out)
        return float(loss + (out.agg(F.sum("norm")).first()[0] or 0.0)), out.select("block", "g")

    def free() -> None:
        needs.unpersist()
        kept.unpersist()
        while last:
            dropped(last.pop())

    return evaluate, free


def tags(packed: DataFrame, features: DataFrame, moves: list[tuple[int, int, int, float]], labels: list[str], size: int = SHARD) -> DataFrame:
    """TAGS and ``places`` of packed sequences that have these, by features ``fid, type, s, d, weight``; ``moves`` carry theirs.

    A shard is tagged where it is built, so that a worker holds one at a time.
    """
    seqs, known = _dealt(packed, features, size)
    pairs = np.array([m[:3] for m in moves], np.int64).reshape(-1, 3)
    own = np.array([m[3] for m in moves] + [0.0])

    def work(key: tuple, some: pa.Table, feats: pa.Table) -> pa.Table:
        frame = some.select(["seq", "y", "sizes", "aids", "values"]).to_pandas()
        if not len(frame):
            return tag_table([], some["places"])
        shard = Shard({"seqs": frame["seq"].tolist(), **_arrays(frame, feats.to_pandas(), pairs[:, 0])}, pairs, len(labels))
        w = np.concatenate([shard.weights, own])
        return tag_table([(seq, *tagged(Chain(*shard.layout.scores(w, item)), labels)) for seq, item in zip(shard.seqs, shard.items)], some["places"])

    return seqs.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(work, StructType([*StructType.fromDDL(TAGS).fields, seqs.schema["places"]]))


def tag_table(rows: list[tuple], places: pa.ChunkedArray | pa.Array) -> pa.Table:
    """TAGS of sequences beside their places."""
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()))
    columns = zip(*rows) if rows else ([],) * len(kinds)
    return pa.table([*(pa.array(c, kind, from_pandas=True) for c, kind in zip(columns, kinds)), places], names=["__seq", "pred", "marginal", "probability", "all", "places"])


def tagged(chain: Chain, labels: list[str]) -> tuple[list[str], list[float], float, list[float]]:
    """Best labels, their marginals, the path's probability, and all marginals item by item."""
    path, _ = best_path(chain.state, chain.trans)
    nodes = chain.node_marginals()
    return [labels[y] for y in path], nodes[np.arange(len(path)), path].tolist(), float(np.exp(chain.log_probability(path))), nodes.ravel().tolist()


def stage(held: DataFrame) -> DataFrame:
    return staged(held, "shards")
