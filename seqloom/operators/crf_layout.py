"""Packed sequences, where their features stand in a weight vector, and their likelihood on numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqloom.operators.chain import stacked_sums

PACKED = "seq string, y array<int>, sizes array<int>, aids array<int>, values array<double>"


#: Names of attributes up to which a worker holds all of them; more are joined.
NAMES = 1 << 20
FEATS = "array<struct<attr:string,value:double>>"


def sequences_of(rows: DataFrame) -> DataFrame:
    """``seq, items``: one row per sequence of (seq, pos, label, feats), its items (pos, label, feats) in order. Sequences are taken as they are."""
    if rows.columns == ["seq", "items"]:
        return rows
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("string")
    item = F.struct("pos", label.alias("label"), F.coalesce("feats", F.array().cast(FEATS)).alias("feats"))
    return rows.groupBy("seq").agg(F.array_sort(F.collect_list(item)).alias("items"))


def pack(rows: DataFrame, attrs: DataFrame, labels: list[str], places: bool = False) -> DataFrame:
    """One row per sequence (PACKED); unknown attributes are left out, unknown labels become len(labels). ``places`` adds what the items' pos and label are."""
    named = F.array(*map(F.lit, labels)).cast("array<string>")
    many = F.lit(len(labels))
    seqs = sequences_of(rows).select(
        F.col("seq").cast("string").alias("seq"),
        F.transform("items", lambda x: F.coalesce(F.nullif(F.array_position(named, x["label"]), F.lit(0)) - 1, many).cast("int")).alias("y"),
        F.transform("items", lambda x: F.size(x["feats"])).alias("sizes"),
        F.flatten(F.transform("items", lambda x: x["feats"]["attr"])).alias("attrs"),
        F.flatten(F.transform("items", lambda x: F.transform(x["feats"]["value"], lambda v: F.coalesce(v.cast("double"), F.lit(1.0))))).alias("values"),
        *([F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x["label"].alias("label"))).alias("places")] if places else []),
    )
    more = [f for f in seqs.schema.fields if f.name == "places"]
    if attrs.count() <= NAMES:
        names = attrs.orderBy("aid").select("attr").toArrow()["attr"].combine_chunks()
        return _numbered(seqs, seqs.sparkSession.sparkContext.broadcast(names), more)
    owner = F.flatten(F.transform("sizes", lambda n, k: F.array_repeat(k, n)))
    long = seqs.select("seq", F.explode(F.arrays_zip(owner.alias("k"), F.col("attrs").alias("attr"), F.col("values").alias("value"))).alias("f")).select("seq", "f.*")
    known = long.join(attrs, "attr").groupBy(F.col("seq").alias("of")).agg(F.collect_list(F.struct("k", F.col("aid").cast("int").alias("aid"), "value")).alias("fs"))
    full = seqs.drop("attrs", "values").join(known, F.col("seq").eqNullSafe(F.col("of")), "left")
    full = full.withColumn("fs", F.coalesce("fs", F.array().cast("array<struct<k:int,aid:int,value:double>>")))
    return _numbered(full.select("seq", "y", "sizes", *(F.col("fs")[c].alias(n) for c, n in (("k", "owners"), ("aid", "aids"), ("value", "values"))), *(f.name for f in more)), None, more)


def _numbered(seqs: DataFrame, names: Broadcast | None, more: list[StructField]) -> DataFrame:
    """PACKED rows of sequences whose attributes are names yet, by the array of all names in the order of their numbers; or
    whose attributes have come with their numbers and items in any order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = batch.column("sizes"), batch.column("values").flatten().to_numpy()
            cuts, items = _offsets(sizes), sizes.flatten().to_numpy()
            if names is None:
                aids = batch.column("aids").flatten().to_numpy()
                at = batch.column("owners").flatten().to_numpy() + np.repeat(cuts[:-1], np.diff(_offsets(batch.column("owners"))))
            else:
                found = pc.index_in(batch.column("attrs").flatten(), value_set=names.value)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                at, aids, values = np.repeat(np.arange(len(items)), items)[known], found.drop_null().to_numpy(), values[known]
            order = np.lexsort((values, aids, at))
            counts = np.bincount(at, minlength=len(items)).astype(np.int32)
            ends = np.append(0, np.cumsum(counts))[cuts].astype(np.int32)
            lists = {"sizes": (cuts, counts), "aids": (ends, aids[order].astype(np.int32)), "values": (ends, values[order])}
            held = {c: batch.column(c) for c in ("seq", "y")} | {c: pa.ListArray.from_arrays(pa.array(e), pa.array(v)) for c, (e, v) in lists.items()}
            yield pa.RecordBatch.from_pydict(held | {f.name: batch.column(f.name) for f in more})

    return seqs.mapInArrow(work, StructType([*StructType.fromDDL(PACKED).fields, *more]))


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Where the lists of a column begin and end in its flat values."""
    return (np.asarray(lists.offsets) - lists.offsets[0].as_py()).astype(np.int32)


class Layout:
    """Where features stand in the weight vector. Of state features only those that exist are held, attribute by attribute; the
    table of transitions is dense."""

    def __init__(self, features: Sequence[tuple[int, int, int, int]] | np.ndarray, attrs: int, labels: int):
        """``features`` are rows of id, type, src and dst."""
        self.labels = labels
        self.size = len(features)
        table = np.asarray(features, np.int64).reshape(-1, 4)
        state, move = table[table[:, 1] == 0], table[table[:, 1] == 1]
        state = state[np.argsort(state[:, 2], kind="stable")]
        self.fids, self.lids = state[:, 0].copy(), state[:, 3].copy()
        self.first = np.searchsorted(state[:, 2], np.arange(attrs + 1))
        # one spare entry, of weight 0, stands for pairs of labels without a feature
        self.trans = np.full((labels, labels), self.size, np.int64)
        self.trans[move[:, 2], move[:, 3]] = move[:, 0]

    def spread(self, item: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state features of a sequence's attributes, kept with it: their ids, places in the matrix of its scores, and values."""
        if "spread" not in item:
            self.spread_all([item])
        return item["spread"]

    def spread_all(self, items: list[dict]) -> None:
        """As spread(), of several sequences at once."""
        aids, at, values = (np.concatenate([i[k] for i in items]) if len(items) > 1 else items[0][k] for k in ("aids", "at", "values"))
        begin = self.first[aids]
        sizes = self.first[aids + 1] - begin
        ends = np.cumsum(sizes)
        k = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        fids, cells, values = self.fids[k], self.lids[k] + np.repeat(at * self.labels, sizes), np.repeat(values, sizes)
        ends, a, c = np.append(0, ends).tolist(), 0, 0
        for item in items:
            b = a + len(item["aids"])
            d = ends[b]
            item["spread"] = fids[c:d], cells[c:d], values[c:d]
            a, c = b, d

    def gold(self, item: dict) -> tuple[np.ndarray, np.ndarray]:
        """The places of a sequence's own, known labels in the matrix of its scores, and how often each pair of labels is there; kept with it."""
        if "gold" not in item:
            self.known_all([item])
        return item["gold"]

    def known_all(self, items: list[dict]) -> list[dict]:
        """Several sequences with what spread() and gold() are of each."""
        self.spread_all(items)
        square = self.labels**2
        y, lengths = np.concatenate([i["y"] for i in items]), np.array([len(i["y"]) for i in items])
        ends = np.cumsum(lengths)
        own = (np.arange(len(y)) - np.repeat(ends - lengths, lengths)) * self.labels + y
        inner = np.ones(len(y), bool)
        inner[(ends - lengths)[lengths > 0]] = False  # the first item of a sequence follows nothing
        pairs = np.repeat(np.arange(len(items)) * square, lengths)[1:] + y[:-1] * self.labels + y[1:]
        seen = np.bincount(pairs[inner[1:]], minlength=len(items) * square).reshape(-1, self.labels, self.labels).astype(np.float64)
        for item, moves, a, b in zip(items, seen, (ends - lengths).tolist(), ends.tolist()):
            item["gold"] = own[a:b], moves
        return items

    def scores(self, w: np.ndarray, item: dict) -> tuple[np.ndarray, np.ndarray]:
        """State and transition scores of a sequence, for weights with the spare entry."""
        fids, cells, values = self.spread(item)
        state = np.bincount(cells, w[fids] * values, len(item["sizes"]) * self.labels)
        return state.reshape(-1, self.labels), w[self.trans]

    def add_nodes(self, out: np.ndarray, item: dict, nodes: np.ndarray, sign: float) -> None:
        """Add the state features' values, weighted by (item, label), to a vector with the spare entry."""
        fids, cells, values = self.spread(item)
        np.add.at(out, fids, (sign * nodes).ravel()[cells] * values)

    def on_path(self, item: dict, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and values of a path's state features."""
        fids, cells, values = self.spread(item)
        there = np.zeros((len(path), self.labels + 1), bool)  # unknown labels are the last
        there[np.arange(len(path)), path] = True
        there = there[:, : self.labels].ravel()[cells]
        return fids[there], values[there]

    def add_path(self, out: np.ndarray, item: dict, path: np.ndarray, sign: float) -> None:
        """Add a path's feature values to a vector with the spare entry."""
        fids, values = self.on_path(item, path)
        np.add.at(out, fids, sign * values)
        np.add.at(out, self.trans[path[:-1], path[1:]], sign)


#: Values of state features that are spread at a time.
SPREAD = 1 << 16


def spread_in_order(layout: Layout, items: list[dict], order: np.ndarray) -> Iterator[dict]:
    """Sequences of known labels in an order, with their state features spread for many at once; those that have been handed out are no longer held."""
    some: list[dict] = []
    values = 0
    for k in order.tolist():
        item, items[k] = items[k], None
        more = len(item["aids"]) * layout.labels + layout.labels**2
        if some and values + more > SPREAD:
            yield from layout.known_all(some)
            some, values = [], 0
        some.append(item)
        values += more
    if some:
        yield from layout.known_all(some)


def items_of(frame: pd.DataFrame) -> Iterator[dict]:
    for row in frame.itertuples(index=False):
        sizes = np.asarray(row.sizes, np.int64)
        yield {
            "seq": row.seq, "y": np.asarray(row.y, np.int64), "sizes": sizes, "at": np.repeat(np.arange(len(sizes)), sizes),
            "aids": np.asarray(row.aids, np.int64), "values": np.asarray(row.values, np.float64),
        }


# -- batch objective


#: Scores (items times labels, padding included) that are worked on at a time.
STACK = 1 << 18


def stacks(items: list[dict], labels: int) -> Iterator[dict]:
    """Sequences of like length joined to one that knows their ``lengths``."""
    items = sorted(items, key=lambda i: len(i["sizes"]))
    begin = 0
    while begin < len(items):
        end = begin + 1
        while end < len(items) and (end + 1 - begin) * len(items[end]["sizes"]) * labels <= STACK:
            end += 1
        some = items[begin:end]
        one = {k: np.concatenate([i[k] for i in some]) for k in ("y", "sizes", "aids", "values")}
        one["at"] = np.repeat(np.arange(len(one["sizes"])), one["sizes"])
        one["lengths"] = np.array([len(i["sizes"]) for i in some])
        yield one
        begin = end


def likelihood(layout: Layout, w: np.ndarray, item: dict, grad: np.ndarray) -> float:
    """Minus the log-probability of the labels of a sequence, or of several joined to one; adds its gradient. ``w`` and ``grad`` have the spare entry.

    Where items have ``kinds``, attributes and values are those of kinds, not of items.
    """
    lengths = item.get("lengths", np.array([len(item["y"])]))
    state, trans = layout.scores(w, item)
    kinds, many = item.get("kinds"), len(item["sizes"])
    if kinds is not None:
        state = state[kinds]
    log_norm, nodes, edges = stacked_sums(state, trans, lengths)
    y, labels = item["y"], layout.labels
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - lengths] = False  # the first item of a sequence follows nothing
    moves = np.bincount((y[:-1] * labels + y[1:])[inner[1:]], minlength=labels * labels).reshape(labels, labels)
    own = np.arange(len(y)), y
    nodes[own] -= 1.0
    if kinds is not None:
        nodes = np.bincount((kinds[:, None] * labels + np.arange(labels)).ravel(), nodes.ravel(), many * labels).reshape(many, labels)
    layout.add_nodes(grad, item, nodes, 1.0)
    np.add.at(grad, layout.trans, edges - moves)
    return float(log_norm.sum() - state[own].sum() - (trans * moves).sum())


#: Entries of gradients, and values of state features, that are worked on at a time.
GRADIENTS = 1 << 20


def gradients(layout: Layout, w: np.ndarray, item: dict) -> Iterator[np.ndarray]:
    """Of sequences joined to one that has kinds: rows of the gradient of each sequence's likelihood() alone, some sequences at a time. ``w`` has the spare entry."""
    lengths, labels = item["lengths"], layout.labels
    begin = layout.first[item["aids"]]
    per_attr = layout.first[item["aids"] + 1] - begin
    values_of = np.bincount(item["at"], per_attr, len(item["sizes"])).astype(np.int64)  # by kind
    state, trans = layout.scores(w, item)
    fids, cells, amounts = layout.spread(item)
    first = np.cumsum(values_of) - values_of
    ends, a = np.cumsum(lengths), 0
    held = np.append(0, np.cumsum(values_of[item["kinds"]]))[np.append(0, ends)]  # values before each sequence
    while a < len(lengths):
        most = a + max(1, GRADIENTS // (layout.size + 1 + labels**2))
        b = max(a + 1, min(most, len(lengths), int(np.searchsorted(held, held[a] + GRADIENTS, "right")) - 1))
        kinds, y, many = item["kinds"][ends[a] - lengths[a] : ends[b - 1]], item["y"][ends[a] - lengths[a] : ends[b - 1]], b - a
        _, nodes, edges = stacked_sums(state[kinds], trans, lengths[a:b], apart=True)
        nodes[np.arange(len(y)), y] -= 1.0
        owner = np.repeat(np.arange(many), lengths[a:b])
        inner = owner[1:] == owner[:-1]
        edges = edges.reshape(many, -1) - np.bincount((owner[1:] * labels**2 + y[:-1] * labels + y[1:])[inner], minlength=many * labels**2).reshape(many, -1)
        counts = values_of[kinds]
        k = np.arange(counts.sum()) + np.repeat(first[kinds] - np.cumsum(counts) + counts, counts)
        at = np.repeat(np.arange(len(y)), counts)
        out = np.bincount(owner[at] * (layout.size + 1) + fids[k], nodes[at, cells[k] % labels] * amounts[k], many * (layout.size + 1)).reshape(many, -1).astype(np.float64)  # without any they are counts
        out[:, layout.trans.ravel()] += edges  # each pair has a place of its own, but for the spare
        yield out[:, :-1]
        a = b


# -- sequences as rows of buffers, which tasks read without a loop over their items


JOINED = "seqs array<string>, lengths binary, y binary, kinds binary, sizes binary, aids binary, values binary"
TYPES = {"lengths": np.int64, "y": np.int32, "kinds": np.int32, "sizes": np.int32, "aids": np.int32, "values": np.float64}


def _row(seqs: list[str], one: dict) -> pd.DataFrame:
    return pd.DataFrame({"seqs": [seqs], **{k: [np.asarray(one[k], t).tobytes() if k in one else None] for k, t in TYPES.items()}})


def _condensed(one: dict) -> dict:
    """A stack whose items of like attributes and values are of one kind, of which both are held once."""
    ends = np.cumsum(one["sizes"])
    aids, values = one["aids"].astype(np.int32).tobytes(), one["values"].tobytes()
    found: dict[tuple[bytes, bytes], int] = {}
    kinds = np.array([found.setdefault((aids[4 * a : 4 * b], values[8 * a : 8 * b]), len(found)) for a, b in zip((ends - one["sizes"]).tolist(), ends.tolist())], np.int32)
    held = [*found]
    return one | {"kinds": kinds, "sizes": np.array([len(a) // 4 for a, _ in held]), "aids": np.frombuffer(b"".join(a for a, _ in held), np.int32), "values": np.frombuffer(b"".join(v for _, v in held), np.float64)}


def stacked(packed: DataFrame, labels: int) -> DataFrame:
    """JOINED: a row per stack, with kinds."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for one in stacks([*items_of(frame.sort_values("seq"))], labels):
                yield _row([], _condensed(one))

    return packed.mapInPandas(work, JOINED)


def joined(packed: DataFrame) -> DataFrame:
    """JOINED: a row per batch of sequences in their order, without kinds."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            one = {k: np.concatenate([np.zeros(0), *frame[k]]) for k in ("y", "sizes", "aids", "values")}
            yield _row(frame["seq"].tolist(), one | {"lengths": frame["y"].map(len)})

    return packed.mapInPandas(work, JOINED)


def stacks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of JOINED, opened."""
    for batch in batches:
        columns = {k: batch.column(k) for k in TYPES}
        for k in range(batch.num_rows):
            one = {name: np.frombuffer(c[k].as_buffer(), TYPES[name]) for name, c in columns.items() if c[k].is_valid}
            one = {name: v.astype(np.int64) if v.dtype == np.int32 else v for name, v in one.items()}
            yield one | {"at": np.repeat(np.arange(len(one["sizes"])), one["sizes"])}


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The sequences of each row of joined()."""
    for one in stacks_of(batches):
        ends = np.cumsum(one["lengths"])
        stops = np.append(0, np.cumsum(one["sizes"]))
        items = []
        for a, b in zip((ends - one["lengths"]).tolist(), ends.tolist()):
            c, d = stops[a], stops[b]
            items.append({"y": one["y"][a:b], "sizes": one["sizes"][a:b], "at": one["at"][c:d] - a, "aids": one["aids"][c:d], "values": one["values"][c:d]})
        yield items
