"""Tags for streams of items: a sequence is held until its end comes, then tagged as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seqloom.operators.chain import Chain
from seqloom.operators.crf import LinearChainCRFModel
from seqloom.operators.crf_blocks import tagged

OUT = "seq string, pos long, pred string, marginal double, probability double"
#: The state store that lists and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds without an item after which an open sequence ends by itself.
IDLE = 3_600_000


#: A sequence that has ended: places, numbers of attributes, and the attributes of all items.
WHOLE = "seq string, pos array<long>, sizes array<int>, attrs array<string>, `values` array<double>"


def run_available(writer: DataStreamWriter) -> None:
    """Start a stream, and wait until all that is there is done.

    Timers by the clock ask for one empty batch after another, so that such a run would never end: it does
    without empty batches, and timers that are due fire with its data.
    """
    spark, empty = writer._spark, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)
    query.awaitTermination()


class _Assembler(StatefulProcessor):
    """Items of a sequence are appended as they come; only an end reads them. ``idle`` of 0 waits for ever."""

    def __init__(self, idle: int, forget: int):
        self.idle, self.forget = idle, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "pos long, attrs array<string>, `values` array<double>", self.forget or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, ended = [], False
        for frame in rows:
            for pos, feats, last in zip(frame["pos"], frame["feats"], frame["last"]):
                feats = feats if feats is not None else []
                new.append((int(pos), [f["attr"] for f in feats], [1.0 if f["value"] is None else float(f["value"]) for f in feats]))
                ended = ended or bool(last)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if ended:
            yield from self._end(key, new)
            return
        self.items.appendList(new)
        if self.idle:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._end(key, [])

    def _end(self, key: tuple, new: list[tuple]) -> Iterator[pd.DataFrame]:
        held = sorted([*map(tuple, self.items.get()), *new], key=lambda x: x[0])
        self.items.clear()
        if held:
            yield pd.DataFrame({"seq": [str(key[0])], "pos": [[p for p, _, _ in held]], "sizes": [[len(a) for _, a, _ in held]], "attrs": [[x for _, a, _ in held for x in a]], "values": [[x for _, _, v in held for x in v]]})

    def close(self) -> None:
        pass


def assemble(items: DataFrame, idle: int = IDLE, forget: int = 0) -> DataFrame:
    """WHOLE sequences of a stream (seq, pos, feats, last), each when it ends; see tag_stream()."""
    items.sparkSession.conf.set(*STORE)
    return items.groupBy("seq").transformWithStateInPandas(_Assembler(idle, forget), WHOLE, "Append", "ProcessingTime")


def tag_stream(items: DataFrame, model: LinearChainCRFModel, idle: int = IDLE, forget: int = 0) -> DataFrame:
    """``seq, pos, pred, marginal, probability`` of a stream (seq, pos, feats, last): feats an array of (attr, value).

    Items of a sequence may come in any order and over any number of batches; a row with ``last`` (whose
    pos counts, its feats may be empty or null) says that the sequence is complete up to it. Items then
    missing are not waited for: rows that come later begin a sequence anew. A sequence without a new item
    for ``idle`` milliseconds is tagged as it stands, at the first batch after that; with 0 none is.
    ``forget`` drops items that have been held for so many milliseconds, 0 keeps them. Unknown attributes
    are passed over. State holds open sequences alone. Sets the session's state store to the one that
    lists and timers need.
    """
    names = {r["attr"]: r["aid"] for r in model.attrs.collect()}  # the model is driver-sized as its weights are
    shared = items.sparkSession.sparkContext.broadcast((names, model.layout, model.weights, model.labels))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, layout, weights, labels = shared.value
        for frame in frames:
            for seq, pos, sizes, attrs, values in zip(*(frame[c] for c in ("seq", "pos", "sizes", "attrs", "values"))):
                known = np.array([a in names for a in attrs], bool)
                at = np.repeat(np.arange(len(sizes)), np.asarray(sizes, np.int64))[known]
                item = {"sizes": np.bincount(at, minlength=len(sizes)), "at": at, "aids": np.array([names[a] for a in attrs if a in names], np.int64), "values": np.asarray(values, np.float64)[known]}
                pred, marginal, probability, _ = tagged(Chain(*layout.scores(weights, item)), labels)
                yield pd.DataFrame({"seq": seq, "pos": pos, "pred": pred, "marginal": marginal, "probability": probability})

    return assemble(items, idle, forget).mapInPandas(work, OUT)
