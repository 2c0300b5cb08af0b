"""Quasi-Newton minimisation of vectors that are longer than a driver holds: tables of blocks, dot products as sums.

A vector is rows of block number and float64 bytes. Point, gradient and the steps and turns of the memory
stand side by side in one row per block, so that all of their dot products come from one pass, and the
two loops of the direction run on that small matrix. A direction is then a sum of columns, made block by
block where it is used. The driver sees a few numbers per evaluation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.optimize import LEAST_TURN, Result, Settings, backtrack, coefficients, ended, interpolate, pseudo_gradient
from seqloom.sources.staging import dropped, staged

VECTOR = "block long, w binary"
STATE = "block long, x binary, g binary, steps array<binary>, turns array<binary>, dots array<double>"
#: Value and gradient of a vector (VECTOR): a number, and rows of block and the gradient's bytes.
Gradient = Callable[[DataFrame], tuple[float, DataFrame]]


def zeros(spark: SparkSession, size: int, block: int) -> DataFrame:
    """The vector of so many zeros."""
    full, rest = divmod(size, block)
    length = F.when(F.col("id") < full, block).otherwise(rest)
    bytes_ = F.unhex(F.repeat(F.lit("00" * 8), length.cast("int")))
    return spark.range(full + (rest > 0)).select(F.col("id").alias("block"), bytes_.alias("w"))


def _floats(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.float64)


def _sums(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of an array column, place by place."""
    out = np.zeros(size)
    for r in rows.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


class _State:
    """One block's part of point, gradient and memory."""

    def __init__(self, x: bytes, g: bytes, steps: Sequence[bytes], turns: Sequence[bytes]):
        self.x, self.g = _floats(x), _floats(g)
        self.steps, self.turns = [*map(_floats, steps)], [*map(_floats, turns)]

    def slope(self, c1: float) -> np.ndarray:
        return pseudo_gradient(self.x, self.g, c1) if c1 else self.g

    def direction(self, factors: np.ndarray, live: list[int], c1: float) -> np.ndarray:
        pg = self.slope(c1)
        n = len(live)
        d = factors[2 * n] * pg
        for k, i in enumerate(live):
            d = d + factors[k] * self.steps[i] + factors[n + k] * self.turns[i]
        if c1:
            d[d * pg > 0] = 0
        return d

    def moved(self, factors: np.ndarray, live: list[int], c1: float, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point after a step, the direction and the slope."""
        d, pg = self.direction(factors, live, c1), self.slope(c1)
        at = self.x + step * d
        if c1:
            orthant = np.where(self.x != 0, np.sign(self.x), -np.sign(pg))
            at = np.where(at * orthant > 0, at, 0.0)
        return at, d, pg

    def dots(self, c1: float) -> np.ndarray:
        """Dot products of all steps, turns and the slope, and the squared norm of the point."""
        basis = np.stack([*self.steps, *self.turns, self.slope(c1)])
        return np.append((basis @ basis.T).ravel(), self.x @ self.x)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _State, dict]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["block"], _State(row["x"], row["g"], row["steps"], row["turns"]), row


def _row(block: int, x: np.ndarray, g: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray], c1: float) -> pa.RecordBatch:
    held = _State(x.tobytes(), g.tobytes(), [v.tobytes() for v in steps], [v.tobytes() for v in turns])
    lists = [pa.array([[v.tobytes() for v in vs]], pa.list_(pa.binary())) for vs in (steps, turns)]
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([x.tobytes()]), pa.array([g.tobytes()]), *lists, pa.array([held.dots(c1).tolist()], pa.list_(pa.float64()))], names=["block", "x", "g", "steps", "turns", "dots"])


class _BlockCurve:
    """As optimize.Curve, over tables: the point and the gradient of the last step stay in tables."""

    def __init__(self, f: Gradient, state: DataFrame, factors: np.ndarray, live: list[int], c1: float):
        self.f, self.state, self.factors, self.live, self.c1, self.trials = f, state, factors, live, c1, 0
        self.made: DataFrame | None = None
        self._gain = 0.0

    def __call__(self, step: float) -> tuple[float, float]:
        self.trials += 1
        if self.made is not None:
            dropped(self.made)
        factors, live, c1 = self.factors, self.live, self.c1

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, held, _ in _opened(batches):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([held.moved(factors, live, c1, step)[0].tobytes()])], names=["block", "w"])

        point = staged(self.state.mapInArrow(move, VECTOR), "point")
        value, gradient = self.f(point)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, held, row in _opened(batches):
                at, d, pg = held.moved(factors, live, c1, step)
                g = _floats(row["new_g"])
                sums = [float(g @ d), float(np.abs(at).sum()), float((at - held.x) @ pg)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at.tobytes()]), pa.array([row["new_g"]]), pa.array([sums])], names=["block", "w", "new_g", "sums"])

        both = self.state.join(gradient.withColumnRenamed("g", "new_g"), "block")
        self.made = staged(both.mapInArrow(measure, f"{VECTOR}, new_g binary, sums array<double>"), "trial")
        dropped(point)
        slope, size, self._gain = _sums(self.made, "sums", 3)
        return value + self.c1 * size, slope

    def gain(self) -> float:
        return self._gain


def minimise_blocks(f: Gradient, start: DataFrame, settings: Settings | None = None, report: Callable[[int, float, DataFrame], None] | None = None) -> tuple[DataFrame, Result]:
    """As optimize.minimise() for a vector in blocks; the table of the minimum, and a Result without its point."""
    s = settings or Settings()
    value, gradient = f(start)
    c1 = s.c1

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _row(row["block"], _floats(row["w"]), _floats(row["g"]), [], [], c1)

    state = staged(start.join(gradient, "block").mapInArrow(begin, STATE), "state")
    sizes = _sums(state, "dots", 2)
    gram, norm = sizes[:1].reshape(1, 1), sizes[1]
    if c1:
        value += c1 * float(_sums(start.mapInArrow(_absolute, "n array<double>"), "n", 1)[0])
    live: list[int] = []  # of the stored pairs, those that tell of the curvature
    history, k, trials = [value], 0, 1

    def result(why: str) -> tuple[DataFrame, Result]:
        return state.select("block", F.col("x").alias("w")), Result(np.zeros(0), value, k, why, trials)

    while True:
        g = gram.shape[0] - 1
        if why := ended(s, k, history, float(np.sqrt(gram[g, g])), float(np.sqrt(norm))):
            return result(why)
        stored = g // 2
        basis = [*live, *(stored + i for i in live), g]
        small = gram[np.ix_(basis, basis)]
        factors = coefficients(small, len(live))
        slope = float(factors @ small[:, -1])
        if not c1 and slope >= 0 or not factors.any():
            live, factors = [], np.array([-1.0])
            slope = -float(gram[g, g])
        curve = _BlockCurve(f, state, factors, live, c1)
        search = backtrack if c1 or s.search != "interpolation" else interpolate
        new = search(curve, value, slope, 1.0 if live else 1.0 / float(np.sqrt(gram[g, g])), s)
        trials += curve.trials
        if new is None:
            return result("no_step")
        kept = live

        def accept(batches: Iterator[pa.RecordBatch], kept: list[int] = kept) -> Iterator[pa.RecordBatch]:
            for block, held, row in _opened(batches):
                at, new_g = _floats(row["w"]), _floats(row["new_g"])
                yield _row(block, at, new_g, [*(held.steps[i] for i in kept), at - held.x], [*(held.turns[i] for i in kept), new_g - held.g], c1)

        older, state = state, staged(state.join(curve.made.drop("sums"), "block").mapInArrow(accept, STATE), "state")
        dropped(older)
        dropped(curve.made)
        many = len(kept) + 1
        sizes = _sums(state, "dots", (2 * many + 1) ** 2 + 1)
        gram, norm = sizes[:-1].reshape(2 * many + 1, -1), sizes[-1]
        live = [*range(many - 1)]
        turn = gram[many - 1, 2 * many - 1]
        if turn > LEAST_TURN * np.sqrt(gram[many - 1, many - 1] * gram[2 * many - 1, 2 * many - 1]):
            live.append(many - 1)
        live = live[-s.memories :]
        value, k = new, k + 1
        history.append(value)
        if report:
            report(k, value, state.select("block", F.col("x").alias("w")))


def _absolute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([[float(np.abs(_floats(row["w"])).sum())]])], names=["n"])
