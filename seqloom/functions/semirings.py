"""Lattice recursions over any semiring, as higher-order functions over one array per sequence.

A ring says what stands before the first item, how a score extends a value, and how values that meet become
one: sums of probabilities (as logs), best scores, or the k best paths. ``states`` are columns of
array<array<double>>, a row of scores per item, one per label; ``trans`` is the matrix of transition scores,
a constant of the plan. All results are null for no items.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import exp
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often it stands there; a plain column may be put in place again."""
    return F.transform(F.array(value), body)[0]


class Ring:
    """Values of a label are columns of one type."""

    def start(self) -> Column:
        raise NotImplementedError

    def times(self, value: Column, score: Column) -> Column:
        """A value with a score along its way."""
        raise NotImplementedError

    def at(self, value: Column, label: int) -> Column:
        """A value that goes through a label; only rings of paths tell it apart."""
        return value

    def plus(self, values: Column) -> Column:
        """What an array of values comes to."""
        raise NotImplementedError

    def onward(self, values: Column, matrix: Matrix) -> Column:
        """For each row of a matrix: what an array's values come to, each with its score of the row along its way."""
        return F.array(*(self.plus(F.array(*(self.times(values[i], F.lit(float(x))) for i, x in enumerate(row)))) for row in matrix))


class LogSum(Ring):
    """Logs of sums of exponentials."""

    def start(self) -> Column:
        return F.lit(0.0)

    def times(self, value: Column, score: Column) -> Column:
        return value + score

    def plus(self, values: Column) -> Column:
        return let(values, lambda held: let(F.array_max(held), lambda top: top + F.ln(F.aggregate(held, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))


#: How far scores of a matrix may lie apart so that their exponentials can be factors: any that are lost beside others then have no weight.
FACTORS = 600.0


class FactorSum(LogSum):
    """As LogSum, a row of sums at once by factors."""

    def onward(self, values: Column, matrix: Matrix) -> Column:
        """An exponential of each value serves all rows, whose own ones are constants."""
        most = max(max(row) for row in matrix)
        if not most - min(min(row) for row in matrix) <= FACTORS:
            return super().onward(values, matrix)
        factors = [[exp(x - most) for x in row] for row in matrix]

        def sums(held: Column, top: Column) -> Column:
            return F.array(*(top + F.ln(reduce(add, (held[i] * F.lit(x) for i, x in enumerate(row)))) for row in factors))

        return let(values, lambda held: let(F.array_max(held), lambda top: let(F.transform(held, lambda x: F.exp(x - top)), lambda parts: sums(parts, top + F.lit(most)))))


class Best(LogSum):
    """The greatest score."""

    def plus(self, values: Column) -> Column:
        return F.array_max(values)


class KBest(Ring):
    """The k best paths: structs of minus the score and the labels, the last one first; ties go to the lower labels, from the last on."""

    def __init__(self, k: int):
        self.k = k

    def start(self) -> Column:
        return F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("path")))

    def times(self, value: Column, score: Column) -> Column:
        return F.transform(value, lambda x: F.struct((x["cost"] - score).alias("cost"), x["path"].alias("path")))

    def at(self, value: Column, label: int) -> Column:
        return F.transform(value, lambda x: F.struct(x["cost"].alias("cost"), F.concat(F.array(F.lit(label)), x["path"]).alias("path")))

    def plus(self, values: Column) -> Column:
        return F.slice(F.array_sort(F.flatten(values)), 1, self.k)


def _rest(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))


def forward(states: Column, trans: Matrix, ring: Ring) -> Column:
    """A row per item: for each label the value of all ways that end in it."""
    labels = range(len(trans))

    def row(into: list[Column], scores: Column) -> Column:
        return F.array(*(ring.at(ring.times(v, scores[j]), j) for j, v in enumerate(into)))

    def step(rows: Column, scores: Column) -> Column:
        into = [[trans[i][j] for i in labels] for j in labels]
        met = let(F.element_at(rows, -1), lambda last: ring.onward(last, into))
        return F.concat(rows, F.array(let(met, lambda values: row([values[j] for j in labels], scores))))

    return F.when(F.size(states) > 0, F.aggregate(_rest(states), F.array(row([ring.start()] * len(trans), states[0])), step))


def total(rows: Column, ring: Ring) -> Column:
    """What all ways through a lattice come to, by the rows of forward()."""
    return ring.plus(F.element_at(rows, -1))


def backward(states: Column, trans: Matrix, ring: Ring) -> Column:
    """A row per item: for each label the value of all ways that go on from it, its own score left out."""
    labels = range(len(trans))
    n = len(trans)

    def step(rows: Column, scores: Column) -> Column:
        first = rows[0]
        scored = F.array(*(ring.times(first[j], scores[j]) for j in labels))
        return F.concat(F.array(let(scored, lambda values: ring.onward(values, trans))), rows)

    return F.when(F.size(states) > 0, F.aggregate(F.slice(F.reverse(states), 1, F.size(states) - 1), F.array(F.array(*([ring.start()] * n))), step))


def node_marginals(ahead: Column, behind: Column) -> Column:
    """(items, labels) of probabilities, by the rows of forward() and backward() over LogSum."""
    return let(total(ahead, LogSum()), lambda whole: F.zip_with(ahead, behind, lambda a, b: F.zip_with(a, b, lambda x, y: F.exp(x + y - whole))))


def edge_marginals(states: Column, trans: Matrix, ahead: Column, behind: Column) -> Column:
    """(items - 1, from, to) of probabilities."""
    labels = range(len(trans))
    rows = F.arrays_zip(F.slice(ahead, 1, F.size(ahead) - 1).alias("a"), _rest(states).alias("s"), _rest(behind).alias("b"))

    def edges(r: Column, whole: Column) -> Column:
        return F.array(*(F.array(*(F.exp(r["a"][i] + F.lit(float(trans[i][j])) + r["s"][j] + r["b"][j] - whole) for j in labels)) for i in labels))

    return let(total(ahead, LogSum()), lambda whole: F.transform(rows, lambda r: edges(r, whole)))


def span_marginal(states: Column, trans: Matrix, ahead: Column, behind: Column, begin: Column, path: Column) -> Column:
    """Probability that the items from ``begin`` on (from 0) have the labels of an array; null where it does not fit."""
    whole, flat = total(ahead, LogSum()), F.array(*(F.lit(float(x)) for row in trans for x in row))
    n = len(trans)
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: flat[path[k - 1] * n + path[k]] + states[begin + k][path[k]])
    inner = F.when(F.size(path) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    last = begin + F.size(path) - 1
    fits = (F.size(path) > 0) & (begin >= 0) & (last < F.size(states)) & F.forall(path, lambda y: (y >= 0) & (y < n))
    return F.when(fits, F.exp(ahead[begin][path[0]] + inner + behind[last][F.element_at(path, -1)] - whole))
