"""Lattice recursions as higher-order functions over one array per sequence.

``states`` are columns of array<array<double>>: a row of scores per item, one per label. ``trans`` is the
matrix of transition scores, a constant of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]


def _literal(row: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in row))


def _rest(states: Column) -> Column:
    return F.slice(states, 2, F.greatest(F.size(states), F.lit(1)))


def viterbi(states: Column, trans: Matrix) -> Column:
    """Struct of the best path's score and its labels (from 0); ties go to the lower label. Null for no items."""
    labels = range(len(trans))
    into = [_literal([trans[i][j] for i in labels]) for j in labels]

    def step(acc: Column, row: Column) -> Column:
        def reach(j: int) -> Column:
            return F.zip_with(acc["s"], into[j], lambda a, b: a + b)

        scores = F.array(*(F.array_max(reach(j)) + row[j] for j in labels))
        paths = F.array(*(F.concat(F.element_at(acc["p"], F.array_position(reach(j), F.array_max(reach(j))).cast("int")), F.lit(f",{j}")) for j in labels))
        return F.struct(scores.alias("s"), paths.alias("p"))

    start = F.struct(states[0].alias("s"), F.array(*(F.lit(str(j)) for j in labels)).alias("p"))

    def finish(acc: Column) -> Column:
        return F.struct(F.array_max(acc["s"]).alias("score"), F.element_at(acc["p"], F.array_position(acc["s"], F.array_max(acc["s"])).cast("int")).alias("path"))

    return F.when(F.size(states) > 0, F.aggregate(_rest(states), start, step, finish))


def log_norm(states: Column, trans: Matrix) -> Column:
    """Log of the partition factor, by the forward recursion with rows scaled to a sum of 1. Null for no items."""
    from math import exp

    labels = range(len(trans))
    into = [_literal([exp(trans[i][j]) for i in labels]) for j in labels]

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def scaled(row: Column, log_z: Column) -> Column:
        return F.struct(F.transform(row, lambda x: x / total(row)).alias("a"), (log_z + F.ln(total(row))).alias("z"))

    def step(acc: Column, row: Column) -> Column:
        return scaled(F.array(*(total(F.zip_with(acc["a"], into[j], lambda a, b: a * b)) * F.exp(row[j]) for j in labels)), acc["z"])

    start = scaled(F.transform(states[0], F.exp), F.lit(0.0))
    return F.when(F.size(states) > 0, F.aggregate(_rest(states), start, step, lambda acc: acc["z"]))
