"""Sums over lattices whose scores lie near or too far apart for factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions.semirings import FactorSum, LogSum, backward, forward, node_marginals


@pytest.mark.parametrize("far", [1.0, 50.0, 400.0])
def test_all_rows_at_once_are_as_one_by_one(spark, far):
    r = np.random.default_rng(7)
    trans = (far * r.normal(size=(3, 3))).tolist()
    rows = [(k, (far * r.normal(size=(n, 3))).tolist()) for k, n in enumerate((1, 2, 6))]
    states = F.col("states")

    def both(ring):
        return F.struct(forward(states, trans, ring).alias("a"), backward(states, trans, ring).alias("b"))

    held = spark.createDataFrame(rows, "k long, states array<array<double>>").select("k", both(FactorSum()).alias("x"), both(LogSum()).alias("y"))
    for row in held.select("*", node_marginals(F.col("x.a"), F.col("x.b")).alias("p")).collect():
        for c in "ab":
            assert np.array(row["x"][c]) == pytest.approx(np.array(row["y"][c]), rel=1e-12, abs=1e-9)
        assert np.array(row["p"]).sum(1) == pytest.approx(1)


def test_an_exponential_of_a_value_serves_all_labels():
    found = str(forward(F.col("states"), [[0.0, 1.0], [2.0, 0.0]], FactorSum()))
    assert found.count("EXP") + found.count("exp(") == found.count("array_max") == 1
