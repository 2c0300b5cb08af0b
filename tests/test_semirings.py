"""Lattice recursions in expressions against all paths."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import lattice, semirings
from seqloom.operators.chain import Chain

TRANS = [[0.3, -1.0, 2.0], [0.0, 0.5, -0.7], [1.1, 0.2, 0.0]]


@pytest.fixture(scope="module")
def lattices(spark):
    rng = np.random.default_rng(6)
    held = [(k, rng.normal(0, 2, (n, 3)).tolist()) for k, n in enumerate((1, 2, 3, 5))] + [(8, np.zeros((4, 3)).tolist()), (9, [])]
    return {k: np.array(s) for k, s in held}, spark.createDataFrame(held, "seq int, states array<array<double>>")


def test_sums_and_marginals(lattices):
    held, df = lattices
    ring, s = semirings.LogSum(), F.col("states")
    rows = df.withColumns({"ahead": semirings.forward(s, TRANS, ring), "behind": semirings.backward(s, TRANS, ring)})
    a, b = F.col("ahead"), F.col("behind")
    spans = [(0, [1]), (1, [2, 0]), (0, [0, 1, 2]), (2, [1, 1, 1]), (-1, [0]), (0, []), (0, [3])]
    found = [semirings.span_marginal(s, TRANS, a, b, F.lit(at), F.array(*map(F.lit, path)).cast("array<int>")).alias(f"s{k}") for k, (at, path) in enumerate(spans)]
    for r in rows.select("seq", semirings.total(a, ring).alias("z"), semirings.node_marginals(a, b).alias("nodes"), semirings.edge_marginals(s, TRANS, a, b).alias("edges"), *found).collect():
        if r["seq"] == 9:
            assert r["z"] is None and r["nodes"] is None and all(r[f"s{k}"] is None for k in range(len(spans)))
            continue
        chain = Chain(held[r["seq"]], np.array(TRANS))
        n = len(held[r["seq"]])
        assert r["z"] == pytest.approx(chain.log_norm)
        assert np.array(r["nodes"]) == pytest.approx(chain.node_marginals())
        assert np.array(r["edges"]).reshape(-1, 3, 3) == pytest.approx(chain.edge_marginals())
        for k, (at, path) in enumerate(spans):
            want = sum(np.exp(chain.log_probability(np.array(p))) for p in itertools.product(range(3), repeat=n) if list(p[at : at + len(path)]) == path) if path and at >= 0 and at + len(path) <= n and 3 not in path else None
            assert r[f"s{k}"] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("k", [1, 4, 100])
def test_best_paths(lattices, k):
    held, df = lattices
    ring, s = semirings.KBest(k), F.col("states")
    best = semirings.total(semirings.forward(s, TRANS, semirings.Best()), semirings.Best())
    for r in df.select("seq", semirings.total(semirings.forward(s, TRANS, ring), ring).alias("b"), best.alias("one"), lattice.viterbi(s, TRANS).alias("v")).collect():
        if r["seq"] == 9:
            assert r["b"] is None and r["one"] is None
            continue
        chain = Chain(held[r["seq"]], np.array(TRANS))
        every = sorted((-chain.score(np.array(p)), p[::-1]) for p in itertools.product(range(3), repeat=len(held[r["seq"]])))[:k]
        assert [x["cost"] for x in r["b"]] == pytest.approx([c for c, _ in every])
        assert r["one"] == pytest.approx(-every[0][0]) and ",".join(map(str, r["b"][0]["path"][::-1])) == r["v"]["path"]
        assert len({tuple(x["path"]) for x in r["b"]}) == len(every)


def test_sums_of_all_ways_stand_once_in_an_expression(lattices):
    """The sum over a lattice is bound once, not worked out for each pair of labels; a sum finds its greatest term once."""
    s, a, b = map(F.col, ("states", "ahead", "behind"))
    for found, sums in ((semirings.edge_marginals(s, TRANS, a, b), 1), (semirings.node_marginals(a, b), 1), (semirings.forward(s, TRANS, semirings.LogSum()), 3)):
        assert str(found).count("array_max") == sums
