"""Minimisation where rounding hides what a step gains, and with an estimate of the curvature at the start."""

import numpy as np
import pytest

from seqloom.operators.chain import stacked_sums
from seqloom.operators.crf import curvature, stacked_objective
from seqloom.operators.crf_layout import Layout, gradients, items_of, likelihood, pack, sequences_of, stacked, stacks_of
from seqloom.operators.optimize import Settings, minimise

STEEP = np.geomspace(1, 1e4, 12)


def high(x):
    """A bowl so high up that its last digits are lost, as those of a sum of many terms are."""
    d = x - np.arange(12) / 12
    return float(1e8 * (1 + 1e-15 * np.sin(1e9 * x.sum())) + (STEEP * (d * d / 2 + d**4)).sum()), STEEP * (d + 4 * d**3)


def test_the_gradient_gets_small_where_values_no_longer_tell():
    found = minimise(high, np.zeros(12), Settings(period=0))
    assert found.why == "converged" and np.linalg.norm(high(found.x)[1]) <= 1e-5 * np.linalg.norm(found.x)


def test_an_estimate_of_the_curvature_saves_steps():
    plain, with_it = minimise(high, np.zeros(12), Settings(period=0)), minimise(high, np.zeros(12), Settings(period=0), curvature=lambda x: np.diag(STEEP))
    assert with_it.why == "converged" and with_it.iterations < plain.iterations and with_it.x == pytest.approx(plain.x, abs=1e-4)


def test_edges_apart_sum_to_those_together():
    r = np.random.default_rng(1)
    sizes, trans = np.array([3, 1, 7, 4]), r.normal(size=(3, 3))
    state = r.normal(size=(15, 3))
    (norm, nodes, edges), (norm2, nodes2, each) = stacked_sums(state, trans, sizes), stacked_sums(state, trans, sizes, apart=True)
    assert (norm == norm2).all() and (nodes == nodes2).all() and each.shape == (4, 3, 3) and each.sum(0) == pytest.approx(edges)
    assert each[2] == pytest.approx(stacked_sums(state[4:11], trans, sizes[2:3])[2]) and not each[1].any()


def test_curvature_is_how_sequences_gradients_vary(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(f"s{s}", p, "ab"[r.integers(2)], [(f"x{r.integers(3)}", 1.0), (f"y{r.integers(2)}", 0.5)][: r.integers(3)]) for s in range(90) for p in range(1 + s % 5)]
    held = sequences_of(spark.createDataFrame(rows, "seq string, pos long, label string, feats array<struct<attr:string,value:double>>"))
    attrs = spark.createDataFrame([(n, k) for k, n in enumerate(("x0", "x1", "x2", "y0", "y1"))], "attr string, aid long")
    layout = Layout([*((2 * a + y, 0, a, y) for a in range(5) for y in range(2)), (10, 1, 0, 1), (11, 1, 1, 1)], 5, 2)  # some pairs have no feature
    packed = pack(held, attrs, ["a", "b"])
    stacks, w = stacked(packed, 2), r.normal(size=12)
    each = []
    for item in items_of(packed.toPandas().sort_values("seq")):
        out = np.zeros(13)
        likelihood(layout, np.append(w, 0.0), item, out)
        each.append(out[:-1])
    centred = np.array(each) - np.mean(each, 0)
    assert curvature(stacks, layout, 0.5)(w) == pytest.approx(centred.T @ centred + np.eye(12))
    assert curvature(stacks.limit(0), layout, 0.5)(w) is None
    monkeypatch.setattr("seqloom.operators.crf_layout.GRADIENTS", 40)
    some = [rows for item in stacks_of(stacks.toArrow().to_batches()) for rows in gradients(layout, np.append(w, 0.0), item)]
    assert len(some) > 20 and np.sort(np.concatenate(some), 0) == pytest.approx(np.sort(each, 0))
    plain, quick = (minimise(stacked_objective(stacks, layout, 0.5), np.zeros(12), Settings(period=0), curvature=c) for c in (None, curvature(stacks, layout, 0.5)))
    assert plain.why == quick.why == "converged" and quick.x == pytest.approx(plain.x, abs=1e-4) and quick.iterations <= plain.iterations
