"""A step's best path and difference of features against plain forms, in the form for few features and in that for many."""

from itertools import product

import numpy as np
import pytest

from seqloom.operators import crf
from seqloom.operators.chain import best_path
from seqloom.operators.crf_layout import Layout

LAYOUT = Layout([*((3 * a + y, 0, a, y) for a in range(4) for y in range(3)), (12, 1, 0, 1), (13, 1, 1, 2), (14, 1, 2, 2)], 4, 3)


def sequence(r, n):
    sizes = r.integers(3, size=n)
    many = int(sizes.sum())
    return {"y": r.integers(3, size=n), "sizes": sizes, "at": np.repeat(np.arange(n), sizes), "aids": r.integers(4, size=many), "values": r.normal(size=many)}


def seen(item, path):
    out = np.zeros(16)
    LAYOUT.add_path(out, item, path, 1.0)
    return out[:-1]


@pytest.mark.parametrize("small", [1 << 13, 0])
def test_difference_of_two_paths(small, monkeypatch):
    monkeypatch.setattr(crf, "SMALL", small)
    r = np.random.default_rng(4)
    for n in (1, 1, 2, 5, 9) * 10:
        item = sequence(r, n)
        path = r.integers(3, size=n)
        ids, delta = crf._delta(LAYOUT, item, path)
        out = np.zeros(15)
        out[ids] = delta
        assert (np.diff(ids) > 0).all() and delta.all() and out == pytest.approx(seen(item, item["y"]) - seen(item, path), abs=1e-12)


def test_best_path_is_that_of_trying_all_and_of_ties_the_lowest_from_the_end():
    r = np.random.default_rng(5)
    for n, labels in (1, 1), (1, 4), (4, 1), (5, 3), (6, 2), (4, 4):
        for _ in range(20):
            state, trans = r.integers(-2, 3, size=(n, labels)) / 2, r.integers(-2, 3, size=(labels, labels)) / 2
            ways = {p: sum(state[t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in product(range(labels), repeat=n)}
            path, top = best_path(state, trans)
            assert top == max(ways.values()) and tuple(path) == min((p for p, s in ways.items() if s == top), key=lambda p: p[::-1])


@pytest.mark.parametrize("algorithm", ["ap", "pa", "arow"])
def test_steps_are_alike_with_few_and_with_many_features(algorithm, monkeypatch):
    found = []
    for small in (1 << 13, 0):
        monkeypatch.setattr(crf, "SMALL", small)
        r = np.random.default_rng(6)
        state = {"w": np.zeros(16), "c": np.ones(1), "sum": np.zeros(16), "var": np.ones(16)}
        for n in (1, 3, 7, 2, 12):
            crf.STEPS[algorithm](LAYOUT, state, sequence(r, n), {"kind": 1, "c": 1.0, "error_sensitive": True, "gamma": 1.0})
        assert state["w"].any() and not state["w"][-1]
        found.append(np.concatenate([*state.values()]))
    assert found[0] == pytest.approx(found[1])
