"""Line searches case by case, and minimisation on the driver and over tables of blocks."""

import numpy as np
import pytest

from seqloom.operators.blockvectors import _State, minimise_blocks, zeros
from seqloom.operators.optimize import SEARCHES, Curve, Settings, Trial, coefficients, cubic, interpolate, minimise, next_step, parabola, pseudo_gradient, secant
from seqloom.sources.staging import ArrayState


def rosenbrock(x):
    a, b = x[::2], x[1::2]
    g = np.empty_like(x)
    g[1::2] = 200 * (b - a * a)
    g[::2] = -2 * (1 - a) - 2 * a * g[1::2]
    return float(((1 - a) ** 2 + 100 * (b - a * a) ** 2).sum()), g


VALLEY = np.tile([-1.2, 1.0], 50)


@pytest.mark.parametrize("search,most", [("interpolation", 60), ("armijo", 80), ("wolfe", 80), ("strong_wolfe", 80)])
def test_valley_of_a_hundred_dimensions(search, most):
    assert search in SEARCHES
    found = minimise(rosenbrock, VALLEY, Settings(search=search, max_trials=40, period=0))
    assert found.why == "converged" and np.abs(found.x - 1).max() < 1e-4
    assert found.iterations <= found.evaluations <= most
    assert np.linalg.norm(rosenbrock(found.x)[1]) <= 1e-5 * np.linalg.norm(found.x)


def test_stops():
    assert minimise(rosenbrock, np.ones(4)).iterations == 0
    assert minimise(rosenbrock, VALLEY, Settings(max_iterations=3)).why == "max_iterations"
    assert minimise(rosenbrock, VALLEY, Settings(period=2, delta=0.5)).why == "stopped"
    assert minimise(lambda x: (float(-x.sum()), -np.ones(3)), np.zeros(3), Settings(max_step=100.0)).why == "no_step"


def of(f, slope):
    return lambda t: Trial(t, f(t), slope(t))


def test_minima_of_curves():
    third = of(lambda t: (t - 2) ** 3 - 3 * (t - 2), lambda t: 3 * (t - 2) ** 2 - 3)  # least at 3
    assert cubic(third(1.5), third(2.5)) == pytest.approx(3) == pytest.approx(cubic(third(4.0), third(2.2)))
    square = of(lambda t: (t - 2) ** 2, lambda t: 2 * (t - 2))
    assert parabola(square(0.0), square(5.0)) == pytest.approx(2) == pytest.approx(secant(square(0.0), square(5.0)))
    assert np.isnan(cubic(Trial(0, 0.0, -1.0), Trial(1, -0.9, -1.0)))


def test_case_one_the_value_has_grown():
    best, at = Trial(0.0, 0.0, -1.0), Trial(2.0, 1.0, 3.0)
    step, bracketed = next_step(best, best, at, False, 0.0, 10.0)
    c, q = cubic(best, at), parabola(best, at)
    assert bracketed and 0 < step < 2
    assert step == (c if abs(c) < abs(q) else (c + q) / 2)
    steep = Trial(2.0, 40.0, 41.0)  # the parabola is nearer, so half-way between both
    c, q = cubic(best, steep), parabola(best, steep)
    assert abs(q) < abs(c) and next_step(best, best, steep, False, 0.0, 10.0)[0] == pytest.approx((c + q) / 2)


def test_case_two_the_slope_has_turned():
    best, at = Trial(0.0, 0.0, -4.0), Trial(2.0, -3.0, 1.0)
    step, bracketed = next_step(best, best, at, False, 0.0, 10.0)
    c, q = cubic(best, at), secant(best, at)
    assert bracketed and step == (c if abs(c - 2) > abs(q - 2) else q) and 0 < step < 2


def test_case_three_the_slope_is_less_steep():
    best, at = Trial(0.0, 0.0, -4.0), Trial(1.0, -3.0, -2.0)
    c, q = cubic(best, at), secant(best, at)
    step, bracketed = next_step(best, best, at, False, 0.0, 5.0)
    assert not bracketed and step == pytest.approx(min(5.0, c if c > at.step and abs(c - 1) > abs(q - 1) else max(q, 5.0 if not c > at.step else q)))
    inside, still = next_step(best, Trial(1.5, 0.0, 2.0), at, True, 0.0, 1.5)
    assert still and inside <= 1.0 + 0.66 * 0.5
    down = Trial(1.0, -3.9, -0.1)  # the cubic goes down for ever: the bound stands in for it
    assert next_step(best, best, down, False, 0.0, 5.0)[0] <= 5.0


def test_case_four_the_slope_is_no_less_steep():
    best, at = Trial(0.0, 0.0, -1.0), Trial(1.0, -3.0, -5.0)
    assert next_step(best, best, at, False, 0.0, 5.0) == (5.0, False)
    assert next_step(Trial(3.0, 0.0, 1.0), best, Trial(2.0, -3.0, 5.0), False, 0.0, 5.0) == (0.0, False)
    other = Trial(2.0, 1.0, 9.0)
    assert next_step(best, other, at, True, 0.0, 2.0) == (cubic(at, other), True)


@pytest.mark.parametrize("first", [1e-3, 0.1, 1.0, 10.0, 1e3])
@pytest.mark.parametrize("name", ["rational", "power", "waves"])
def test_search_from_any_first_step(name, first):
    """Functions on which searches are commonly tried, with the strict conditions."""
    f = {
        "rational": (lambda t: -t / (t * t + 2), lambda t: (t * t - 2) / (t * t + 2) ** 2),
        "power": (lambda t: (t + 0.004) ** 5 - 2 * (t + 0.004) ** 4, lambda t: 5 * (t + 0.004) ** 4 - 8 * (t + 0.004) ** 3),
        "waves": (lambda t: (t - 1.6) ** 2 + 0.03 * np.sin(20 * t), lambda t: 2 * (t - 1.6) + 0.6 * np.cos(20 * t)),
    }[name]
    s = Settings(armijo=0.001, curvature=0.1, max_trials=40)
    curve = Curve(lambda x: (float(f[0](x[0])), np.array([f[1](x[0])])), np.zeros(1), np.ones(1), None, 0.0)
    start, slope = f[0](0.0), f[1](0.0)
    value = interpolate(curve, start, slope, first, s)
    assert value == f[0](curve.at[0]) <= start + 0.001 * curve.at[0] * slope
    assert abs(curve.g[0]) <= -0.1 * slope and curve.trials <= 16


def test_coefficients_are_the_two_loops():
    from seqloom.operators.optimize import _direction

    r = np.random.default_rng(1)
    for n in (0, 1, 4):
        basis = r.normal(size=(2 * n + 1, 30))
        for k in range(n):
            basis[n + k] += 2 * basis[k]
        d = coefficients(basis @ basis.T, n) @ basis
        assert d == pytest.approx(_direction(basis[-1], [(basis[k], basis[n + k]) for k in range(n)]), rel=1e-9)


def soft(x, b=np.array([3.0, -0.5, 0.2, -4.0])):
    return float(((x - b) ** 2).sum() / 2), x - b


def test_l1_is_a_soft_threshold():
    assert minimise(soft, np.zeros(4), Settings(c1=1.0, period=0)).x == pytest.approx([2, 0, 0, -3])
    assert pseudo_gradient(np.array([0.0, 0.0, 1.0]), np.array([0.5, -2.0, 0.0]), 1.0).tolist() == [0, -1, 1]


def test_settings_are_checked():
    with pytest.raises(ValueError, match="memories"):
        Settings(memories=0)
    with pytest.raises(ValueError):
        Settings(c1=1.0, search="wolfe")


def test_states_are_kept_and_replaced(spark, tmp_path):
    state = ArrayState(spark, str(tmp_path / "s"))
    assert state.load() is None
    for k in range(3):
        state.save({"x": np.arange(k + 2.0), "k": k, "history": [1.0, float(k)], "s": [np.ones(2)] * k, "settings": "{}"})
    held = state.load()
    assert held["x"].tolist() == [0, 1, 2, 3] and held["k"] == 2 and held["history"] == [1.0, 2.0] and len(held["s"]) == 2 and held["settings"] == "{}"
    assert len(list((tmp_path / "s").iterdir())) == 1


def blocked(f):
    """A function of arrays as one of tables; all of its blocks meet, which only a test may do."""

    def evaluate(vector):
        rows = sorted((r["block"], bytes(r["w"])) for r in vector.collect())
        x = np.concatenate([np.frombuffer(w) for _, w in rows])
        value, g = f(x)
        ends = np.cumsum([len(w) // 8 for _, w in rows])
        parts = np.split(g, ends[:-1])
        return value, vector.sparkSession.createDataFrame([(b, bytearray(p.tobytes())) for (b, _), p in zip(rows, parts)], "block long, g binary")

    return evaluate


@pytest.mark.parametrize("f,n,settings", [(rosenbrock, 10, {"max_iterations": 12}), (rosenbrock, 10, {"max_iterations": 8, "search": "wolfe", "memories": 2}), (soft, 4, {"c1": 1.0, "period": 0})])
def test_blocks_go_the_way_of_arrays(spark, f, n, settings):
    s = Settings(**settings)
    want = minimise(f, np.zeros(n), s)
    vector, got = minimise_blocks(blocked(f), zeros(spark, n, 3), s)
    rows = sorted((r["block"], bytes(r["w"])) for r in vector.collect())
    assert [len(w) // 8 for _, w in rows] == [3] * (n // 3) + [n % 3]
    assert np.concatenate([np.frombuffer(w) for _, w in rows]) == pytest.approx(want.x, abs=1e-9)
    assert (got.why, got.iterations, got.evaluations) == (want.why, want.iterations, want.evaluations) and got.value == pytest.approx(want.value, abs=1e-9)


def test_a_block_is_its_part_of_the_vectors():
    r = np.random.default_rng(2)
    x, g, *pairs = r.normal(size=(6, 5))
    held = _State(x.tobytes(), g.tobytes(), [p.tobytes() for p in pairs[:2]], [p.tobytes() for p in pairs[2:]])
    basis = np.stack([*pairs, g])
    assert held.dots(0.0) == pytest.approx(np.append((basis @ basis.T).ravel(), x @ x))
    assert held.direction(np.array([1.0, 2.0, -1.0]), [1], 0.0) == pytest.approx(pairs[1] + 2 * pairs[3] - g)
