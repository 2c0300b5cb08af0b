"""Quasi-Newton minimisation on the driver: limited-memory BFGS, with L1 by orthants, and its line searches."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class State(Protocol):
    """Where a minimisation keeps what it can be resumed from."""

    def load(self) -> dict | None: ...

    def save(self, held: dict) -> None: ...


#: Cosine of step and turn below which a pair tells nothing of the curvature.
LEAST_TURN = 1e-12
#: Share of a value below which its differences are lost in the rounding of large sums.
ROUNDING = 1e-12
SEARCHES = ("interpolation", "armijo", "wolfe", "strong_wolfe")


@dataclass
class Settings:
    """Stops: gradient below ``epsilon`` times max(1, |x|); relative gain over ``period`` steps below ``delta``."""

    memories: int = 6
    epsilon: float = 1e-5
    period: int = 10
    delta: float = 1e-5
    max_iterations: int = 1 << 31
    c1: float = 0.0
    search: str = "interpolation"
    max_trials: int = 20
    armijo: float = 1e-4
    curvature: float = 0.9
    min_step: float = 1e-20
    max_step: float = 1e20
    least_width: float = 1e-16

    def __post_init__(self):
        bad = [
            ("memories", self.memories < 1), ("epsilon", self.epsilon < 0), ("period", self.period < 0), ("delta", self.delta < 0), ("max_iterations", self.max_iterations < 1),
            ("c1", self.c1 < 0), ("search", self.search not in SEARCHES), ("max_trials", self.max_trials < 1), ("armijo", not 0 < self.armijo < 0.5),
            ("curvature", not self.armijo < self.curvature < 1), ("min_step", self.min_step < 0), ("max_step", self.max_step < self.min_step), ("least_width", self.least_width < 0),
        ]
        if wrong := [name for name, b in bad if b]:
            raise ValueError(f"out of range: {', '.join(wrong)}")
        if self.c1 and self.search not in ("interpolation", "armijo"):
            raise ValueError("with L1, steps are searched by backtracking alone")


@dataclass
class Result:
    x: np.ndarray
    value: float
    iterations: int
    why: str
    evaluations: int = 0


def pseudo_gradient(x: np.ndarray, g: np.ndarray, c: float) -> np.ndarray:
    """The steepest one-sided slope of f + c |x|: at 0 the side that goes down, if one does."""
    right, left = g + c, g - c
    at_zero = np.where(right < 0, right, np.where(left > 0, left, 0.0))
    return np.where(x > 0, right, np.where(x < 0, left, at_zero))


class Curve:
    """The objective along a direction: counts its evaluations and keeps the point and gradient of the last."""

    def __init__(self, f: Objective, x: np.ndarray, d: np.ndarray, project: Callable[[np.ndarray], np.ndarray] | None, c1: float, pg: np.ndarray | None = None):
        self.f, self.x, self.d, self.project, self.c1, self.pg, self.trials = f, x, d, project, c1, pg, 0
        self.at = self.g = x

    def __call__(self, step: float) -> tuple[float, float]:
        """Value and slope along the direction at a step."""
        self.trials += 1
        self.at = self.x + step * self.d
        if self.project:
            self.at = self.project(self.at)
        value, self.g = self.f(self.at)
        return value + self.c1 * float(np.abs(self.at).sum()), float(self.g @ self.d)

    def gain(self) -> float:
        """What the one-sided slopes promise for the last step, after its projection."""
        return float((self.at - self.x) @ self.pg)


def backtrack(curve: Curve, value: float, slope: float, step: float, s: Settings) -> float | None:
    """The value at a step that is found by shrinking and growing; the curve's last evaluation is at it. None if there is none."""
    kind = "armijo" if s.c1 else s.search
    while curve.trials < s.max_trials and s.min_step <= step <= s.max_step:
        new, new_slope = curve(step)
        gain = curve.gain() if s.c1 else step * slope
        if not np.isfinite(new) or new > value + s.armijo * gain:
            step *= 0.5
        elif kind != "armijo" and new_slope < s.curvature * slope:
            step *= 2.1
        elif kind == "strong_wolfe" and new_slope > -s.curvature * slope:
            step *= 0.5
        else:
            return new
    return None


@dataclass
class Trial:
    """A step, and the value and slope there."""

    step: float
    value: float
    slope: float

    def tilted(self, slope: float) -> Trial:
        """The same of the function less a line of that slope through the origin."""
        return Trial(self.step, self.value - self.step * slope, self.slope - slope)


def cubic(a: Trial, b: Trial) -> float:
    """Where the cubic through both values and slopes has its minimum; NaN if it has none."""
    wide = b.step - a.step
    d = a.slope + b.slope - 3 * (a.value - b.value) / (a.step - b.step)
    square = d * d - a.slope * b.slope
    if square < 0:
        return np.nan
    root = np.copysign(np.sqrt(square), wide)
    below = b.slope - a.slope + 2 * root
    return b.step - wide * (b.slope + root - d) / below if below else np.nan


def parabola(a: Trial, b: Trial) -> float:
    """Where the parabola through both values with the slope at ``a`` has its extreme."""
    wide = b.step - a.step
    return a.step - 0.5 * a.slope * wide * wide / (b.value - a.value - a.slope * wide)


def secant(a: Trial, b: Trial) -> float:
    """Where the slope, taken as a line, is 0."""
    return a.step + (b.step - a.step) * a.slope / (a.slope - b.slope)


def gained(value: float, slope: float, step: float, new: float, new_slope: float) -> float:
    """By how much a step changes the value: where rounding hides that, what a parabola of the slopes at both ends says."""
    lost, half = ROUNDING * abs(value), step * (slope + new_slope) / 2
    return half if abs(new - value) <= lost and abs(half) <= lost else new - value


#: Share of the way to the far end that a step within a bracket may go, and to which two rounds must shrink the bracket.
CAP = 0.66


def next_step(best: Trial, other: Trial, at: Trial, bracketed: bool, low: float, high: float) -> tuple[float, bool]:
    """The step to try after ``at``, and whether a minimum now is bracketed; one of four cases (More and Thuente 1994).

    1: the value has grown: a minimum lies between, nearer to the best step for a cubic than for a parabola or else half-way
    between both. 2: the slope has changed its sign: the cubic's or the secant's minimum, whichever is farther from ``at``.
    3: the slope has the same sign and is less steep: the cubic counts only if it bends up beyond ``at``; in a bracket the nearer
    of both and not more than CAP of the way, else the farther. 4: it is no less steep: on to the bound, or the cubic to the far end.
    """
    if at.value > best.value:
        c, q = cubic(best, at), parabola(best, at)
        return (c if abs(c - best.step) < abs(q - best.step) else (c + q) / 2) if np.isfinite(c) else q, True
    if at.slope * best.slope < 0:
        c, q = cubic(best, at), secant(best, at)
        return c if abs(c - at.step) > abs(q - at.step) else q, True
    bound = high if at.step > best.step else low
    if abs(at.slope) < abs(best.slope):
        c, q = cubic(best, at), secant(best, at)
        if not np.isfinite(c) or (c - at.step) * (at.step - best.step) <= 0:
            c = bound
        nearer = abs(c - at.step) < abs(q - at.step)
        step = c if nearer == bracketed else q
        if bracketed:
            cap = at.step + CAP * (other.step - at.step)
            return (min(cap, step) if at.step > best.step else max(cap, step)), True
        return min(max(step, low), high), False
    if bracketed:
        c = cubic(at, other)
        return c if np.isfinite(c) else (at.step + other.step) / 2, True
    return bound, False


def interpolate(curve: Curve, value: float, slope: float, step: float, s: Settings) -> float | None:
    """The value at a step of sufficient decrease and small slope, as backtrack().

    In the first stage, until a step decreases the value enough and the slope there is nearly up, steps whose
    value is below the best but not enough so are judged by the function less its line of sufficient decrease.
    A bracket that two rounds have not shrunk to CAP is halved. Values are held as gained() over the first.
    """
    line = s.armijo * slope
    best = other = Trial(0.0, 0.0, slope)
    bracketed, first_stage = False, True
    widths = [2 * (s.max_step - s.min_step), s.max_step - s.min_step]
    while curve.trials < s.max_trials:
        low, high = sorted((best.step, other.step)) if bracketed else (best.step, step + 4 * (step - best.step))
        step = min(max(step, s.min_step), s.max_step)
        if bracketed and (not low < step < high or high - low <= s.least_width * high):
            return None  # nothing is left between
        new, new_slope = curve(step)
        if not np.isfinite(new):
            step = best.step + 0.5 * (step - best.step)
            continue
        at = Trial(step, gained(value, slope, step, new, new_slope), new_slope)
        enough = at.value <= step * line
        if enough and abs(at.slope) <= -s.curvature * slope:
            return new
        if step >= s.max_step and enough and at.slope <= line or step <= s.min_step and (not enough or at.slope >= line):
            return None
        if first_stage and enough and at.slope >= min(s.armijo, s.curvature) * slope:
            first_stage = False
        if first_stage and not enough and at.value <= best.value:
            step, bracketed = next_step(best.tilted(line), other.tilted(line), at.tilted(line), bracketed, low, high)
            grown = at.tilted(line).value > best.tilted(line).value
            turned = at.tilted(line).slope * best.tilted(line).slope < 0
        else:
            step, bracketed = next_step(best, other, at, bracketed, low, high)
            grown, turned = at.value > best.value, at.slope * best.slope < 0
        if grown:
            other = at
        else:
            best, other = at, best if turned else other
        if bracketed:
            wide = abs(other.step - best.step)
            if wide >= CAP * widths[0]:
                step = best.step + 0.5 * (other.step - best.step)
            widths = [widths[1], wide]
    return None


def _direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray | None = None) -> np.ndarray:
    """Minus the inverse-curvature estimate times the gradient, by the two loops over the stored pairs. ``first`` is the estimate without pairs."""
    q = -g
    kept = []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        q = q - a * y
        kept.append(a)
    if first is not None:
        q = first @ q
    elif pairs:
        s, y = pairs[-1]
        q = q * ((s @ y) / (y @ y))
    for (s, y), a in zip(pairs, reversed(kept)):
        q = q + (a - (y @ q) / (y @ s)) * s
    return q


def coefficients(gram: np.ndarray, pairs: int) -> np.ndarray:
    """What _direction() is made of, from dot products alone: factors of the steps, the turns (oldest first) and the gradient."""
    g = 2 * pairs
    out = np.zeros(g + 1)
    out[g] = -1.0
    kept = {}
    for i in reversed(range(pairs)):
        kept[i] = out @ gram[:, i] / gram[i, pairs + i]
        out[pairs + i] -= kept[i]
    if pairs:
        out *= gram[pairs - 1, g - 1] / gram[g - 1, g - 1]
    for i in range(pairs):
        out[i] += kept[i] - out @ gram[:, pairs + i] / gram[i, pairs + i]
    return out


def ended(s: Settings, k: int, history: list[float], slope_norm: float, x_norm: float) -> str | None:
    """Why the steps end before the next is searched, if they do."""
    if slope_norm <= s.epsilon * max(1.0, x_norm):
        return "converged"
    if s.period and len(history) > s.period and history[-1] and abs(history[-1 - s.period] - history[-1]) / abs(history[-1]) < s.delta:
        return "stopped"
    return "max_iterations" if k >= s.max_iterations else None


def minimise(f: Objective, x: np.ndarray, settings: Settings | None = None, report: Callable[[int, float, np.ndarray], None] | None = None, state: State | None = None, curvature: Callable[[np.ndarray], np.ndarray | None] | None = None) -> Result:
    """Minimise f(x) + c1 |x|; ``report`` is told every step; ``state`` is written every ten steps and resumed from.

    ``curvature`` estimates the matrix of second derivatives where the steps begin, if it can; without L1 only.
    A state of another length or other settings is not resumed. When no step can be found, the point before
    is the result.
    """
    s = settings or Settings()
    x = np.array(x, np.float64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    history: list[float] = []
    k = 0
    written = json.dumps(asdict(s))
    held = state.load() if state else None
    if held and held["x"].shape == x.shape and held["settings"] == written:
        x, k, history, pairs = held["x"], held["k"], held["history"], [*zip(held["s"], held["y"])]
    value, g = f(x)
    trials = 1
    value += s.c1 * float(np.abs(x).sum())
    history = history or [value]
    estimate = curvature(x) if curvature and not s.c1 else None
    inverse = None if estimate is None else np.linalg.inv(estimate)
    while True:
        pg = pseudo_gradient(x, g, s.c1) if s.c1 else g
        if why := ended(s, k, history, float(np.linalg.norm(pg)), float(np.linalg.norm(x))):
            return Result(x, value, k, why, trials)
        d = _direction(pg, pairs, inverse)
        if s.c1:
            d[d * pg > 0] = 0  # against the slope, keep out
        if d @ pg >= 0:
            pairs, inverse, d = [], None, -pg
        first = 1.0 if pairs or inverse is not None else 1.0 / np.linalg.norm(d)
        project = None
        if s.c1:
            orthant = np.where(x != 0, np.sign(x), -np.sign(pg))

            def project(at: np.ndarray, orthant=orthant) -> np.ndarray:
                return np.where(at * orthant > 0, at, 0.0)

        curve = Curve(f, x, d, project, s.c1, pg)
        search = backtrack if s.c1 or s.search != "interpolation" else interpolate
        new = search(curve, value, float(d @ pg), first, s)
        trials += curve.trials
        if new is None:
            return Result(x, value, k, "no_step", trials)
        step, turn = curve.at - x, curve.g - g
        if turn @ step > LEAST_TURN * np.linalg.norm(step) * np.linalg.norm(turn):
            pairs = [*pairs, (step, turn)][-s.memories :]
        x, value, g, k = curve.at, new, curve.g, k + 1
        history.append(value)
        if report:
            report(k, value, x)
        if state and k % 10 == 1:
            state.save({"x": x, "k": k, "history": history, "s": [p for p, _ in pairs], "y": [p for _, p in pairs], "settings": written})
