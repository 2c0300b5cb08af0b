"""Arithmetic of linear chains on numpy: forward, backward, best paths, marginals of one sequence.

``state`` is a matrix (items, labels) of log scores, ``trans`` one (from, to). Rows of the forward
recursion are scaled to a sum of 1, and the scales carry the partition factor.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import isqrt, log

import numpy as np


class Chain:
    def __init__(self, state: np.ndarray, trans: np.ndarray):
        self.state, self.trans = np.asarray(state, np.float64), np.asarray(trans, np.float64)
        top = self.state.max(1, keepdims=True)
        shift = self.trans.max()
        self.e, self.m = np.exp(self.state - top), np.exp(self.trans - shift)
        n, labels = self.state.shape
        self.alpha, self.beta, self.scale = np.empty((n, labels)), np.empty((n, labels)), np.empty(n)
        add, dot, times, alpha, beta, scale, e, m = np.add.reduce, np.dot, np.multiply, [*self.alpha], [*self.beta], self.scale, [*self.e], self.m
        row = np.empty(labels)
        for t in range(n):
            if t:
                times(dot(alpha[t - 1], m, row), e[t], row)
            else:
                row[:] = e[0]
            total = add(row)
            scale[t] = 1 / total if total else 1.0
            times(row, scale[t], alpha[t])
        row[:] = 1.0
        for t in range(n - 1, -1, -1):
            if t < n - 1:
                row = dot(m, times(beta[t + 1], e[t + 1], row))
            times(row, scale[t], beta[t])
        self.log_norm = float(top.sum() + (n - 1) * shift - np.log(self.scale).sum())

    def score(self, path: np.ndarray) -> float:
        path = np.asarray(path)
        return float(self.state[np.arange(len(path)), path].sum() + self.trans[path[:-1], path[1:]].sum())

    def log_probability(self, path: np.ndarray) -> float:
        return self.score(path) - self.log_norm

    def node_marginals(self) -> np.ndarray:
        return self.alpha * self.beta / self.scale[:, None]

    def edge_marginals(self) -> np.ndarray:
        """(items - 1, from, to)."""
        return self.alpha[:-1, :, None] * self.m[None] * (self.e[1:] * self.beta[1:])[:, None, :]

    def path_marginal(self, path: np.ndarray, begin: int) -> float:
        """Probability that the labels from item ``begin`` on are those of ``path``."""
        end = begin + len(path)
        p = self.alpha[begin, path[0]] * self.beta[end - 1, path[-1]] / self.scale[begin]
        for k in range(1, len(path)):
            t = begin + k
            p *= self.m[path[k - 1], path[k]] * self.e[t, path[k]] * (self.scale[t - 1] if k > 1 else self.scale[begin])
        return float(p)


#: Labels up to which best_path() goes step by step without arrays: a call of numpy costs more than all sums of so few.
FEW = 10
#: Logarithm of the greatest quotient of numbers that are worked on without being scaled.
SAFE = 700.0


def chain_sums(state: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log norm, node marginals and the sum of edge marginals of one sequence.

    With few labels it is worked on in pieces. Scores that lie too far apart for that are left to Chain.
    """
    n, labels = state.shape
    if labels > FEW or not n:
        return _one_by_one(state, trans)
    most, least = np.maximum.reduce, np.minimum.reduce
    top, shift = float(most(state, None)), float(most(trans, None))
    span = top - float(least(state, None)) + shift - float(least(trans, None)) + log(labels)  # of the factor that an item adds
    long = isqrt(n)
    if not 2 * (long + 2) * span < SAFE:
        return _one_by_one(state, trans)
    m, scaled = np.exp(trans - shift), not n * span < SAFE
    log_norm, alpha, ahead = _by_pieces(np.exp(state - top), m, long, scaled)
    nodes = np.empty((n, labels))
    np.dot(ahead[1:], m.T, nodes[:-1])
    nodes[-1] = 1.0
    nodes *= alpha
    total = np.dot(nodes, np.ones((labels, 1)))
    nodes /= total
    edges = m * np.dot((alpha[:-1] / total[:-1]).T, ahead[1:])
    return log_norm + n * top + (n - 1) * shift, nodes, edges


def _one_by_one(state: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    chain = Chain(state, trans)
    return chain.log_norm, chain.node_marginals(), chain.edge_marginals().sum(0)


def _by_pieces(e: np.ndarray, m: np.ndarray, long: int, scaled: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Log norm, and vectors of all items in both directions but for a factor.

    Item by item, all pieces of both directions go on at once, each from every label before it; then the pieces' vectors
    are found one after another, and all items' from them. So there are calls of numpy for some two roots of the items.
    """
    n, labels = e.shape
    many = -(-n // long)
    items = np.ones((2, many * long, labels))  # what follows the sequence's end has no effect on it
    items[0, :n], items[1, :n] = e, e[::-1]
    both = np.zeros((2, labels, 2, labels))
    both[0, :, 0], both[1, :, 1] = m.T, m
    both = both.reshape(2 * labels, -1)
    # by item of a piece, direction and label: pieces and the labels before them, of which the sequence's begin has none
    factors = np.empty((long, 2, labels, many, labels))
    factors[:] = items.reshape(2, many, long, labels).transpose(2, 0, 3, 1)[..., None]
    ways = np.empty_like(factors)
    first = ways[0]
    first[0], first[1] = m.T[:, None], m[:, None]
    first[:, :, 0] = 1.0
    first *= factors[0]
    dot, times = np.dot, np.multiply
    flat = ways.reshape(long, 2 * labels, -1)
    before = flat[0]
    for now, factor in zip(flat[1:], factors.reshape(flat.shape)[1:]):
        dot(both, before, now)
        times(now, factor, now)
        before = now
    into = np.zeros((many, 2, labels, 1))
    into[0, :, 0] = 1.0
    start, log_scale = into[0], 0.0
    for last, after in zip(np.ascontiguousarray(ways[-1].transpose(2, 0, 1, 3)), into[1:]):
        start = np.matmul(last, start, after)
        if scaled:
            size = start.sum(1, keepdims=True)
            start /= size
            log_scale += log(size[0, 0, 0])
    lines = (long, 2, labels, many * labels)
    times(ways.reshape(lines), into.transpose(1, 3, 0, 2).reshape(2, 1, -1), factors.reshape(lines))
    found = dot(factors.reshape(-1, labels), np.ones(labels)).reshape(long, 2, labels, many).transpose(1, 3, 0, 2).reshape(2, -1, labels)
    alpha = found[0, :n]
    return log(alpha[-1].sum()) + log_scale, alpha, found[1, n - 1 :: -1]


def stacked_sums(state: np.ndarray, trans: np.ndarray, sizes: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log norms (one per sequence), node marginals (item by item) and the sum of edge marginals of many sequences at once, or (``apart``) of each.

    ``state`` holds the sequences' items one after another, ``sizes`` their lengths. Items are worked on place by
    place, those of the longer sequences first, so that nothing is padded: of a place's items the first go on.
    """
    sizes = np.asarray(sizes)
    many, labels, ends = len(sizes), trans.shape[0], np.cumsum(sizes)
    rank = np.empty(many, np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(many)
    owner = np.repeat(np.arange(many), sizes)
    place = np.arange(len(owner)) - np.repeat(ends - sizes, sizes)
    going = many - np.cumsum(np.bincount(sizes))[:-1]  # sequences that have an item at each place
    begin = np.append(0, np.cumsum(going))
    to = begin[place] + rank[owner]
    top = state.max(1)
    shift = trans.max()
    m = np.exp(trans - shift)
    e = np.empty((labels, len(to)))
    e[:, to] = np.exp(state - top[:, None]).T
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty(len(to))
    cuts = [*zip(begin[:-1].tolist(), begin[1:].tolist())]
    for t, (a, b) in enumerate(cuts):
        row = e[:, a:b]
        if t:
            before = cuts[t - 1][0]
            row = row * (m.T @ alpha[:, before : before + b - a])
        total = row.sum(0)
        total[total <= 0] = 1.0
        np.divide(1.0, total, out=scale[a:b])
        np.multiply(row, scale[a:b], out=alpha[:, a:b])
    edges = np.zeros((*m.shape, many) if apart else m.shape)
    for t in range(len(cuts) - 1, -1, -1):
        a, b = cuts[t]
        beta[:, a:b] = scale[a:b]
        if t + 1 < len(cuts):
            c, d = cuts[t + 1]
            ahead = e[:, c:d] * beta[:, c:d]
            if apart:
                edges[:, :, : d - c] += alpha[:, None, a : a + d - c] * ahead
            else:
                edges += alpha[:, a : a + d - c] @ ahead.T
            beta[:, a : a + d - c] *= m @ ahead
    log_norm = np.bincount(owner, top - np.log(scale[to]), many) + (sizes - 1) * shift
    nodes = alpha * beta / scale
    return log_norm, np.ascontiguousarray(nodes.T[to]), m * edges[:, :, rank].transpose(2, 0, 1) if apart else m * edges


#: Sums of ways that are held, where there are more, until it has been looked up where the best ones come from.
HELD = 1 << 18


@lru_cache(maxsize=FEW)
def _best(labels: int) -> Callable[[list, list], tuple[list, float]]:
    """The best path, its last item first, and its score, as a function with its sums for so many labels written out."""
    every = range(labels)
    row = ", ".join(f"s{i}" for i in every) + ","
    lines = ["def best(states, into):", f"    ({''.join('(' + ''.join(f't{i}_{j}, ' for i in every) + '), ' for j in every)}) = into", f"    {row} = states[0]", "    held = []"]
    lines += [f"    for {''.join(f'e{j}, ' for j in every)} in states[1:]:", f"        held.append(({row}))"]
    for j in every:
        lines.append(f"        n{j} = s0 + t0_{j}")
        for i in every[1:]:
            lines += [f"        x = s{i} + t{i}_{j}", f"        if x > n{j}:", f"            n{j} = x"]
    lines += [*(f"        s{j} = n{j} + e{j}" for j in every), f"    last = ({row})", "    top = max(last)", "    y = last.index(top)", "    path = [y]", f"    for {row} in reversed(held):"]
    for j in every:
        lines += [f"        {'elif' if j else 'if'} y == {j}:", "            y = 0", f"            n = s0 + t0_{j}"]
        for i in every[1:]:
            lines += [f"            x = s{i} + t{i}_{j}", "            if x > n:", "                n = x", f"                y = {i}"]
    lines += ["        path.append(y)", "    return path, top"]
    made: dict = {}
    exec("\n".join(lines), made)
    return made["best"]


def best_path(state: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float]:
    """The path of the greatest score; ties go to the lower label."""
    n, labels = state.shape
    if labels <= FEW:
        path, top = _best(labels)(state.tolist(), trans.T.tolist())
        return np.array(path[::-1]), float(top)
    into = np.ascontiguousarray(trans.T, np.float64)
    score, steps = state[0].astype(np.float64), max(1, HELD // labels**2)
    back: list[list[int]] = []
    for begin in range(1, n, steps):
        reach = np.empty((min(steps, n - begin), labels, labels))
        for ways, scores in zip(reach, state[begin : begin + steps]):
            np.add(into, score, ways)
            np.add(np.maximum.reduce(ways, 1), scores, score)
        back += reach.argmax(2).tolist()
    path = [int(score.argmax())]
    for row in reversed(back):
        path.append(row[path[-1]])
    return np.array(path[::-1]), float(score.max())
