"""A character-level bidirectional LSTM with CRF transitions in numpy: training and decoding of windows."""

from __future__ import annotations

import numpy as np

#: Symbols: ASCII as itself, any other character, and padding.
OTHER, PAD, SYMBOLS = 128, 129, 130
EMBED, HIDDEN = 12, 20

Params = dict[str, np.ndarray]


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol numbers of code points."""
    return np.minimum(points, OTHER).astype(np.int16)


def start(labels: int, seed: int = 11) -> Params:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"embed": rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32), "out": draw(2 * HIDDEN, labels), "out_b": np.zeros(labels, np.float32)}
    p |= {"trans": np.zeros((labels, labels), np.float32), "first": np.zeros(labels, np.float32)}
    for d in "fb":
        p |= {f"in_{d}": draw(EMBED, 4 * HIDDEN), f"rec_{d}": draw(HIDDEN, 4 * HIDDEN), f"bias_{d}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"bias_{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(p: Params, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (time, window, HIDDEN) of one direction; ``keep`` gets what going back needs."""
    steps, n = x.shape
    table = p["embed"] @ p[f"in_{d}"] + p[f"bias_{d}"]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = table[x[t]] + h @ p[f"rec_{d}"]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep is not None:
            keep.append((t, i, f, o, g, before, tc, h_before))
    return out


def _lstm_back(p: Params, d: str, x: np.ndarray, keep: list, dout: np.ndarray, grad: Params) -> None:
    n = x.shape[1]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dtable = np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
    for t, i, f, o, g, before, tc, h_before in reversed(keep):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        grad[f"rec_{d}"] += h_before.T @ dz
        dtable += np.eye(SYMBOLS, dtype=dz.dtype)[x[t]].T @ dz
        dh, dc = dz @ p[f"rec_{d}"].T, dc * f
    grad[f"in_{d}"] += p["embed"].T @ dtable
    grad["embed"] += dtable @ p[f"in_{d}"].T
    grad[f"bias_{d}"] += dtable.sum(0)


def _emissions(p: Params, x: np.ndarray, keeps: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([_lstm(p, d, x, None if keeps is None else keeps.setdefault(d, [])) for d in "fb"], 2)
    return h, h @ p["out"] + p["out_b"]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def loss_and_gradient(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean negative log-likelihood of label rows ``y`` for symbol rows ``x`` (windows by time)."""
    n, steps = x.shape
    x, y = x.T, y.T
    keeps: dict = {}
    h, e = _emissions(p, x, keeps)
    trans = p["trans"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = p["first"] + e[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum((beta[t + 1] + e[t + 1])[:, None, :] + trans, 2)
    z = _log_sum(alpha[-1], 1)
    every = np.arange(n)
    gold = p["first"][y[0]] + sum(e[t, every, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    de = np.exp(alpha + beta - z[None, :, None])
    for t in range(1, steps):
        grad["trans"] += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    many = len(trans)
    grad["trans"] -= np.bincount((y[:-1].astype(np.int64) * many + y[1:]).ravel(), minlength=many * many).reshape(many, many).astype(trans.dtype)
    de[np.arange(steps)[:, None], every[None, :], y] -= 1
    grad["first"] = de[0].sum(0)
    flat_h, flat_e = h.reshape(-1, h.shape[2]), de.reshape(-1, de.shape[2])
    grad["out"], grad["out_b"] = flat_h.T @ flat_e, flat_e.sum(0)
    dh = de @ p["out"].T
    for k, d in enumerate("fb"):
        _lstm_back(p, d, x, keeps[d], dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], grad)
    return float((z - gold).mean()), {k: v / n for k, v in grad.items()}


def train(x: np.ndarray, y: np.ndarray, labels: int, epochs: int = 5, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Params:
    """Fit by Adam on mini-batches of windows; the rate falls to a tenth over the epochs."""
    p = start(labels, seed)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    total, step = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            _, grad = loss_and_gradient(p, x[order[k : k + batch]], y[order[k : k + batch]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            pace = rate * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                p[name] -= (pace * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return p


def decode(p: Params, x: np.ndarray) -> np.ndarray:
    """Best label rows of symbol rows (windows by time)."""
    if not len(x):
        return np.zeros(x.shape, np.int8)
    _, e = _emissions(p, x.T)
    steps, n = x.shape[1], len(x)
    best, back = p["first"] + e[0], np.empty((steps, n, e.shape[2]), np.int8)
    for t in range(1, steps):
        score = best[:, :, None] + p["trans"]
        back[t] = score.argmax(1)
        best = score.max(1) + e[t]
    out = np.empty((steps, n), np.int8)
    out[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][np.arange(n), out[t]]
    return out.T
