"""Small networks in batched numpy with their gradients: parameters are one flat vector, so rounds can add them up.

A network offers ``size``, ``start(seed)``, ``forward(theta, x)`` (outputs and
what the way back needs) and ``backward(theta, kept, d_out)`` (the gradient of
the summed loss as a flat vector).
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Named arrays inside one flat vector."""

    def __init__(self, shapes: dict[str, tuple[int, ...]]):
        self.shapes, self.at, n = shapes, {}, 0
        for name, shape in shapes.items():
            self.at[name] = (n, n + int(np.prod(shape)))
            n += int(np.prod(shape))
        self.size = n

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[a:b].reshape(self.shapes[name]) for name, (a, b) in self.at.items()}

    def drawn(self, seed: int) -> np.ndarray:
        """Weights uniform within 1 / sqrt(inputs), biases 0."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for name, w in self.views(flat).items():
            if w.ndim > 1:
                w[:] = rng.uniform(-1, 1, w.shape) / np.sqrt(np.prod(w.shape[:-1]))
        return flat


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _rows(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int) -> tuple[np.ndarray, np.ndarray]:
    """Three taps, ``dilation`` apart, over (n, length, channels); the length stays. Also the padded input."""
    length = x.shape[1]
    wide = np.pad(x, ((0, 0), (dilation, dilation), (0, 0)))
    return sum(wide[:, j * dilation : j * dilation + length] @ w[j] for j in range(3)) + b, wide


def convolve_back(d: np.ndarray, wide: np.ndarray, w: np.ndarray, dilation: int, dw: np.ndarray, db: np.ndarray) -> np.ndarray:
    length, back = d.shape[1], np.zeros_like(wide)
    for j in range(3):
        part = slice(j * dilation, j * dilation + length)
        dw[j] += _rows(wide[:, part]).T @ _rows(d)
        back[:, part] += d @ w[j].T
    db += _rows(d).sum(0)
    return back[:, dilation : dilation + length]


def recur(x: np.ndarray, p: dict, name: str) -> tuple[np.ndarray, list]:
    """A gated recurrent layer over (n, length, inputs) from a zero state: all states."""
    wh, bh = p[name + "_wh"], p[name + "_bh"]
    size = wh.shape[0]
    inputs = x @ p[name + "_wx"] + p[name + "_bx"]
    h, states, kept = np.zeros((len(x), size)), [], []
    for t in range(x.shape[1]):
        own = h @ wh + bh
        reset, keep = sigmoid(inputs[:, t, :size] + own[:, :size]), sigmoid(inputs[:, t, size : 2 * size] + own[:, size : 2 * size])
        new = np.tanh(inputs[:, t, 2 * size :] + reset * own[:, 2 * size :])
        kept.append((h, reset, keep, new, own[:, 2 * size :]))
        h = (1 - keep) * new + keep * h
        states.append(h)
    return np.stack(states, 1), kept


def recur_back(d: np.ndarray, x: np.ndarray, kept: list, p: dict, g: dict, name: str) -> np.ndarray:
    wh = p[name + "_wh"]
    size = wh.shape[0]
    d_in, dh = np.zeros((len(x), x.shape[1], 3 * size)), np.zeros((len(x), size))
    for t in reversed(range(x.shape[1])):
        before, reset, keep, new, own = kept[t]
        dh = dh + d[:, t]
        d_new = dh * (1 - keep) * (1 - new**2)
        d_keep = dh * (before - new) * keep * (1 - keep)
        d_reset = d_new * own * reset * (1 - reset)
        d_own = np.concatenate([d_reset, d_keep, d_new * reset], 1)
        d_in[:, t] = np.concatenate([d_reset, d_keep, d_new], 1)
        g[name + "_wh"] += before.T @ d_own
        g[name + "_bh"] += d_own.sum(0)
        dh = dh * keep + d_own @ wh.T
    g[name + "_wx"] += _rows(x).T @ _rows(d_in)
    g[name + "_bx"] += _rows(d_in).sum(0)
    return d_in @ p[name + "_wx"].T


class Perceptron:
    """Dense layers with rectifiers between them; inputs (n, features) are standardised by ``mean`` and ``std``."""

    def __init__(self, widths: tuple[int, ...], mean: np.ndarray | float = 0.0, std: np.ndarray | float = 1.0, scale: np.ndarray | float = 1.0):
        self.widths, self.mean, self.std, self.scale = widths, mean, std, scale
        self.layout = Layout({f"{kind}{k}": (a, b) if kind == "w" else (b,) for k, (a, b) in enumerate(zip(widths[:-1], widths[1:], strict=True)) for kind in "wb"})
        self.size = self.layout.size

    def start(self, seed: int) -> np.ndarray:
        return self.layout.drawn(seed)

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        p, kept, at = self.layout.views(theta), [], (x - self.mean) / self.std
        last = len(self.widths) - 2
        for k in range(last + 1):
            kept.append(at)
            at = at @ p[f"w{k}"] + p[f"b{k}"]
            at = np.maximum(at, 0) if k < last else at
        return at * self.scale, kept

    def backward(self, theta: np.ndarray, kept: list, d: np.ndarray) -> np.ndarray:
        p, flat = self.layout.views(theta), np.zeros(self.size)
        g, d = self.layout.views(flat), d * self.scale
        for k in reversed(range(len(kept))):
            g[f"w{k}"] += kept[k].T @ d
            g[f"b{k}"] += d.sum(0)
            d = (d @ p[f"w{k}"].T) * (kept[k] > 0 if k else 1)
        return flat


class SpeedNet:
    """Forward speed of a window (n, length, channels): three dilated convolutions, two recurrent layers, a speed
    head (softplus) times a soft gate that says whether the vehicle moves."""

    DILATIONS = (1, 2, 4)

    def __init__(self, channels: int = 6, hidden: int = 64, mean: np.ndarray | float = 0.0, std: np.ndarray | float = 1.0, level: float = 1.0):
        self.hidden, self.mean, self.std, self.level = hidden, mean, std, level
        shapes: dict[str, tuple[int, ...]] = {}
        for k in range(3):
            shapes |= {f"c{k}_w": (3, hidden if k else channels, hidden), f"c{k}_b": (hidden,)}
        for k in range(2):
            shapes |= {f"r{k}_wx": (hidden, 3 * hidden), f"r{k}_wh": (hidden, 3 * hidden), f"r{k}_bx": (3 * hidden,), f"r{k}_bh": (3 * hidden,)}
        for head, width in (("s", 32), ("m", 16)):
            shapes |= {f"{head}0_w": (hidden, width), f"{head}0_b": (width,), f"{head}1_w": (width, 1), f"{head}1_b": (1,)}
        self.layout = Layout(shapes)
        self.size = self.layout.size

    def start(self, seed: int) -> np.ndarray:
        """Drawn weights; the heads begin at the mean speed ``level`` and at moving."""
        flat = self.layout.drawn(seed)
        p = self.layout.views(flat)
        p["s1_b"][:] = self.level + np.log(-np.expm1(-max(self.level, 1e-3)))
        p["m1_b"][:] = 3.0
        return flat

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, dict]:
        p, kept = self.layout.views(theta), {}
        at = (x - self.mean) / self.std
        for k, dilation in enumerate(self.DILATIONS):
            at, kept[f"c{k}"] = convolve(at, p[f"c{k}_w"], p[f"c{k}_b"], dilation)
            at = np.maximum(at, 0)
            kept[f"a{k}"] = at
        for k in range(2):
            kept[f"x{k}"] = at
            at, kept[f"r{k}"] = recur(at, p, f"r{k}")
        last = kept["last"] = at[:, -1]
        for head in "sm":
            kept[head] = np.maximum(last @ p[f"{head}0_w"] + p[f"{head}0_b"], 0)
            kept[head + "o"] = kept[head] @ p[f"{head}1_w"] + p[f"{head}1_b"]
        return softplus(kept["so"]) * sigmoid(kept["mo"]), kept

    def backward(self, theta: np.ndarray, kept: dict, d: np.ndarray) -> np.ndarray:
        p, flat = self.layout.views(theta), np.zeros(self.size)
        g = self.layout.views(flat)
        speed, moves = softplus(kept["so"]), sigmoid(kept["mo"])
        outs = {"s": d * moves * sigmoid(kept["so"]), "m": d * speed * moves * (1 - moves)}
        d_last = np.zeros_like(kept["last"])
        for head, out in outs.items():
            g[f"{head}1_w"] += kept[head].T @ out
            g[f"{head}1_b"] += out.sum(0)
            inner = (out @ p[f"{head}1_w"].T) * (kept[head] > 0)
            g[f"{head}0_w"] += kept["last"].T @ inner
            g[f"{head}0_b"] += inner.sum(0)
            d_last += inner @ p[f"{head}0_w"].T
        back = np.zeros((len(d), kept["x0"].shape[1], self.hidden))
        back[:, -1] = d_last
        for k in (1, 0):
            back = recur_back(back, kept[f"x{k}"], kept[f"r{k}"], p, g, f"r{k}")
        for k in (2, 1, 0):
            back = convolve_back(back * (kept[f"a{k}"] > 0), kept[f"c{k}"], p[f"c{k}_w"], self.DILATIONS[k], g[f"c{k}_w"], g[f"c{k}_b"])
        return flat
