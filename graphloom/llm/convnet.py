"""A small convolutional text classifier in numpy: several filter widths, max pooling, softmax."""

from __future__ import annotations

import copy

import numpy as np


class ConvNet:
    """Symbols 0..255 -> embedding -> filters of each width, ReLU, maximum over places -> softmax."""

    def __init__(self, classes: int, widths=(2, 3, 4), filters: int = 16, dim: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = tuple(widths), filters
        self.p = {"E": rng.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in self.widths:
            self.p[f"W{w}"] = rng.normal(0, (2 / (w * dim)) ** 0.5, (w * dim, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["V"] = rng.normal(0, 0.1, (filters * len(self.widths), classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)
        self.tables = None

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.p, len(x)
        emb, dim = p["E"][x], p["E"].shape[1]
        pooled, at, view = [], [], {}
        for w in self.widths:
            flat = np.lib.stride_tricks.sliding_window_view(emb, w, 1).transpose(0, 1, 3, 2).reshape(n, -1, w * dim)
            view[w] = flat
            z = flat @ p[f"W{w}"]
            top = z.argmax(1)
            at.append(top)
            pooled.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + p[f"b{w}"])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        z = a @ p["V"] + p["c"]
        z -= z.max(1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(1, keepdims=True)
        loss = float(-np.log(prob[np.arange(n), y] + 1e-9).mean())
        d = prob
        d[np.arange(n), y] -= 1
        if weight is not None:
            d *= weight[y, None]
        d /= n
        g = {"V": a.T @ d, "c": d.sum(0), "E": np.zeros_like(p["E"])}
        dh = (d @ p["V"].T) * (h > 0)
        for k, w in enumerate(self.widths):
            part = dh[:, k * self.filters : (k + 1) * self.filters]
            rows = view[w][np.arange(n)[:, None], at[k]]  # the window each filter chose
            g[f"W{w}"] = np.einsum("nfd,nf->df", rows, part)
            g[f"b{w}"] = part.sum(0)
            back = part[:, :, None] * p[f"W{w}"].T[None]
            for j in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], at[k] + j], back[:, :, j * dim : (j + 1) * dim])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 3, weight: np.ndarray | None = None, state: dict | None = None) -> ConvNet:
        """Adam; the same rows in the same order give the same model. ``weight`` is each class's; ``state`` carries a run over several calls."""
        state = {} if state is None else state
        if not state:
            state |= {"rng": np.random.default_rng(seed), "m": {k: np.zeros_like(v) for k, v in self.p.items()}, "v": {k: np.zeros_like(v) for k, v in self.p.items()}, "t": 0}
        rng, m, v, t = state["rng"], state["m"], state["v"], state["t"]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                t += 1
                rows = order[a : a + batch]
                _, g = self._step(x[rows], y[rows], weight)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        state["t"] = t
        self.tables = None
        return self

    def flat(self) -> np.ndarray:
        """All weights in one array."""
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def like(self, flat: np.ndarray) -> ConvNet:
        """A network of this shape with these weights."""
        out = copy.copy(self)
        ends = np.cumsum([v.size for v in self.p.values()])[:-1]
        out.p = {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(self.p.items(), np.split(flat, ends))}
        out.tables = None
        return out

    def averaged(self, rows: list) -> ConvNet:
        """The mean of the networks of ``rows(n, flat)``, by the number of examples that each was trained on; this one if there are none."""
        total = sum(r["n"] for r in rows)
        if not total:
            return self
        return self.like(sum(np.frombuffer(r["flat"], np.float64) * (r["n"] / total) for r in rows))

    def _tables(self):
        """What each symbol, or pair of neighbours, adds to the filters of a width."""
        if self.tables is None:
            self.tables = {}
            for w in self.widths:
                one = [(self.p["E"] @ self.p[f"W{w}"].reshape(w, -1, self.filters)[j]).astype(np.float32) for j in range(w)]
                one[0] = one[0] + self.p[f"b{w}"]
                parts = [((j, 2), (one[j][:, None] + one[j + 1][None]).reshape(65536, -1)) for j in range(0, w - 1, 2)]
                if w % 2:
                    parts.append(((w - 1, 1), one[w - 1]))
                self.tables[w] = parts
        return self.tables

    def logits(self, x: np.ndarray, rows: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.p["c"])), np.float32)
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            n, length = part.shape
            single = part.astype(np.intp)
            pair = single[:, :-1] * 256 + single[:, 1:]
            h = []
            for w, parts in self._tables().items():
                size = length - w + 1
                z = None
                for (j, kind), table in parts:
                    got = table.take((pair if kind == 2 else single)[:, j : j + size], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                h.append(z.max(1))
            out[a : a + rows] = np.maximum(np.concatenate(h, 1), 0) @ self.p["V"] + self.p["c"]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) if len(x) else np.zeros((0, len(self.p["c"])), np.float32)
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True) if len(z) else z

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.tables = None
