"""Small bidirectional recurrent networks in numpy: GRU and LSTM layers, backpropagation through time, Adam.

Symbols go straight to gate inputs by table lookup (an embedding folded into the input weights).  Gates use the softsign curve
``x / (1 + |x|)`` (halved and shifted for gates between 0 and 1), which costs three vector operations instead of an exponential.
Arrays are (rows, hidden), one per gate, so that every operation runs over contiguous memory.
"""

from __future__ import annotations

import numpy as np


def softsign(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    np.divide(x, d, out=x)
    return x


def gate(x: np.ndarray) -> np.ndarray:
    softsign(x)
    x *= 0.5
    x += 0.5
    return x


def d_softsign(s: np.ndarray) -> np.ndarray:
    return (1 - np.abs(s)) ** 2


def d_gate(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * g - 1)) ** 2


def _scatter(target: np.ndarray, symbols: list[np.ndarray], values: list[np.ndarray]) -> None:
    """Adds the gradients of all time steps to the rows of the symbols they belong to."""
    joined, places = np.concatenate(values), np.concatenate(symbols)
    for k in range(target.shape[1]):
        target[:, k] += np.bincount(places, joined[:, k], len(target))


class GRU:
    GATES = ("z", "r", "c")

    @staticmethod
    def step(p: dict, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = gate(np.take(p["Ez"], x, axis=0, mode="clip") + h @ p["Uz"])
        r = gate(np.take(p["Er"], x, axis=0, mode="clip") + h @ p["Ur"])
        r *= h
        c = np.take(p["Ec"], x, axis=0, mode="clip")
        c += r @ p["Uc"]
        softsign(c)
        c -= h
        c *= z
        c += h
        return c

    @classmethod
    def states(cls, p: dict, symbols: np.ndarray):
        """Hidden state after each position of symbols (time, rows); an iterator."""
        h = np.zeros((symbols.shape[1], p["Uz"].shape[0]), np.float32)
        for x in symbols:
            h = cls.step(p, x, h)
            yield h

    @staticmethod
    def train_pass(p: dict, symbols: np.ndarray):
        h, kept, out = np.zeros((symbols.shape[1], p["Uz"].shape[0]), np.float32), [], []
        for x in symbols:
            z = gate(p["Ez"][x] + h @ p["Uz"])
            r = gate(p["Er"][x] + h @ p["Ur"])
            c = softsign(p["Ec"][x] + (r * h) @ p["Uc"])
            kept.append((x, h, z, r, c))
            h = h + z * (c - h)
            out.append(h)
        return out, kept

    @staticmethod
    def back_pass(p: dict, kept: list, d_states: np.ndarray, grads: dict) -> None:
        dh = np.zeros_like(d_states[0])
        seen = {k: [] for k in "zrc"}
        for (x, h, z, r, c), d in zip(reversed(kept), reversed(d_states), strict=True):
            dh = dh + d
            dc = dh * z * d_softsign(c)
            dz = dh * (c - h) * d_gate(z)
            drh = dc @ p["Uc"].T
            dr = drh * h * d_gate(r)
            for name, value, left in (("z", dz, h), ("r", dr, h), ("c", dc, r * h)):
                seen[name].append(value)
                grads["U" + name] += left.T @ value
            dh = dh * (1 - z) + drh * r + dz @ p["Uz"].T + dr @ p["Ur"].T
        for name, values in seen.items():
            _scatter(grads["E" + name], [x for x, *_ in reversed(kept)], values)


class LSTM:
    GATES = ("i", "f", "o", "g")

    @classmethod
    def states(cls, p: dict, symbols: np.ndarray):
        c = np.zeros((symbols.shape[1], p["Ui"].shape[0]), np.float32)
        h = c.copy()
        for x in symbols:
            i, f, o, g = (np.take(p["E" + k], x, axis=0, mode="clip") + h @ p["U" + k] for k in cls.GATES)
            gate(i), gate(f), gate(o), softsign(g)
            g *= i
            f *= c
            g += f
            c = g
            h = softsign(c.copy())
            h *= o
            yield h

    @classmethod
    def train_pass(cls, p: dict, symbols: np.ndarray):
        c = np.zeros((symbols.shape[1], p["Ui"].shape[0]), np.float32)
        h, kept, out = c, [], []
        for x in symbols:
            i, f, o = (gate(p["E" + k][x] + h @ p["U" + k]) for k in "ifo")
            g = softsign(p["Eg"][x] + h @ p["Ug"])
            new = f * c + i * g
            s = softsign(new.copy())
            kept.append((x, h, c, i, f, o, g, s))
            c, h = new, o * s
            out.append(h)
        return out, kept

    @classmethod
    def back_pass(cls, p: dict, kept: list, d_states: np.ndarray, grads: dict) -> None:
        dh = np.zeros_like(d_states[0])
        dc = np.zeros_like(dh)
        seen = {k: [] for k in cls.GATES}
        for (x, h, c, i, f, o, g, s), d in zip(reversed(kept), reversed(d_states), strict=True):
            dh = dh + d
            dc = dc + dh * o * d_softsign(s)
            parts = {"i": dc * g * d_gate(i), "f": dc * c * d_gate(f), "o": dh * s * d_gate(o), "g": dc * i * d_softsign(g)}
            dh = np.zeros_like(dh)
            for name, value in parts.items():
                seen[name].append(value)
                grads["U" + name] += h.T @ value
                dh += value @ p["U" + name].T
            dc = dc * f
        for name, values in seen.items():
            _scatter(grads["E" + name], [x for x, *_ in reversed(kept)], values)


class BiRNN:
    """Two layers of one cell kind, one for each direction, and a linear head over both."""

    def __init__(self, cell, n_symbols: int, hidden: int, n_out: int, seed: int = 7, extra: dict | None = None):
        rng = np.random.default_rng(seed)
        self.cell, self.p = cell, {}
        for side in "fb":
            for k in cell.GATES:
                self.p[side + "E" + k] = rng.normal(0, 0.3, (n_symbols, hidden))
                self.p[side + "U" + k] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, hidden))
            self.p[side + "W"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, n_out))
        self.p["bias"] = np.zeros(n_out)
        self.p |= extra or {}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def side(self, side: str) -> dict:
        return {k[1:]: v for k, v in self.p.items() if k[0] == side and k != "bias"}

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """Head outputs (time, rows, outputs) for symbols (time, rows)."""
        out = np.empty((*symbols.shape, len(self.p["bias"])), np.float32)
        forward, backward = self.side("f"), self.side("b")
        for t, h in enumerate(self.cell.states(forward, symbols)):
            np.matmul(h, forward["W"], out=out[t])
            out[t] += self.p["bias"]
        last = len(symbols) - 1
        for t, h in enumerate(self.cell.states(backward, symbols[::-1])):
            out[last - t] += h @ backward["W"]
        return out

    def train(self, batches, loss, rate: float = 0.01) -> list[float]:
        """batches: (symbols (time, rows), target); loss(model, scores, target) -> (value, d_scores, {name: gradient})."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        history = []
        for n, (symbols, target) in enumerate(batches, 1):
            passes, hidden = {}, {}
            for side, order in (("f", symbols), ("b", symbols[::-1])):
                out, passes[side] = self.cell.train_pass(self.side(side), order)
                hidden[side] = np.stack(out)
            scores = hidden["f"] @ self.p["fW"] + hidden["b"][::-1] @ self.p["bW"] + self.p["bias"]
            value, d_scores, grads = loss(self, scores, target)
            d_scores = d_scores.astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in self.p.items()} | grads
            grads["bias"] = d_scores.sum((0, 1))
            for side, d in (("f", d_scores), ("b", d_scores[::-1])):
                grads[side + "W"] = np.einsum("tnh,tnk->hk", hidden[side], d)
                own = {k[1:]: g for k, g in grads.items() if k[0] == side and k not in ("bias",)}
                self.cell.back_pass(self.side(side), passes[side], d @ self.p[side + "W"].T, own)
            scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads.values()))))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step = rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(np.float32)
            history.append(float(value))
        return history
