"""A bidirectional LSTM with a linear-chain CRF on top, trained and run in numpy.

Sequences have one length T; symbols are small numbers, so that the input weights are a
table of rows.  Arrays run over (batch, time, units).
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, symbols: int, tags: int, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        rand = lambda *shape: (r.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.p = {}
        for d in "fb":  # forward and backward in time
            self.p[f"{d}x"], self.p[f"{d}h"] = rand(symbols, 4 * hidden), rand(hidden, 4 * hidden)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[f"{d}c"] = bias
        self.p["w"], self.p["o"] = rand(2 * hidden, tags), np.zeros(tags, np.float32)
        self.p["t"] = np.zeros((tags, tags), np.float32)  # from one tag to the next

    def _lstm(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, time = x.shape
        hid = self.hidden
        h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        out, kept = np.empty((n, time, hid), np.float32), []
        table, rec = self.p[f"{d}x"] + self.p[f"{d}c"], self.p[f"{d}h"]
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            z = table[x[:, t]] + h @ rec
            gates = _sigmoid(z[:, : 3 * hid])
            i, f, o = gates[:, :hid], gates[:, hid : 2 * hid], gates[:, 2 * hid :]
            g = np.tanh(z[:, 3 * hid :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((t, i, f, o, g, tc, before_h, before_c))
        return out, kept

    def _lstm_back(self, d: str, x: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
        hid, rec = self.hidden, self.p[f"{d}h"]
        one = np.eye(len(self.p[f"{d}x"]), dtype=np.float32)
        dh_next = np.zeros((len(x), hid), np.float32)
        dc_next = np.zeros((len(x), hid), np.float32)
        for t, i, f, o, g, tc, before_h, before_c in reversed(kept):
            dh = grad[:, t] + dh_next
            dc = dc_next + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dh_next, dc_next = dz @ rec.T, dc * f
            into[f"{d}h"] += before_h.T @ dz
            into[f"{d}c"] += dz.sum(axis=0)
            into[f"{d}x"] += one[x[:, t]].T @ dz

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._lstm("f", x)[0], self._lstm("b", x)[0]], axis=2) @ self.p["w"] + self.p["o"]

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags y, and its gradients."""
        n, time = x.shape
        (f, kept_f), (b, kept_b) = self._lstm("f", x), self._lstm("b", x)
        both = np.concatenate([f, b], axis=2)
        e, trans = both @ self.p["w"] + self.p["o"], self.p["t"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, time):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(time - 2, -1, -1):
            beta[:, t] = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[:, -1], 1)
        rows, steps = np.arange(n)[:, None], np.arange(time)[None]
        gold = e[rows, steps, y].sum(axis=1) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, steps, y] -= 1
        for t in range(1, time):
            grads["t"] += np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(grads["t"], (y[:, :-1], y[:, 1:]), -1)
        de /= n
        grads["t"] /= n
        grads["w"] += np.tensordot(both, de, ([0, 1], [0, 1]))
        grads["o"] += de.sum(axis=(0, 1))
        back = de @ self.p["w"].T
        self._lstm_back("f", x, kept_f, back[:, :, : self.hidden], grads)
        self._lstm_back("b", x, kept_b, back[:, :, self.hidden :], grads)
        return float((z - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 120, rate: float = 0.03, seed: int = 0) -> float:
        """Adam with a falling rate; returns the last epoch's mean loss."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, last = 0, 0.0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, losses = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, grads = self.loss_and_gradients(x[part], y[part])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale = min(1.0, 5.0 / max(norm, 1e-9))
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    g = g * scale
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each sequence (Viterbi), and the chance of each of them over all taggings."""
        e, trans = self.emissions(x), self.p["t"]
        n, time, _ = e.shape
        score, back = e[:, 0], np.empty(e.shape, np.int8)
        for t in range(1, time):
            ways = score[:, :, None] + trans
            back[:, t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + e[:, t]
        out = np.empty((n, time), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out, self._chances(e, out)

    def _chances(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Of the given tags, by the forward and backward sums, each scaled to 1."""
        moves, given = np.exp(self.p["t"]), np.exp(e - e.max(axis=2, keepdims=True))
        n, time, _ = e.shape
        forward = np.empty_like(given)
        ahead = np.full((n, self.tags), 1 / self.tags, np.float32)
        for t in range(time):
            step = given[:, t] if not t else (forward[:, t - 1] @ moves) * given[:, t]
            forward[:, t] = step / step.sum(axis=1, keepdims=True)
        out = np.empty((n, time), np.float32)
        rows = np.arange(n)
        for t in range(time - 1, -1, -1):
            both = forward[:, t] * ahead
            out[:, t] = both[rows, tags[:, t]] / both.sum(axis=1)
            ahead = (ahead * given[:, t]) @ moves.T
            ahead /= ahead.sum(axis=1, keepdims=True)
        return out
