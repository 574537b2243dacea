"""A transformer encoder over windows of features, in numpy with gradients by hand.

It stands in for ``networks.Network``: rows are windows laid flat (feature by
feature), and its parameters are pairs, so the same training sums its gradients.
A window's features are embedded, get learnt positions, attend to each other by
several heads, and pass a feed-forward layer; both parts are added to what they
read and normalized a sample and step (before they are read, if ``pre``). The
flattened window gives the output. Normalization is by layer: statistics of a batch
would tie together rows of different tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fluxlane.operators.networks import ACTIVATIONS, Network, Setup

_TINY = 1e-5


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def batch_norm(x: np.ndarray) -> np.ndarray:
    """A tensor (features, window, samples) normalized by feature over window and samples."""
    mean, var = x.mean((1, 2), keepdims=True), x.var((1, 2), keepdims=True)
    return (x - mean) / np.sqrt(var + _TINY)


def normalize(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, tuple]:
    spread = np.sqrt(x.var(-1, keepdims=True) + _TINY)
    unit = (x - x.mean(-1, keepdims=True)) / spread
    return unit * gain + shift, (unit, spread, gain)


def normalize_back(grad: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by the input, the gain and the shift."""
    unit, spread, gain = kept
    inner = grad * gain
    by_x = (inner - inner.mean(-1, keepdims=True) - unit * (inner * unit).mean(-1, keepdims=True)) / spread
    return by_x, (grad * unit).sum((0, 1)), grad.sum((0, 1))


def dense_back(grad: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by the input, the weights and the biases of x w + b, over samples and steps."""
    return grad @ w.T, np.einsum("nti,ntj->ij", x, grad), grad.sum((0, 1))


@dataclass
class Transformer(Network):
    """``layers``: embedding, positions, queries, keys, values, their output, a norm, two feed-forward layers, a norm, the output."""

    window: int = 5
    heads: int = 2
    pre: bool = False

    @staticmethod
    def create(n_in: int, n_out: int, s: Setup, rng: np.random.Generator, window: int = 5, heads: int = 2, pre: bool = False, gain: float = 1.0) -> Transformer:
        """For ``n_in`` columns, ``window`` steps of each feature; the first hidden layer is the width of a step, the second that of the feed-forward layer."""
        width = s.hidden[0]
        inner = s.hidden[1] if len(s.hidden) > 1 else width
        if width % heads or n_in % window:
            raise ValueError("heads must divide the width, and the window the number of columns")
        pair = lambda a, b: (rng.uniform(-1, 1, (a, b)) * gain * np.sqrt(6 / (a + b)), np.zeros(b))
        norm = lambda: (np.ones(width), np.zeros(width))
        layers = [pair(n_in // window, width), (rng.uniform(-0.02, 0.02, (window, width)), np.zeros(0)), *[pair(width, width) for _ in range(4)], norm(), pair(width, inner), pair(inner, width), norm(), pair(width * window, n_out)]
        return Transformer(layers, s.activation, window, heads, pre)

    def _split(self, x: np.ndarray) -> np.ndarray:
        n, t, width = x.shape
        return x.reshape(n, t, self.heads, width // self.heads).transpose(0, 2, 1, 3)

    def _join(self, x: np.ndarray) -> np.ndarray:
        n, heads, t, part = x.shape
        return x.transpose(0, 2, 1, 3).reshape(n, t, heads * part)

    def _attend(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        q, k, v = (self._split(x @ w + b) for w, b in self.layers[2:5])
        shares = softmax(q @ k.swapaxes(2, 3) / np.sqrt(q.shape[-1]))
        seen = self._join(shares @ v)
        w, b = self.layers[5]
        return seen @ w + b, (x, q, k, v, shares, seen)

    def _attend_back(self, grad: np.ndarray, kept: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
        x, q, k, v, shares, seen = kept
        by_seen, *out = dense_back(grad, seen, self.layers[5][0])
        by_seen = self._split(by_seen)
        by_shares, by_v = by_seen @ v.swapaxes(2, 3), shares.swapaxes(2, 3) @ by_seen
        by_scores = shares * (by_shares - (by_shares * shares).sum(-1, keepdims=True)) / np.sqrt(q.shape[-1])
        by_x, found = 0.0, []
        for part, (w, _) in zip((by_scores @ k, by_scores.swapaxes(2, 3) @ q, by_v), self.layers[2:5], strict=True):
            more, *grads = dense_back(self._join(part), x, w)
            by_x = by_x + more
            found += grads
        return by_x, [*found, *out]

    def _feed(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        (w1, b1), (w2, b2) = self.layers[7:9]
        z = x @ w1 + b1
        inner = ACTIVATIONS[self.activation][0](z)
        return inner @ w2 + b2, (x, z, inner)

    def _feed_back(self, grad: np.ndarray, kept: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
        x, z, inner = kept
        by_inner, *last = dense_back(grad, inner, self.layers[8][0])
        by_x, *first = dense_back(by_inner * ACTIVATIONS[self.activation][1](z), x, self.layers[7][0])
        return by_x, [*first, *last]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list, list]:
        """(output, what the way back needs, nothing)."""
        steps = x.reshape(len(x), -1, self.window).swapaxes(1, 2)
        (we, be), (place, _), norm1, norm2, (wf, bf) = self.layers[0], self.layers[1], self.layers[6], self.layers[9], self.layers[10]
        now = (steps @ we + be) * np.sqrt(we.shape[1]) + place
        kept: list = [steps]
        for norm, part in ((norm1, self._attend), (norm2, self._feed)):
            if self.pre:
                read, n = normalize(now, *norm)
                more, k = part(read)
                now = now + more
            else:
                more, k = part(now)
                now, n = normalize(now + more, *norm)
            kept.append((n, k))
        flat = now.reshape(len(x), -1)
        return flat @ wf + bf, [*kept, flat], []

    def backward(self, grad: np.ndarray, inputs: list, sums: list) -> list[np.ndarray]:
        steps, attended, fed, flat = inputs
        we, (wf, _) = self.layers[0][0], self.layers[10]
        found: dict[int, list[np.ndarray]] = {10: [flat.T @ grad, grad.sum(0)]}
        now = (grad @ wf.T).reshape(len(flat), self.window, -1)
        for at, (n, k), back in ((9, fed, self._feed_back), (6, attended, self._attend_back)):
            if self.pre:
                read, inner = back(now, k)
                by_x, *norm = normalize_back(read, n)
                now = now + by_x
            else:
                now, *norm = normalize_back(now, n)
                by_x, inner = back(now, k)
                now = now + by_x
            first = 7 if at == 9 else 2
            found[at] = norm
            found |= {first + i: inner[2 * i : 2 * i + 2] for i in range(len(inner) // 2)}
        found[1] = [now.sum(0), np.zeros(0)]
        found[0] = list(dense_back(now * np.sqrt(we.shape[1]), steps, we)[1:])
        return [g for k in sorted(found) for g in found[k]]
