"""Recurrent networks along lines: inference over streamed batches, and training inside a filter.

A network is a long short-term memory cell and a dense output. Its state is carried
from one Arrow batch of a line to the next, so a line is never held whole; within a
batch all lines step together. A window of rows before each row needs no state but
the last rows of the batch before.

``fit_noise`` trains a network whose output scales the measurement noise of a Kalman
filter, so that the filter's positions come near the true ones. The gradient runs
back through every update and propagation of the filter, all windows of a batch
together, and is summed over windows by Spark: one job an epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.functions.geodesy import EARTH_RADIUS, ECCENTRICITY
from fluxlane.operators import navigation, sequence
from fluxlane.operators.grid import Interpolant
from fluxlane.operators.navigation import MOTION, Model
from fluxlane.operators.networks import ACTIVATIONS, Adam
from fluxlane.operators.select import Order

OUTPUTS = ACTIVATIONS | {"identity": (lambda z: z, np.ones_like)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Recurrent:
    """Weights of a cell (of inputs, of its own state, biases; gates in the order input, forget, cell, output) and of its output."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    activation: str = "swish"

    @staticmethod
    def create(n_in: int, hidden: int, rng: np.random.Generator, activation: str = "swish") -> Recurrent:
        draw = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1  # remember at first
        return Recurrent(draw(n_in, 4 * hidden), draw(hidden, 4 * hidden), bias, draw(hidden, 1), np.zeros(1), activation)

    @property
    def hidden(self) -> int:
        return len(self.wh)

    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.wo, self.bo]

    def cell(self, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """One step of many sequences: the states after it, and what the way back needs."""
        k = self.hidden
        z = x @ self.wx + h @ self.wh + self.b
        i, f, g, o = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), np.tanh(z[:, 2 * k : 3 * k]), _sigmoid(z[:, 3 * k :])
        new_c = f * c + i * g
        t = np.tanh(new_c)
        return o * t, new_c, (x, h, c, i, f, g, o, t)

    def output(self, h: np.ndarray) -> np.ndarray:
        return OUTPUTS[self.activation][0](h @ self.wo + self.bo)[:, 0]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Outputs (steps x sequences) of inputs (steps x sequences x features) from zero states."""
        h = c = np.zeros((x.shape[1], self.hidden))
        out, kept = [], []
        for now in x:
            h, c, k = self.cell(now, h, c)
            kept.append((*k, h))
            out.append(self.output(h))
        return np.array(out).reshape(x.shape[:2]), kept

    def backward(self, grad: np.ndarray, kept: list[tuple]) -> list[np.ndarray]:
        """Gradients of all parameters, given the outputs'."""
        total = [np.zeros_like(p) for p in self.parameters()]
        dh = dc = np.zeros((grad.shape[1], self.hidden))
        for t in range(len(kept) - 1, -1, -1):
            x, h0, c0, i, f, g, o, tanh_c, h = kept[t]
            dy = (grad[t] * OUTPUTS[self.activation][1](h @ self.wo + self.bo)[:, 0])[:, None]
            total[3] += h.T @ dy
            total[4] += dy.sum(0)
            dh = dh + dy @ self.wo.T
            dc = dc + dh * o * (1 - tanh_c**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g**2), dh * tanh_c * o * (1 - o)], 1)
            total[0] += x.T @ dz
            total[1] += h0.T @ dz
            total[2] += dz.sum(0)
            dh, dc = dz @ self.wh.T, dc * f
        return total


def _streamed(df: DataFrame, order: Order, features: Sequence[str], out: str, step: Callable) -> DataFrame:
    """``df`` with what ``step`` gives for the rows of a batch: of their features, where lines begin, and what the batch before left of the first one (None at a line's start)."""
    by, kinds = list(order.by), [f"`{c}` {t}" for c, t in df.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            if not b.num_rows:
                continue
            runs, first, end = sequence.runs(b, by)
            x = np.stack([b.column(f"_x{n}").to_numpy(zero_copy_only=False).astype(float) for n in range(len(features))], 1)
            y, left = step(x, runs, left if first == last else None)
            last = end
            yield b.select(names).append_column(out, pa.array(y, pa.float64(), from_pandas=True))

    names = df.columns
    rows = df.select("*", *[F.col(c).cast("double").alias(f"_x{n}") for n, c in enumerate(features)])
    ordered = rows.repartition(*by) if by else rows.coalesce(1)
    return ordered.sortWithinPartitions(*by, *order.along).mapInArrow(run, ", ".join([*kinds, f"`{out}` double"]))


def predict_full(df: DataFrame, order: Order, features: Sequence[str], net: Recurrent, out: str = "y_hat") -> DataFrame:
    """The network's output at every row of every line, from the line's start on. A null feature makes the rest of its line null."""

    def step(x: np.ndarray, runs: np.ndarray, left: tuple | None) -> tuple[np.ndarray, tuple]:
        start, size = runs[:-1], np.diff(runs)
        h, c = (np.zeros((len(size), net.hidden)) for _ in range(2))
        if left is not None:
            h[0], c[0] = left
        # the longest lines first, so that those that go on stand in front
        turn = np.argsort(-size, kind="stable")
        h, c, y = h[turn], c[turn], np.zeros(len(x))
        for t in range(int(size.max())):
            live = int(np.count_nonzero(size > t))
            h[:live], c[:live], _ = net.cell(x[start[turn[:live]] + t], h[:live], c[:live])
            y[start[turn[:live]] + t] = net.output(h[:live])
        at = int(np.flatnonzero(turn == len(size) - 1)[0])
        return y, (h[at].copy(), c[at].copy())

    return _streamed(df, order, features, out, step)


def predict_windowed(df: DataFrame, order: Order, features: Sequence[str], net: Recurrent, window: int, out: str = "y_hat") -> DataFrame:
    """At every row, the network's output after the latest ``window`` rows of its line (fewer at its start), from a state of zeros. A null feature makes its windows null."""

    def step(x: np.ndarray, runs: np.ndarray, left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        before = 0 if left is None else len(left)
        whole = x if left is None else np.concatenate([left, x])
        first = np.repeat(np.concatenate([[0], runs[1:-1] + before]), np.diff(runs))
        at = np.arange(len(x)) + before
        begin = np.maximum(first, at - window + 1)
        h, c = (np.zeros((len(x), net.hidden)) for _ in range(2))
        for k in range(window):
            live = np.flatnonzero(begin + k <= at)
            h[live], c[live], _ = net.cell(whole[begin[live] + k], h[live], c[live])
        return net.output(h), whole[max(first[-1], len(whole) - window + 1) :] if window > 1 else whole[:0]

    return _streamed(df, order, features, out, step)


def _metre_slopes(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Metres of a radian of latitude and of longitude, and their slopes by latitude."""
    s, c = np.sin(lat), np.cos(lat)
    q = np.sqrt(1 - (ECCENTRICITY * s) ** 2)
    north, bend = EARTH_RADIUS / q, EARTH_RADIUS * ECCENTRICITY**2 * s * c / q**3
    return north, north * c, bend, bend * c - north * s


@dataclass
class Windows:
    """Samples of many windows, steps first: transitions, measurements, places, true places and the network's inputs."""

    phi: np.ndarray
    z: np.ndarray
    place: np.ndarray
    truth: np.ndarray
    x: np.ndarray
    p0: np.ndarray
    q: np.ndarray


def filter_step(surface: Interpolant, m: Model, place: np.ndarray, phi: np.ndarray, q: np.ndarray, z: np.ndarray, scale: np.ndarray, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """One update and propagation of many filters: states and covariances after both, and what the way back needs. ``scale``: what multiplies the noise, less one."""
    value, slope, curve = surface.curved(place[:, 0] + x[:, 0], place[:, 1] + x[:, 1])
    h = np.zeros_like(x)
    h[:, :2], h[:, -1] = slope, 1
    e = z - (value + x[:, -1])
    v = np.einsum("bij,bj->bi", p, h)
    s = np.einsum("bi,bi->b", h, v) + m.noise * (1 + scale)
    gain = v / s[:, None]
    x1 = x + gain * e[:, None]
    p1 = p - gain[:, :, None] * v[:, None, :]
    return np.einsum("bij,bj->bi", phi, x1), phi @ p1 @ phi.transpose(0, 2, 1) + q, (h, curve, e, v, s, gain, p, phi)


def filter_step_back(m: Model, kept: tuple, dx: np.ndarray, dp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by the states, covariances and noise scales before a step, given those after it."""
    h, curve, e, v, s, gain, p, phi = kept
    dx1 = np.einsum("bji,bj->bi", phi, dx)
    dp1 = phi.transpose(0, 2, 1) @ dp @ phi
    dgain = dx1 * e[:, None]
    de = np.einsum("bi,bi->b", gain, dx1)
    # the covariance loses v v' / s
    both = np.einsum("bij,bj->bi", dp1 + dp1.transpose(0, 2, 1), v)
    dv = -both / s[:, None] + dgain / s[:, None]
    ds = np.einsum("bi,bi->b", both, v) / (2 * s**2) - np.einsum("bi,bi->b", dgain, v) / s**2
    dv += ds[:, None] * h
    dh = ds[:, None] * v + np.einsum("bji,bj->bi", p, dv)
    dp0 = dp1 + dv[:, :, None] * h[:, None, :]
    dx0 = dx1 - de[:, None] * h
    # the map's slopes move with the place
    dx0[:, 0] += dh[:, 0] * curve[:, 0] + dh[:, 1] * curve[:, 1]
    dx0[:, 1] += dh[:, 0] * curve[:, 1] + dh[:, 1] * curve[:, 2]
    return dx0, dp0, ds * m.noise


def noise_loss(net: Recurrent, w: Windows, surface: Interpolant, m: Model, slopes: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distance RMS of each window's positions, and the gradient of their sum by the network's parameters."""
    scale, kept_net = net.forward(w.x)
    steps, n = w.z.shape
    x, p = np.zeros((n, m.size)), w.p0
    kept, pulls, total = [], [], np.zeros(n)
    for t in range(steps):
        x, p, k = filter_step(surface, m, w.place[t], w.phi[t], w.q, w.z[t], scale[t], x, p)
        kept.append(k)
        lat = w.place[t, :, 0] + x[:, 0]
        north, east, north_bend, east_bend = _metre_slopes(lat)
        d = w.truth[t] - w.place[t] - x[:, :2]
        e_n, e_e = d[:, 0] * north, d[:, 1] * east
        total += e_n**2 + e_e**2
        pulls.append((2 * e_n * (d[:, 0] * north_bend - north) + 2 * e_e * d[:, 1] * east_bend, -2 * e_e * east))
    loss = np.sqrt(total / steps)
    if not slopes:
        return loss, []
    per = np.divide(1, 2 * steps * loss, out=np.zeros(n), where=loss > 0)
    dx, dp, dscale = np.zeros_like(x), np.zeros_like(p), np.zeros_like(scale)
    for t in range(steps - 1, -1, -1):
        dx[:, 0] += per * pulls[t][0]
        dx[:, 1] += per * pulls[t][1]
        dx, dp, dscale[t] = filter_step_back(m, kept[t], dx, dp)
    return loss, net.backward(dscale, kept_net)


def _windows(b: pa.RecordBatch, columns: dict[str, Sequence[str]], m: Model) -> Windows:
    """The windows of a batch whose rows hold arrays of a window's samples."""
    def numbers(c: str) -> np.ndarray:
        """A column's numbers, a row a window, samples in order."""
        values = b.column(c)
        while pa.types.is_list(values.type):
            values = values.flatten()
        return values.to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)

    several = lambda names: np.stack([numbers(c) for c in names], -1).swapaxes(0, 1)
    motion = several(MOTION)
    cnb = numbers("cnb").reshape(b.num_rows, -1, 9).swapaxes(0, 1)
    steps, n = motion.shape[:2]
    phi = navigation.transition(motion.reshape(-1, len(MOTION)), cnb.reshape(-1, 3, 3), m).reshape(steps, n, m.size, m.size)
    p0 = np.stack([navigation.initial_covariance(m, lat) for lat in motion[0, :, 0]])
    return Windows(phi, several(columns["z"])[..., 0], motion[..., :2], several(columns["truth"]), several(columns["x"]), p0, navigation.process_noise(m))


def fit_noise(
    df: DataFrame, order: Order, surface: Interpolant, m: Model, features: Sequence[str], truth: tuple[str, str] = ("true_lat", "true_lon"), z: str = "z", hidden: int = 1, activation: str = "swish", window: int = 50, epochs: int = 10, rate: float = 0.1, seed: int = 2
) -> tuple[Recurrent, list[float]]:
    """A network of ``features`` that scales a filter's noise (``run_filter`` kind noise), and the mean loss before each epoch and at the end.

    ``df``: MOTION's columns, cnb, the measurement, features and true positions.
    Lines are cut into windows, each filtered from the start's covariance; what is
    left at a line's end takes no part. Every epoch is a step of Adam on all windows.
    """
    net = Recurrent.create(len(features), hidden, np.random.default_rng(seed), activation)
    columns = {"z": [z], "truth": list(truth), "x": list(features)}
    names = list(dict.fromkeys([*MOTION, "cnb", z, *truth, *features]))
    windows = sequence.chunks(df, order, names, window).select(*names).persist()
    shared = df.sparkSession.sparkContext.broadcast(surface)  # one map level of bounded size
    adam, losses = Adam(net.parameters(), rate), []

    def sums(slopes: bool) -> list[float]:
        """Number of windows, their losses and, with ``slopes``, the gradient, number by number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    loss, grads = noise_loss(net, _windows(b.slice(at, 64), columns, m), shared.value, m, slopes)
                    now = np.concatenate([[len(loss), loss.sum()], *[g.ravel() for g in grads]])
                    total = now if total is None else total + now
            if total is not None:
                yield pa.record_batch({"place": pa.array(range(len(total)), pa.int32()), "part": pa.array(total)})

        rows = windows.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()  # a row a parameter
        return [r.part for r in sorted(rows)]

    try:
        for _ in range(epochs):
            found = sums(True)
            if not found:
                break
            losses.append(found[1] / found[0])
            flat, grads, at = np.array(found[2:]) / found[0], [], 0
            for p in net.parameters():
                grads.append(flat[at : at + p.size].reshape(p.shape))
                at += p.size
            adam.step(grads, [True] * len(grads))
        if losses:
            found = sums(False)
            losses.append(found[1] / found[0])
    finally:
        windows.unpersist()
    return net, losses
