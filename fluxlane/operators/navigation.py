"""Map-matched navigation: error-state models, Kalman and particle filters, bounds and their evaluation.

State order: latitude, longitude, altitude; north, east and down velocity;
three tilts; barometer altitude and acceleration; three accelerometer and three
gyroscope biases; then compensation coefficients or network weights, if any;
three vector sensor states, if any; and last the sensor bias (first-order
Gauss-Markov).

A recursion needs the samples of its line in order: partitions hold whole lines
in order and stream through in Arrow batches. All lines of a batch step together
as stacked arrays, and the state of its last line is carried to the next batch, so
no line is held whole. All matrices that don't depend on the state are made for
many samples at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.functions.geodesy import EARTH_RADIUS, EARTH_RATE, ECCENTRICITY
from fluxlane.functions import geodesy
from fluxlane.operators import sequence
from fluxlane.operators.grid import Interpolant
from fluxlane.operators.networks import ACTIVATIONS, Network
from fluxlane.operators.select import Order

MOTION = ("lat", "lon", "alt", "vn", "ve", "vd", "fn", "fe", "fd")
#: Gains of the barometer loop.
BARO_GAINS = (3e-2, 3e-4, 1e-6)


@dataclass(frozen=True)
class Model:
    """Standard deviations and time constants. Fixed values as defaults."""

    dt: float = 0.1
    pos: float = 3.0
    alt: float = 0.001
    vel: float = 0.01
    att: float = float(np.deg2rad(0.01))
    baro_alt: float = 0.001
    baro_acc: float = 0.01
    acc: float = 0.000245
    gyro: float = 0.00000000727
    bias: float = 3.0
    vec: float = 1000.0
    velocity_walk: float = 0.000238
    angle_walk: float = 0.000000581
    baro: float = 1.0
    baro_tau: float = 3600.0
    acc_tau: float = 3600.0
    gyro_tau: float = 3600.0
    bias_tau: float = 600.0
    noise: float = 1.0
    noise_limits: tuple[float, float] | None = None
    vec_states: bool = False
    extra: tuple[float, ...] = ()
    extra_walk: tuple[float, ...] = ()

    @property
    def size(self) -> int:
        return 18 + len(self.extra) + 3 * self.vec_states


def _metres(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres of one radian of latitude and of longitude."""
    q = np.sqrt(1 - (ECCENTRICITY * np.sin(lat)) ** 2)
    return EARTH_RADIUS / q, EARTH_RADIUS * np.cos(lat) / q


def initial_covariance(m: Model, lat: float = np.deg2rad(45)) -> np.ndarray:
    north, east = _metres(lat)
    std = [m.pos / north, m.pos / east, m.alt, *[m.vel] * 3, *[m.att] * 3, m.baro_alt, m.baro_acc, *[m.acc] * 3, *[m.gyro] * 3, *m.extra, *[m.vec] * (3 * m.vec_states), m.bias]
    return np.diag(np.square(std))


def process_noise(m: Model) -> np.ndarray:
    drive = lambda s, tau: 2 * s**2 / tau
    walk = [w**2 for w in (m.extra_walk or [0.0] * len(m.extra))]
    q = [1e-30] * 3 + [m.velocity_walk**2] * 3 + [m.angle_walk**2] * 3 + [drive(m.baro, m.baro_tau), 1e-30]
    q += [drive(m.acc, m.acc_tau)] * 3 + [drive(m.gyro, m.gyro_tau)] * 3 + walk + [m.vec**2] * (3 * m.vec_states) + [drive(m.bias, m.bias_tau)]
    return np.diag(q) * m.dt


def _skew(v: np.ndarray) -> np.ndarray:
    z = np.zeros(v.shape[:-1])
    x, y, w = v[..., 0], v[..., 1], v[..., 2]
    return np.stack([np.stack([z, -w, y], -1), np.stack([w, z, -x], -1), np.stack([-y, x, z], -1)], -2)


def dynamics(motion: np.ndarray, cnb: np.ndarray, m: Model) -> np.ndarray:
    """The Pinson error dynamics of many samples: motion (n x 9, as MOTION) and body-to-navigation matrices (n x 3 x 3).

    Built of blocks: velocity and tilt errors turn with the skew matrices of
    specific force and of the frame's rate; other terms are the derivatives of
    the transport and Earth rates by position and velocity.
    """
    lat, vn, ve, vd = motion[:, 0], motion[:, 3], motion[:, 4], motion[:, 5]
    n, r = len(motion), EARTH_RADIUS
    s, c, t = np.sin(lat), np.cos(lat), np.tan(lat)
    earth_n, earth_d = EARTH_RATE * c, -EARTH_RATE * s
    over_n, over_e, over_d = ve / r, -vn / r, -ve * t / r
    f = np.zeros((n, m.size, m.size))
    k1, k2, k3 = BARO_GAINS
    # position by altitude, latitude and velocity
    f[:, 0, 2], f[:, 0, 3] = over_e / r, 1 / r
    f[:, 1, 0], f[:, 1, 2], f[:, 1, 4] = over_n * t / c, -over_n / (r * c), 1 / (r * c)
    f[:, 2, 2], f[:, 2, 5], f[:, 2, 9] = -k1, -1, k1
    # velocity by latitude and altitude
    f[:, 3, 0] = -ve * (2 * earth_n + over_n / c**2)
    f[:, 4, 0] = 2 * (vn * earth_n + vd * earth_d) + vn * over_n / c**2
    f[:, 5, 0] = -2 * ve * earth_d
    f[:, 3, 2] = (ve**2 * t - vn * vd) / r**2
    f[:, 4, 2] = -ve * (vn * t + vd) / r**2
    f[:, 5, 2] = (vn**2 + ve**2) / r**2 + k2
    # velocity by velocity
    f[:, 3, 3], f[:, 3, 4], f[:, 3, 5] = vd / r, 2 * (earth_d + over_d), vn / r
    f[:, 4, 3], f[:, 4, 4], f[:, 4, 5] = -(2 * earth_d + over_d), (vn * t + vd) / r, 2 * earth_n + over_n
    f[:, 5, 3], f[:, 5, 4], f[:, 5, 9], f[:, 5, 10] = 2 * over_e, -2 * (earth_n + over_n), -k2, 1
    f[:, 3:6, 6:9] = _skew(motion[:, 6:9])
    # tilts by position, velocity and the frame's rate
    f[:, 6, 0], f[:, 8, 0] = earth_d, -earth_n - over_n / c**2
    f[:, 6, 2], f[:, 7, 2], f[:, 8, 2] = -(ve**2) / r**2, vn / r**2, over_n * t / r
    f[:, 6, 4], f[:, 7, 3], f[:, 8, 4] = 1 / r, -1 / r, -t / r
    f[:, 6:9, 6:9] = -_skew(np.stack([earth_n + over_n, over_e, earth_d + over_d], -1))
    # barometer, sensors and their biases
    f[:, 9, 9], f[:, 10, 2], f[:, 10, 9] = -1 / m.baro_tau, k3, -k3
    for i in range(3):
        f[:, 11 + i, 11 + i], f[:, 14 + i, 14 + i] = -1 / m.acc_tau, -1 / m.gyro_tau
    f[:, 3:6, 11:14], f[:, 6:9, 14:17] = cnb, -cnb
    if m.vec_states:
        for i in range(m.size - 4, m.size - 1):
            f[:, i, i] = -1e9
    f[:, -1, -1] = -1 / m.bias_tau
    return f


def exponential(a: np.ndarray) -> np.ndarray:
    """Matrix exponentials of a stack: scaled, a [6/6] Pade approximant, and squared again."""
    norm = np.max(np.abs(a).sum(-1), initial=0)
    k = max(0, int(np.ceil(np.log2(norm))) + 1) if norm > 0.5 else 0
    a = a / 2.0**k
    c, even, odd, power = 1.0, np.zeros_like(a), np.zeros_like(a), np.broadcast_to(np.eye(a.shape[-1]), a.shape).copy()
    for i in range(7):
        if i:
            c *= (7 - i) / (i * (13 - i))
            power = power @ a
        if i % 2:
            odd = odd + c * power
        else:
            even = even + c * power
    out = np.linalg.solve(even - odd, even + odd)
    for _ in range(k):
        out = out @ out
    return out


def transition(motion: np.ndarray, cnb: np.ndarray, m: Model, dt: np.ndarray | float | None = None) -> np.ndarray:
    """Transitions over ``m.dt``, or over a time of its own for each sample.

    States beyond the seventeenth touch no others, so only the first ones take a matrix exponential.
    """
    step, out = np.broadcast_to(m.dt if dt is None else dt, len(motion))[:, None, None], np.zeros((len(motion), m.size, m.size))
    for at in range(0, len(motion), CHUNK):
        part = slice(at, at + CHUNK)
        f = dynamics(motion[part], cnb[part], m) * step[part]
        out[part, :CORE, :CORE] = exponential(f[:, :CORE, :CORE])
        for i in range(CORE, m.size):
            out[part, i, i] = np.exp(f[:, i, i])
    return out


Map = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: States that depend on one another, and samples whose transitions are made at a time.
CORE, CHUNK = 17, 128
#: Residuals that adaptive noise looks back on.
LATEST = 10


@dataclass
class State:
    """What filters keep from one sample to the next, a row a line: x, P, the latest residuals (the newest last), how many samples there were and the time of the last."""

    x: np.ndarray
    p: np.ndarray
    residuals: np.ndarray
    seen: np.ndarray
    t: np.ndarray

    @staticmethod
    def new(m: Model, lat: np.ndarray, x0: np.ndarray | None = None) -> State:
        """States of lines that begin at these latitudes."""
        n = len(lat)
        s = State(np.zeros((n, m.size)), np.zeros((n, m.size, m.size)), np.zeros((n, LATEST)), np.zeros(n, int), np.full(n, np.nan))
        for i, v in enumerate(lat):
            s.p[i] = initial_covariance(m, v)
        if x0 is not None:
            s.x[:, 17 : 17 + len(x0)] = x0
        return s

    def rows(self, at: np.ndarray | slice) -> State:
        return State(*(getattr(self, f.name)[at].copy() for f in fields(self)))

    def put(self, at: np.ndarray | slice, other: State) -> None:
        for f in fields(self):
            getattr(self, f.name)[at] = getattr(other, f.name)

    def __add__(self, other: State) -> State:
        return State(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))


def noise_now(m: Model, s: State, spread: np.ndarray) -> np.ndarray | float:
    """Measurement variances; adaptive within limits, from the latest ten residuals."""
    if m.noise_limits is None:
        return m.noise
    return np.where(s.seen < LATEST, np.mean(m.noise_limits), np.clip(np.mean(s.residuals**2, 1) - spread, *m.noise_limits))


@dataclass(frozen=True)
class LearntNetwork:
    """A network whose weights are states of a filter, and what turns its output into a measurement: times ``scale``, plus ``bias``."""

    net: Network
    bias: float = 0.0
    scale: float = 1.0

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.net.parameters()])

    def at(self, x: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The measurement's part and its slopes by the weights, for one row of inputs."""
        y, slopes = self.at_rows(x[None], weights[None])
        return float(y[0]), slopes[0]

    def at_rows(self, x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The measurements' parts and their slopes by the weights, for rows of inputs and of weights."""
        act, slope = ACTIVATIONS[self.net.activation]
        layers, inputs, sums, at, last = [], [], [], 0, len(self.net.layers) - 1
        for i, (w, _) in enumerate(self.net.layers):
            layers.append(weights[:, at : at + w.size].reshape(-1, *w.shape))
            bias = weights[:, at + w.size : at + w.size + w.shape[1]]
            at += w.size + w.shape[1]
            inputs.append(x)
            sums.append(np.einsum("bi,bij->bj", x, layers[-1]) + bias)
            x = sums[-1] if i == last else act(sums[-1])
        grad, out = np.ones((len(x), 1)), []
        for i in range(last, -1, -1):
            if i < last:
                grad = grad * slope(sums[i])
            out[:0] = [(inputs[i][:, :, None] * grad[:, None, :]).reshape(len(x), -1), grad]
            grad = np.einsum("bij,bj->bi", layers[i], grad)
        return x[:, 0] * self.scale + self.bias, np.concatenate(out, 1) * self.scale


def in_step(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, rows) of each step of lines that lie one behind the other: every line's next row, as long as it has one."""
    start = np.cumsum(sizes) - sizes
    turn = np.argsort(-sizes, kind="stable")
    for t in range(int(sizes.max(initial=0))):
        live = turn[: np.count_nonzero(sizes > t)]
        yield live, start[live] + t


def filter_lines(s: State, sizes: np.ndarray, motion: np.ndarray, cnb: np.ndarray, z: np.ndarray, surface: Interpolant, m: Model, extra_h: np.ndarray | None = None, noise_factor: np.ndarray | None = None, network: LearntNetwork | None = None, dt: np.ndarray | None = None, full: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, covariances or variances, residuals) of the next samples of many lines, each as it is after its update; ``s`` moves on.

    The samples lie line after line, as many as ``sizes`` says, and all lines step together.
    """
    phi, q = transition(motion, cnb, m, dt), process_noise(m if dt is None else replace(m, dt=1.0))
    xs, rs = np.zeros((len(z), m.size)), np.zeros(len(z))
    ps = np.zeros((len(z), m.size, m.size) if full else (len(z), m.size))
    for lines, at in in_step(sizes):
        now = s.rows(lines)
        value, slopes = surface.values_and_slopes(motion[at, 0] + now.x[:, 0], motion[at, 1] + now.x[:, 1])
        h = np.zeros_like(now.x)
        h[:, :2], h[:, -1] = slopes, 1
        extra: np.ndarray | float = 0.0
        if extra_h is not None:
            k = len(m.extra)
            extra, by_coef = network.at_rows(extra_h[at], now.x[:, 17 : 17 + k]) if network else (np.einsum("bi,bi->b", extra_h[at], now.x[:, 17 : 17 + k]), extra_h[at])
            h[:, 17 : 17 + k] = by_coef
        rs[at] = residual = z[at] - (value + extra + now.x[:, -1])
        ph = np.einsum("bij,bj->bi", now.p, h)
        spread = np.einsum("bi,bi->b", h, ph)
        gain = ph / (spread + noise_now(m, now, spread) * (1.0 if noise_factor is None else 1.0 + noise_factor[at]))[:, None]
        xs[at] = x = now.x + gain * residual[:, None]
        p = now.p - gain[:, :, None] * ph[:, None, :]
        p = (p + p.transpose(0, 2, 1)) / 2
        ps[at] = p if full else np.diagonal(p, axis1=1, axis2=2)
        step = phi[at]
        p = step @ p @ step.transpose(0, 2, 1) + (q if dt is None else q * dt[at][:, None, None])
        s.put(lines, State(np.einsum("bij,bj->bi", step, x), p, np.concatenate([now.residuals[:, 1:], residual[:, None]], 1), now.seen + 1, now.t))
    return xs, ps, rs


def ekf(motion: np.ndarray, cnb: np.ndarray, z: np.ndarray, surface: Interpolant, m: Model, extra_h: np.ndarray | None = None, x0: np.ndarray | None = None, noise_factor: np.ndarray | None = None, p0: np.ndarray | None = None, network: LearntNetwork | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, covariances, residuals) of one line, each as it is after its update.

    ``extra_h`` (a row a sample) makes the filter learn that many coefficients
    too, from ``x0`` on: Tolles-Lawson columns, or slopes of a network. With
    ``network``, ``extra_h`` holds its inputs, and the coefficients are its weights:
    its output and slopes are taken anew at each sample, at the weights of then.
    """
    s = State.new(m, motion[:1, 0], x0)
    if p0 is not None:
        s.p[0] = p0
    return filter_lines(s, np.array([len(z)]), motion, cnb, np.asarray(z, float), surface, m, extra_h, noise_factor, network)


def later(s: State, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, steps) of a filter that runs in real time: samples later than the one before and than the line's last, and the time since then, nan at a line's first one.

    ``t``: times line after line, each line's in order.
    """
    start = np.cumsum(sizes) - sizes
    before = np.concatenate([[np.nan], t[:-1]])
    begins = start[sizes > 0]
    before[begins] = s.t[sizes > 0]
    # a line's samples are in order, so those that aren't later than the state's time stand in front
    before = np.fmax(before, np.repeat(s.t, sizes))
    keep = ~(t <= before)
    return np.flatnonzero(keep), (t - before)[keep]


def filter_later(s: State, sizes: np.ndarray, t: np.ndarray, motion: np.ndarray, cnb: np.ndarray, z: np.ndarray, surface: Interpolant, m: Model, full: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows taken, states, covariances or variances, residuals) of many lines in real time; ``s`` moves on.

    The step is the model's for a line's first sample, and then the time since the
    last. A sample that isn't later than the last one leaves the state alone.
    """
    rows, dt = later(s, sizes, t)
    line = np.repeat(np.arange(len(sizes)), sizes)[rows]
    xs, ps, rs = filter_lines(s, np.bincount(line, minlength=len(sizes)), motion[rows], cnb[rows], z[rows], surface, m, dt=np.where(np.isnan(dt), m.dt, dt), full=full)
    s.t[line] = t[rows]  # the last one stays
    return rows, xs, ps, rs


def step(s: State | None, t: float, motion: np.ndarray, cnb: np.ndarray, z: float, surface: Interpolant, m: Model) -> tuple[State, np.ndarray, np.ndarray, float]:
    """One sample of one line in real time, as ``filter_later``: (state to keep, x, P and residual after the update)."""
    now = State.new(m, motion[None, 0]) if s is None else s.rows(slice(None))
    rows, xs, ps, rs = filter_later(now, np.ones(1, int), np.array([t]), motion[None], cnb[None], np.array([z]), surface, m)
    if not len(rows):
        return s, s.x[0], s.p[0], float("nan")
    return now, xs[0], ps[0], float(rs[0])


def bound_lines(s: State, sizes: np.ndarray, motion: np.ndarray, cnb: np.ndarray, surface: Interpolant, m: Model, full: bool = True) -> np.ndarray:
    """Covariances (or variances) of the Cramer-Rao bound of many lines: the filter's recursion along the true paths; ``s`` moves on."""
    phi, q = transition(motion, cnb, m), process_noise(m)
    h = np.zeros((len(motion), m.size))
    h[:, :2], h[:, -1] = surface.values_and_slopes(motion[:, 0], motion[:, 1])[1], 1
    ps = np.zeros((len(motion), m.size, m.size) if full else (len(motion), m.size))
    for lines, at in in_step(sizes):
        p = s.p[lines]
        ph = np.einsum("bij,bj->bi", p, h[at])
        p = p - ph[:, :, None] * (ph / (np.einsum("bi,bi->b", h[at], ph) + m.noise)[:, None])[:, None, :]
        p = (p + p.transpose(0, 2, 1)) / 2
        ps[at] = p if full else np.diagonal(p, axis1=1, axis2=2)
        s.p[lines] = phi[at] @ p @ phi[at].transpose(0, 2, 1) + q
    return ps


def lower_bound(motion: np.ndarray, cnb: np.ndarray, surface: Interpolant, m: Model) -> np.ndarray:
    """Covariances of the Cramer-Rao bound of one line."""
    return bound_lines(State.new(m, motion[:1, 0]), np.array([len(motion)]), motion, cnb, surface, m)


def resample(weights: np.ndarray, u: float) -> np.ndarray:
    """Systematic resampling: which particle each of as many equal places takes."""
    n = len(weights)
    return np.minimum(np.searchsorted(np.cumsum(weights) / weights.sum(), (np.arange(n) + u) / n), n - 1)


def weighted_covariance(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - weights @ x
    return (d * weights[:, None]).T @ d


class Particles:
    """A Rao-Blackwellized filter of one line, sample after sample.

    Latitude and longitude errors are particles; all other states share one
    Kalman covariance and have a mean each. ``rows`` holds a row a state and a
    column a particle, so a move of all particles is one matrix product.
    """

    def __init__(self, m: Model, lat: float, particles: int = 1000, threshold: float = 0.8, seed: int = 2) -> None:
        self.m, self.threshold, self.rng, self.q, self.done = m, threshold, np.random.default_rng(seed), process_noise(m), True
        p = initial_covariance(m, lat)
        # the last two rows are the noise of a move
        self.rows, self.spare = np.zeros((m.size + 2, particles)), np.zeros((m.size, particles))
        self.rows[:2] = (self.rng.standard_normal((particles, 2)) * np.sqrt(np.diag(p)[:2])).T
        self.p, self.w = p[2:, 2:].copy(), np.full(particles, 1 / particles)

    def update(self, z: float, lat: float, lon: float, surface: Interpolant, full: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """(state, covariance or variances) after a measurement; None, and no more from then on, when all weights vanish."""
        s, p, spare = self.rows[:-2], self.p, self.spare
        v = float(p[-1, -1]) + self.m.noise
        error = z - surface(lat + s[0], lon + s[1]) - s[-1]
        square = error * error
        w = self.w * np.exp((square - square.min()) * (-0.5 / v))
        total = w.sum()
        if not np.isfinite(total) or total <= np.finfo(float).eps:
            self.done = False
            return None
        self.w = w = w / total
        gain = p[:, -1] / v
        s[2:] += np.multiply(gain[:, None], error, out=spare[2:])
        self.p = p = p - gain[:, None] * p[-1]
        mean = s @ w
        d = np.subtract(s, mean[:, None], out=spare)
        if full:
            cov = (d * w) @ d.T
            cov[2:, 2:] += p
        else:
            cov = np.square(d, out=d) @ w
            cov[2:] += p.diagonal()
        return mean, cov

    def move(self, phi: np.ndarray) -> None:
        """Particles move by what the linear states say, which in turn learn from the move."""
        n, rows = len(self.w), self.rows
        if 1 / (self.w @ self.w) < self.threshold * n:
            rows[:-2] = rows[:-2].take(resample(self.w, self.rng.random()), 1, out=self.spare, mode="clip")
            self.w = np.full(n, 1 / n)
        rows[-2:] = self.rng.standard_normal((n, 2)).T
        p, a_nl, a_ll = self.p, phi[:2, 2:], phi[2:, 2:]
        both = a_nl @ p
        spread = both @ a_nl.T + self.q[:2, :2]
        # of two by two numbers, root and inverse are written out
        (a, _), (b, c) = (spread + 1e-40 * np.eye(2)).tolist()
        top = math.sqrt(a)
        root = np.array([[top, 0.0], [b / top, math.sqrt(c - (b / top) ** 2)]])
        k = a_ll @ (both.T @ (np.array([[c, -b], [-b, a]]) / (a * c - b * b)))
        rows[:-2] = np.matmul(np.concatenate([phi, np.concatenate([root, k @ root])], 1), rows, out=self.spare)
        p = a_ll @ p @ a_ll.T + self.q[2:, 2:] - k @ spread @ k.T
        self.p = (p + p.T) / 2


def particle_filter(motion: np.ndarray, cnb: np.ndarray, z: np.ndarray, surface: Interpolant, m: Model, particles: int = 1000, threshold: float = 0.8, seed: int = 2) -> tuple[np.ndarray, np.ndarray, bool]:
    """(states, covariances, converged) of a Rao-Blackwellized filter. It ends early, not converged, when all weights vanish."""
    f = Particles(m, motion[0, 0], particles, threshold, seed)
    out = list(_particle_rows(f, motion, transition(motion, cnb, m), z, surface))
    return np.array([x for x, _ in out]).reshape(-1, m.size), np.array([p for _, p in out]).reshape(-1, m.size, m.size), f.done


def _particle_rows(f: Particles, motion: np.ndarray, phi: np.ndarray, z: np.ndarray, surface: Interpolant, full: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(len(z) if f.done else 0):
        found = f.update(z[i], motion[i, 0], motion[i, 1], surface, full)
        if found is None:
            return
        yield found
        f.move(phi[i])


def online_setup(design: np.ndarray, z: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], np.ndarray], windows: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(mean coefficients, their deviations) of refits on sliding windows: a start for filters that learn coefficients."""
    n = len(z)
    length = max(design.shape[1] * 2, n // 2)
    starts = np.unique(np.linspace(0, max(n - length, 0), min(windows, max(n - length, 0) + 1)).astype(int))
    fits = np.stack([fit(design[s : s + length], z[s : s + length]) for s in starts])
    return fits.mean(0), fits.std(0, ddof=1) if len(fits) > 1 else np.zeros(fits.shape[1])


def recursive_least_squares(jacobian: np.ndarray, p0: float = 1.0) -> np.ndarray:
    """Covariance of weights after seeing a row of slopes for each sample."""
    p = np.eye(jacobian.shape[1]) * p0
    for w in jacobian:
        pw = p @ w
        p = p - np.outer(pw, pw) / (1 + w @ pw)
    return p


FILTER_SCHEMA = "tt double, x array<double>, p array<double>, residual double, converged boolean"


def run_filter(df: DataFrame, order: Order, surface: Interpolant, m: Model, kind: str = "ekf", z: str = "z", tt: str = "tt", extra: Sequence[str] = (), x0: Sequence[float] = (), noise_factor: str | None = None, particles: int = 1000, seed: int = 2, full: bool = True, network: LearntNetwork | None = None) -> DataFrame:
    """States and covariances (row after row, or, unless ``full``, the variances alone) of every sample of every line.

    ``df`` has MOTION's columns, ``cnb`` (array of nine, row after row) and the
    measurement. kind: ekf, online (learns the coefficients of the columns
    ``extra``), network (learns the weights of ``network``, whose inputs the columns
    ``extra`` are; ``m.extra`` has a deviation for each weight), noise (variance
    times 1 + ``noise_factor``), particle, crlb.
    """
    if kind not in ("ekf", "online", "network", "noise", "particle", "crlb"):
        raise ValueError(f"unknown filter {kind}")
    start = network.weights if kind == "network" and not len(x0) else np.asarray(x0, float) if kind in ("online", "network") else None
    if start is not None and len(start) != len(m.extra):
        raise ValueError(f"{len(start)} coefficients but {len(m.extra)} deviations")
    shared = df.sparkSession.sparkContext.broadcast(surface)  # one map level of bounded size
    by, keys = list(order.by), [f"`{n}` {t}" for n, t in df.select(*order.by).dtypes]
    inputs = list(extra) if kind in ("online", "network") else []
    factor = [noise_factor] if kind == "noise" else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _particle_step(shared.value, m, particles, seed, full) if kind == "particle" else _state_step(kind, shared.value, m, start, network, full)
        last, left = None, None
        for b in batches:
            if not b.num_rows:
                continue
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            several = lambda names: np.stack([number(c) for c in names], 1) if names else None  # noqa: B023, E731
            runs, first, end = sequence.runs(b, by)
            cnb = b.column("_cnb").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3, 3)
            samples = Samples(np.diff(runs), several([f"_{c}" for c in MOTION]), cnb, number("_z"), several([f"_e{i}" for i in range(len(inputs))]), number("_factor") if factor else None, b.select([*by, "_tt"]))
            out, left = step(samples, left if first == last else None, left)
            last = end
            yield from out
        yield from step(None, None, left)[0]

    columns = {f"_{c}": F.col(c) for c in MOTION} | {"_cnb": F.col("cnb"), "_z": F.col(z), "_tt": F.col(tt).cast("double")} | {f"_e{i}": F.col(c) for i, c in enumerate(inputs)} | {"_factor": F.col(c) for c in factor}
    along = {f"_o{i}": F.col(c) for i, c in enumerate(order.along)}
    rows = df.select(*by, *[c.cast("array<double>" if n == "_cnb" else "double").alias(n) for n, c in columns.items()], *[c.alias(n) for n, c in along.items()])
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    return rows.sortWithinPartitions(*by, *[F.asc_nulls_last(c) for c in along]).mapInArrow(run, ", ".join([*keys, FILTER_SCHEMA]))


@dataclass
class Samples:
    """Samples of a batch, line after line, as many as ``sizes`` says; ``names`` has their keys and times."""

    sizes: np.ndarray
    motion: np.ndarray
    cnb: np.ndarray
    z: np.ndarray
    extra: np.ndarray | None
    factor: np.ndarray | None
    names: pa.RecordBatch


def _lists(a: np.ndarray) -> pa.Array:
    """A row's numbers as a list; null for nan."""
    flat = a.reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), pa.float64(), from_pandas=True))


def _outputs(names: pa.RecordBatch, xs: np.ndarray, ps: np.ndarray, rs: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
    tt = pa.array(names.column(names.num_columns - 1).to_numpy(zero_copy_only=False), pa.float64(), from_pandas=True)
    arrays = [*names.columns[:-1], tt, _lists(xs), _lists(ps), pa.array(rs, pa.float64(), from_pandas=True), pa.array(done)]
    return pa.RecordBatch.from_arrays(arrays, names=[*names.schema.names[:-1], "tt", "x", "p", "residual", "converged"])


#: Rows of covariances that are made and sent at a time.
ROWS = 2048


def _state_step(kind: str, surface: Interpolant, m: Model, x0: np.ndarray | None, network: LearntNetwork | None, full: bool) -> Callable:
    """Outputs of a batch and the state of its last line, which may go on, given that of the line that goes on."""

    def step(b: Samples | None, left: State | None, _: State | None) -> tuple[Iterator[pa.RecordBatch], State | None]:
        if b is None:
            return iter(()), None
        starts = np.cumsum(b.sizes) - b.sizes
        s = State.new(m, b.motion[starts, 0], x0)
        if left is not None:
            s.put(slice(0, 1), left)
        if kind == "crlb":
            ps = bound_lines(s, b.sizes, b.motion, b.cnb, surface, m, full)
            xs, rs = np.zeros((len(ps), m.size)), np.zeros(len(ps))
        else:
            xs, ps, rs = filter_lines(s, b.sizes, b.motion, b.cnb, b.z, surface, m, b.extra, b.factor, network if kind == "network" else None, full=full)
        parts = [slice(i, i + ROWS) for i in range(0, len(rs), ROWS)]
        return (_outputs(b.names.slice(p.start, ROWS), xs[p], ps[p], rs[p], np.ones(len(rs[p]), bool)) for p in parts), s.rows(slice(-1, None))

    return step


def _particle_step(surface: Interpolant, m: Model, particles: int, seed: int, full: bool) -> Callable:
    """As ``_state_step``. Whether a line converges is known at its end, so its outputs wait for that."""

    def ended(left: tuple | None) -> Iterator[pa.RecordBatch]:
        for names, xs, ps in left[1] if left else ():
            if len(xs):
                yield _outputs(names, xs, ps, np.full(len(xs), np.nan), np.full(len(xs), left[0].done))

    def step(b: Samples | None, left: tuple | None, old: tuple | None) -> tuple[Iterator[pa.RecordBatch], tuple | None]:
        if b is None:
            return ended(old), None
        out, at, phi = [] if left else list(ended(old)), 0, transition(b.motion, b.cnb, m)
        for i, n in enumerate(b.sizes.tolist()):
            if i:
                out += ended(left)
            if i or left is None:
                left = (Particles(m, b.motion[at, 0], particles, seed=seed), [])
            part = slice(at, at + n)
            found = list(_particle_rows(left[0], b.motion[part], phi[part], b.z[part], surface, full))
            left[1].append((b.names.slice(at, len(found)), np.array([x for x, _ in found]), np.array([p for _, p in found])))
            at += n
        return iter(out), left

    return step


STATES = ("lat", "lon", "alt", "vn", "ve", "vd", "tn", "te", "td", "ha", "ah", "ax", "ay", "az", "gx", "gy", "gz")


def deviations(filtered: DataFrame, lat: Column, size: int, full: bool = True) -> DataFrame:
    """Standard deviations from covariances (variances alone unless ``full``): <state>_std, the bias's (the last state) and n_std, e_std in metres."""
    std = lambda i: F.sqrt(F.greatest(F.element_at("p", (i * size + i if full else i) + 1), F.lit(0.0)))
    named = {f"{n}_std": std(i) for i, n in enumerate(STATES)} | {"fogm_std": std(size - 1)}
    return filtered.withColumns(named).withColumns({"n_std": geodesy.lat_to_north(F.col("lat_std"), lat), "e_std": geodesy.lon_to_east(F.col("lon_std"), lat)})


def position_errors(df: DataFrame, lat: str, lon: str, true_lat: str, true_lon: str) -> DataFrame:
    """n_err and e_err in metres."""
    t = F.col(true_lat)
    return df.withColumns({"n_err": geodesy.lat_to_north(F.col(lat) - t, t), "e_err": geodesy.lon_to_east(F.col(lon) - F.col(true_lon), t)})


def drms(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance root mean square of n_err and e_err."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.col("n_err") ** 2 + F.col("e_err") ** 2)).alias("drms"))


def evaluate(filtered: DataFrame, truth: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Filter outputs beside the truth, joined on keys: estimates, deviations and errors.

    ``truth``: keys, ins_<state> (what the filter corrects) and true_lat, true_lon.
    """
    both = filtered.join(truth, list(keys))
    states = {n: F.col(f"ins_{n}") + F.element_at("x", i + 1) for i, n in enumerate(STATES[:6]) if f"ins_{n}" in truth.columns}
    both = deviations(both.withColumns(states).withColumn("fogm", F.element_at("x", -1)), F.col("true_lat"), size)
    return position_errors(both, "lat", "lon", "true_lat", "true_lon")


def filter_outputs(filtered: DataFrame, truth: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``evaluate`` with every state and its error against the truth.

    States beyond the sixth are the filter's own. ``truth`` also has true_<state>
    of the first six, and ins_cnb and true_cnb (body to navigation, row after row):
    the tilts' errors are against the turn from the one to the other.
    """
    out = evaluate(filtered, truth, keys, size)
    out = out.withColumns({n: F.element_at("x", i + 1) for i, n in enumerate(STATES) if i >= 6})
    entry = lambda m, i, j: F.element_at(m, 3 * i + j + 1)
    turn = lambda i, j: sum((entry("ins_cnb", i, k) * entry("true_cnb", j, k) for k in (1, 2)), entry("ins_cnb", i, 0) * entry("true_cnb", j, 0))
    tilts = {"tn": turn(2, 1), "te": turn(0, 2), "td": turn(1, 0)}
    errors = {f"{n}_err": F.col(n) - F.col(f"true_{n}") for n in STATES[:6]} | {f"{n}_err": F.col(n) - t for n, t in tilts.items()}
    return out.withColumns(errors)


def ins_outputs(truth: DataFrame, size: int) -> DataFrame:
    """The inertial record's errors (lat_err, lon_err, alt_err, n_err, e_err) and, where it has covariances (ins_p, row after row), their deviations."""
    out = truth.withColumns({f"{n}_err": F.col(f"ins_{n}") - F.col(f"true_{n}") for n in STATES[:3]})
    out = position_errors(out, "ins_lat", "ins_lon", "true_lat", "true_lon")
    if "ins_p" not in truth.columns:
        return out
    std = lambda i: F.sqrt(F.greatest(F.element_at("ins_p", i * size + i + 1), F.lit(0.0)))
    out = out.withColumns({f"{n}_std": std(i) for i, n in enumerate(STATES[:3])})
    return out.withColumns({"n_std": geodesy.lat_to_north(F.col("lat_std"), F.col("true_lat")), "e_std": geodesy.lon_to_east(F.col("lon_std"), F.col("true_lat"))})


def results(filtered: DataFrame, bound: DataFrame, truth: DataFrame, keys: Sequence[str], size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run's outputs: of its Cramer-Rao bound, of the inertial record, and of the filter."""
    limits = deviations(bound.join(truth.select(*keys, "true_lat"), list(keys)), F.col("true_lat"), size)
    return limits, ins_outputs(truth, size), filter_outputs(filtered, truth, keys, size)


def ellipse_units(a: Column, b: Column, c: Column, units: str = "m", lat: Column | None = None) -> tuple[Column, Column, Column]:
    """The covariance [[a, b], [b, c]] of latitude and longitude (radians) in the squares of rad, deg, m or ft, metres at a latitude."""
    if units == "rad":
        return a, b, c
    if units == "deg":
        return tuple(F.degrees(F.degrees(v)) for v in (a, b, c))
    if units not in ("m", "ft"):
        raise ValueError(f"units {units!r} are neither rad, deg, m nor ft")
    lat = F.lit(float(np.deg2rad(45))) if lat is None else lat
    foot = 1.0 if units == "m" else 0.3048
    north, east = geodesy.lat_to_north(F.lit(1.0), lat) / foot, geodesy.lon_to_east(F.lit(1.0), lat) / foot
    return a * north * north, b * north * east, c * east * east


def ellipse(a: Column, b: Column, c: Column, points: int = 61, level: float = 0.95, clip: float | None = None) -> Column:
    """Array of (x, y) on the confidence ellipse of the covariance [[a, b], [b, c]]; those farther out than ``clip`` are null."""
    mid, half = (a + c) / 2, F.sqrt(((a - c) / 2) ** 2 + b * b)
    big, small = F.sqrt(F.greatest(mid + half, F.lit(0.0))), F.sqrt(F.greatest(mid - half, F.lit(0.0)))
    turn, scale = F.atan2(2 * b, a - c) / 2, float(np.sqrt(chi_square_quantile(level, 2)))
    angles = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (2 * np.pi / (points - 1)))
    around = F.transform(
        angles, lambda t: F.struct((scale * (big * F.cos(t) * F.cos(turn) - small * F.sin(t) * F.sin(turn))).alias("x"), (scale * (big * F.cos(t) * F.sin(turn) + small * F.sin(t) * F.cos(turn))).alias("y"))
    )
    if clip is None:
        return around
    inside = lambda p: F.hypot(p["x"], p["y"]) <= clip
    return F.transform(around, lambda p: F.struct(F.when(inside(p), p["x"]).alias("x"), F.when(inside(p), p["y"]).alias("y")))


def chi_square_cdf(x: float, k: int = 1) -> float:
    """By the series of the incomplete gamma function, or its continued fraction far out."""
    from math import exp, lgamma, log

    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi_square_pdf(x: float, k: int = 1) -> float:
    from math import exp, lgamma, log

    return exp((k / 2 - 1) * log(x) - x / 2 - k / 2 * log(2) - lgamma(k / 2)) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int = 1) -> float:
    if k == 2:
        return float(-2 * np.log(1 - p))
    low, high = 0.0, 1.0
    while chi_square_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2
