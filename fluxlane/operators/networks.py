"""Small feed-forward networks in numpy, fitted on all rows by Adam and applied as Arrow batches.

A row's mini-batch is a hash of its values. A step's gradient is a sum over the
rows of a mini-batch: taken on the driver if the table is small, else by a Spark
job over the part of a stored table that holds the mini-batch. Both ways take
the same steps.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.sources.tables import remove, scratch

ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda z: (z > 0).astype(float)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda z: (s := 1 / (1 + np.exp(-z))) * (1 - s)),
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
    "swish": (lambda z: z / (1 + np.exp(-z)), lambda z: (s := 1 / (1 + np.exp(-z))) + z * s * (1 - s)),
}


@dataclass(frozen=True)
class Setup:
    """How a network is built and trained."""

    hidden: tuple[int, ...] = (8,)
    activation: str = "swish"
    epochs: int = 5
    batch: int = 2048
    rate: float = 0.01
    train_share: float = 14 / 17
    group_lasso: float = 0.0
    group_share: float = 1.0
    seed: int = 2
    #: adam, or lbfgs: an epoch is then a step with the gradient of all rows, and a few jobs.
    optimizer: str = "adam"
    #: Steps that lbfgs remembers, and how often it halves a step that doesn't lower the error.
    memory: int = 10
    halvings: int = 12
    #: Mini-batches an epoch at most: beyond, batches grow with the table.
    steps: int = 64
    #: Tables of more rows stay in Spark while they are fitted on.
    bound: int = 1 << 20


@dataclass
class Network:
    """Weights and biases of each layer."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str = "swish"

    @staticmethod
    def create(n_in: int, n_out: int, s: Setup, rng: np.random.Generator) -> Network:
        sizes = [n_in, *s.hidden, n_out]
        return Network([(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)], s.activation)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(output, inputs of layers, sums of layers)."""
        act, inputs, sums = ACTIVATIONS[self.activation][0], [], []
        for i, (w, b) in enumerate(self.layers):
            inputs.append(x)
            sums.append(x @ w + b)
            x = sums[-1] if i == len(self.layers) - 1 else act(sums[-1])
        return x, inputs, sums

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(np.asarray(x, float))[0]

    def backward(self, grad: np.ndarray, inputs: list[np.ndarray], sums: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of all weights and biases, given the output's."""
        slope, out = ACTIVATIONS[self.activation][1], []
        for i in range(len(self.layers) - 1, -1, -1):
            if i < len(self.layers) - 1:
                grad = grad * slope(sums[i])
            out[:0] = [inputs[i].T @ grad, grad.sum(0)]
            grad = grad @ self.layers[i][0].T
        return out

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in layer]

    def with_parameters(self, flat: np.ndarray) -> Network:
        """The network of other parameters, in the order of ``parameters``, one behind the other."""
        layers, at = [], 0
        for w, b in self.layers:
            layers.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(layers, self.activation)

    def jacobian(self, x: np.ndarray) -> np.ndarray:
        """The output's slope by every parameter, a row a sample: what filters with weights as states need."""
        rows = []
        for r in np.atleast_2d(x):
            _, i, s = self.forward(r[None])
            rows.append(np.concatenate([g.ravel() for g in self.backward(np.ones((1, 1)), i, s)]))
        return np.stack(rows)


class Adam:
    """Adam with a count of steps for each number, so that those that rest for a while go on where they were."""

    def __init__(self, parameters: list[np.ndarray], rate: float) -> None:
        self.parameters, self.rate = parameters, rate
        self.t, self.m, self.v = ([np.zeros_like(p) for p in parameters] for _ in range(3))

    def step(self, grads: Sequence[np.ndarray], moves: Sequence[np.ndarray | bool]) -> None:
        """``moves``: which numbers of each parameter are trained."""
        for p, g, on, t, m, v in zip(self.parameters, grads, moves, self.t, self.m, self.v, strict=True):
            on = np.broadcast_to(on, p.shape)
            t[on] += 1
            m[on] += 0.1 * (g - m)[on]
            v[on] += 0.001 * (g * g - v)[on]
            p[on] -= self.rate * (m[on] / (1 - 0.9 ** t[on])) / (np.sqrt(v[on] / (1 - 0.999 ** t[on])) + 1e-8)


def group_penalty(w: np.ndarray, share: float = 1.0) -> np.ndarray:
    """(1 - share) times the sum of magnitudes plus share times the length of each input's weights."""
    return (1 - share) * np.abs(w).sum(1) + share * np.linalg.norm(w, axis=1)


def _group_slope(w: np.ndarray, share: float) -> np.ndarray:
    return (1 - share) * np.sign(w) + share * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)


@dataclass
class Head:
    """How the prediction is made of a network's output and of given columns ``a``.

    plain: the output; dot: the sum of the output times as many leading columns
    of ``a``. Either way the last columns of ``a`` times the coefficients, if
    there are any, are added. ``applied``: whether the output counts.
    """

    kind: str = "plain"
    coef: np.ndarray = field(default_factory=lambda: np.zeros(0))
    applied: bool = True

    def value(self, out: np.ndarray, a: np.ndarray) -> np.ndarray:
        y = np.zeros(len(out)) if not self.applied else out[:, 0] if self.kind == "plain" else (a[:, : out.shape[1]] * out).sum(1)
        return y + a[:, -len(self.coef) :] @ self.coef if len(self.coef) else y

    def slopes(self, miss: np.ndarray, out: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by the output and by the coefficients."""
        by_out = miss[:, None] * (a[:, : out.shape[1]] if self.kind == "dot" else 1.0) * self.applied
        return by_out, a[:, -len(self.coef) :].T @ miss if len(self.coef) else np.zeros(0)


@dataclass(frozen=True)
class Phase:
    """What is trained from a share of the epochs on.

    ``network``: the network's weights; ``applied``: the output counts; ``coef``:
    which coefficients (None: all); ``within``: only rows whose target lies
    within so many deviations of the mean.
    """

    since: float = 0.0
    network: bool = True
    applied: bool = True
    coef: tuple[bool, ...] | None = None
    within: float = math.inf


def sums(net: Network, head: Head, x: np.ndarray, a: np.ndarray, y: np.ndarray, within: float = math.inf) -> np.ndarray:
    """Gradients of the summed squared error by all weights and coefficients, that error and the number of rows, in one array."""
    if within < math.inf:
        near = np.abs(y) <= within
        x, a, y = x[near], a[near], y[near]
    out, inputs, inner = net.forward(x)
    miss = head.value(out, a) - y
    by_out, by_coef = head.slopes(2 * miss, out, a)
    return np.concatenate([*(g.ravel() for g in net.backward(by_out, inputs, inner)), by_coef, [miss @ miss, len(miss)]])


def _parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pick = lambda s: pdf[[c for c in pdf.columns if c.startswith(s)]].to_numpy(float)
    return pick("_x"), pick("_a"), pdf["_y"].to_numpy(float)


class Held:
    """Rows on the driver, by mini-batch; -1 are those kept from training."""

    def __init__(self, rows: DataFrame) -> None:
        pdf = rows.toPandas()
        pdf = pdf.sort_values(list(pdf.columns), kind="stable")
        self.parts = {int(k): _parts(g) for k, g in pdf.groupby("_step")}
        self.counts = {k: len(v[2]) for k, v in self.parts.items()}

    def total(self, steps: Sequence[int], net: Network, head: Head, within: float = math.inf) -> np.ndarray:
        return np.sum([sums(net, head, *self.parts[k], within) for k in steps], axis=0)

    def close(self) -> None:
        self.parts = {}


class Stored:
    """Rows in the shared folder, a folder a mini-batch: each epoch reads every row once."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark, self.path = rows.sparkSession, f"{scratch(rows.sparkSession)}/fit-{uuid.uuid4().hex}"
        rows.write.partitionBy("_step").parquet(self.path)
        self.table = self.spark.read.parquet(self.path)
        self.counts = {r[0]: r[1] for r in self.table.groupBy("_step").count().collect()}  # a row a mini-batch

    def total(self, steps: Sequence[int], net: Network, head: Head, within: float = math.inf) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = None
            for b in batches:
                part = sums(net, head, *_parts(b), within)
                found = part if found is None else found + part
            if found is not None:
                yield pd.DataFrame({"i": np.arange(len(found)), "g": found})

        rows = self.table.filter(F.col("_step").isin([int(k) for k in steps])).drop("_step")
        by_number = rows.mapInPandas(run, "i long, g double").groupBy("i").agg(F.sum("g"))
        return np.array([g for _, g in sorted(by_number.collect())])  # a row a weight

    def close(self) -> None:
        remove(self.spark, self.path)


def train(rows: Held | Stored, net: Network, head: Head, s: Setup, phases: Sequence[Phase] = (Phase(),)) -> None:
    """``net`` and ``head`` fitted in place; the epoch with the least error on held-out rows is kept."""
    fit = [k for k in sorted(rows.counts) if k >= 0] or sorted(rows.counts)
    held = [-1] if -1 in rows.counts else fit
    shapes, sizes = [p.shape for p in net.parameters()], [p.size for p in net.parameters()]
    adam, best, rng = Adam([*net.parameters(), head.coef], s.rate), (np.inf, None), np.random.default_rng(s.seed)
    for epoch in range(s.epochs):
        now = [p for p in phases if epoch >= math.ceil(p.since * s.epochs) - (p.since > 0)][-1]
        head.applied = now.applied
        moves = [*[now.network] * len(shapes), True if now.coef is None else np.array(now.coef, bool)]
        for k in rng.permutation(fit):
            flat = rows.total([int(k)], net, head, now.within)
            if not flat[-1]:
                continue
            pieces = np.split(flat[:-2] / flat[-1], np.cumsum(sizes))
            grads = [g.reshape(shape) for g, shape in zip(pieces, shapes, strict=False)]
            if s.group_lasso:
                grads[0] = grads[0] + s.group_lasso * _group_slope(net.layers[0][0], s.group_share)
            adam.step([*grads, pieces[-1]], moves)
        *_, error, n = rows.total(held, net, head)
        if error / n < best[0]:
            best = (error / n, ([(w.copy(), b.copy()) for w, b in net.layers], head.coef.copy(), head.applied))
    if best[1]:
        net.layers, head.coef, head.applied = best[1]


class Curve:
    """What limited-memory BFGS knows of the error's curvature: the latest moves and what they changed in the gradient."""

    def __init__(self, memory: int) -> None:
        self.memory, self.pairs = memory, []

    def learn(self, move: np.ndarray, change: np.ndarray) -> None:
        if move @ change > 1e-10 * (change @ change):  # else the curve bends the wrong way there
            self.pairs = [*self.pairs, (move, change)][-self.memory :]

    def direction(self, slope: np.ndarray) -> np.ndarray:
        """Downhill, by the two loops over the pairs."""
        q, shares = slope.copy(), []
        for move, change in reversed(self.pairs):
            shares.append((move @ q) / (move @ change))
            q -= shares[-1] * change
        if self.pairs:
            move, change = self.pairs[-1]
            q *= (move @ change) / (change @ change)
        for (move, change), share in zip(self.pairs, reversed(shares), strict=True):
            q += move * (share - (change @ q) / (move @ change))
        return -q


def train_by_curve(rows: Held | Stored, net: Network, head: Head, s: Setup, phases: Sequence[Phase] = (Phase(),)) -> list[float]:
    """As ``train``, by limited-memory BFGS on the gradient of all rows; the error on the rows fitted on, before each step and at the end."""
    fit = [k for k in sorted(rows.counts) if k >= 0] or sorted(rows.counts)
    held = [-1] if -1 in rows.counts else fit
    parameters = [*net.parameters(), head.coef]
    cuts = np.cumsum([p.size for p in parameters])

    def put(flat: np.ndarray) -> None:
        for p, new in zip(parameters, np.split(flat, cuts), strict=False):
            p[...] = new.reshape(p.shape)

    def look(flat: np.ndarray, on: np.ndarray, within: float) -> tuple[float, np.ndarray]:
        """The error and its slope, 0 along what is not trained."""
        put(flat)
        *sums_, error, n = rows.total(fit, net, head, within)
        n = max(n, 1)
        error, slope = error / n, np.array(sums_) / n
        if s.group_lasso:
            w = net.layers[0][0]
            error += s.group_lasso * float(group_penalty(w, s.group_share).sum())
            slope[: w.size] += s.group_lasso * _group_slope(w, s.group_share).ravel()
        return error, slope * on

    now, errors, best = np.concatenate([p.ravel() for p in parameters]), [], (np.inf, None, True)
    starts = [math.ceil(p.since * s.epochs) - (p.since > 0) for p in phases]
    for phase, first, last in zip(phases, starts, [*starts[1:], s.epochs], strict=True):
        head.applied = phase.applied
        on = np.concatenate([*(np.full(p.size, float(phase.network)) for p in net.parameters()), np.ones(head.coef.size) if phase.coef is None else np.array(phase.coef, float)])
        curve, (error, slope) = Curve(s.memory), look(now, on, phase.within)
        for _ in range(last - first):
            errors.append(error)
            way = curve.direction(slope)
            if way @ slope >= 0:
                curve, way = Curve(s.memory), -slope
            size = 1.0 if curve.pairs else min(1.0, 1 / max(np.abs(slope).sum(), 1e-300))
            for _ in range(s.halvings):
                there = now + size * way
                new_error, new_slope = look(there, on, phase.within)
                if new_error <= error + 1e-4 * size * (way @ slope):
                    break
                size /= 2
            else:
                break  # no way down that is worth a step
            curve.learn(there - now, new_slope - slope)
            now, error, slope = there, new_error, new_slope
            *_, miss, n = rows.total(held, net, head) if held != fit else (error, 1)
            if miss / n < best[0]:
                best = (miss / n, now.copy(), head.applied)
        errors.append(error)
    if best[1] is not None:
        now, head.applied = best[1], best[2]
    put(now)
    return errors


@dataclass
class Fitted:
    """A network with what normalizes its columns."""

    net: Network
    x_bias: np.ndarray
    x_scale: np.ndarray
    y_bias: float
    y_scale: float
    head: Head = field(default_factory=Head)

    def __call__(self, x: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
        return self.head.value(self.net((x - self.x_bias) / self.x_scale), a) * self.y_scale + self.y_bias


def fit(df: DataFrame, names: Sequence[str], y: str | Column, s: Setup, a: Sequence[str] = (), kind: str = "plain", coef: np.ndarray | None = None, phases: Sequence[Phase] = (Phase(),), create: Callable[..., Network] = Network.create, kept: dict | None = None) -> Fitted:
    """A network of the columns ``names``, made by ``create``, fitted to ``y`` on all rows.

    ``a``, ``kind`` and ``coef`` (the coefficients to start from, in y's units)
    make its head. A column of one value only is divided by 1. About
    ``train_share`` of the rows, by a hash, is trained on. Several fits on one
    ``df`` may share a dictionary ``kept``: a fit that reads the very columns of the
    one before then takes its rows from there, and they aren't sent or stored again.
    """
    target = (F.col(y) if isinstance(y, str) else y).cast("double")
    columns = [*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)], target.alias("_y")]
    raw = df.select(*columns, *[F.col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(a)])
    keys = [*[f"_x{i}" for i in range(len(names))], "_y"]
    row = raw.agg(F.count(F.lit(1)), *[F.avg(c) for c in keys], *[F.stddev_samp(c) for c in keys]).first()
    if not row[0]:
        raise ValueError("no rows to fit on")
    bias = np.array([v or 0.0 for v in row[1 : 1 + len(keys)]], float)
    scale = np.array([v if v and v > 0 else 1.0 for v in row[1 + len(keys) :]], float)
    share = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), *raw.columns), F.lit(n))
    steps = min(s.steps, max(1, math.ceil(row[0] * s.train_share / s.batch)))
    step = F.when(share(s.seed, 1 << 30) >= int(s.train_share * (1 << 30)), -1).otherwise(share(s.seed + 1, steps)).cast("int")
    scaled = {c: (F.col(c) - F.lit(float(m))) / F.lit(float(d)) for c, m, d in zip(keys, bias, scale, strict=True)}
    rows = raw.withColumn("_step", step).withColumns(scaled)
    head = Head(kind, np.zeros(0) if coef is None else np.asarray(coef, float) / scale[-1])
    net = create(len(names), 1 if kind == "plain" else len(a) - (0 if coef is None or len(coef) == len(a) else len(coef)), s, np.random.default_rng(s.seed))
    what = (tuple(names), str(target), tuple(a), s.seed, steps, s.train_share, row[0] <= s.bound)
    if kept and "rows" in kept and kept["what"] == what:
        held, bias, scale = kept["rows"], *kept["norms"]
        head.coef = head.coef if coef is None else np.asarray(coef, float) / scale[-1]
    else:
        release(kept)
        held = Held(rows) if row[0] <= s.bound else Stored(rows)
        if kept is not None:
            kept |= {"rows": held, "what": what, "norms": (bias, scale)}
    try:
        {"adam": train, "lbfgs": train_by_curve}[s.optimizer](held, net, head, s, phases)
    finally:
        if kept is None:
            held.close()
    return Fitted(net, bias[:-1], scale[:-1], float(bias[-1]), float(scale[-1]), head)


def release(kept: dict | None) -> None:
    """Lets go of the rows that fits have shared."""
    if kept and "rows" in kept:
        kept.pop("rows").close()


def fit_columns(df: DataFrame, names: Sequence[str], y: str, s: Setup) -> Fitted:
    return fit(df, names, y, s)


def predict_columns(df: DataFrame, names: Sequence[str], model: Fitted, out: str = "y_hat") -> DataFrame:
    """``df`` with the prediction: batches go through the network in numpy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model(b[list(names)].to_numpy(float))})

    return df.mapInPandas(run, df.selectExpr("*", f"cast(0 as double) as {out}").schema)


def shapley(df: DataFrame, key: str, names: Sequence[str], model: Fitted, draws: int = 10, seed: int = 2) -> DataFrame:
    """feature and importance: mean magnitude of Shapley effects by random orders against the mean row."""
    base = np.array([v or 0.0 for v in df.agg(*[F.avg(c) for c in names]).first()], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, total = b[list(names)].to_numpy(float), np.zeros((len(b), len(names)))
            for d in range(draws):
                now = np.tile(base, (len(b), 1))
                before = model(now)
                for j in np.random.default_rng(seed + d).permutation(len(names)):
                    now[:, j] = x[:, j]
                    after = model(now)
                    total[:, j] += after - before
                    before = after
            yield pd.DataFrame({"feature": np.tile(list(names), len(b)), "effect": (total / draws).ravel()})

    effects = df.select(key, *names).mapInPandas(run, "feature string, effect double")
    return effects.groupBy("feature").agg(F.avg(F.abs("effect")).alias("importance")).orderBy(F.desc("importance"))


def morris(spark: SparkSession, ranges: dict[str, tuple[float, float]], model: Callable[[np.ndarray], np.ndarray], trajectories: int = 10, levels: int = 4, seed: int = 2) -> DataFrame:
    """feature, mu, mu_star and sigma: mean, mean magnitude and deviation of the elementary effects along random trajectories.

    A trajectory starts on a grid of ``levels`` places a feature and moves every
    feature once, in a random order, by levels / (2 (levels - 1)) of its range. An
    effect is the model's change by a whole range. A feature without a range has
    effects of 0.
    """
    names = list(ranges)
    low, high = (np.array([ranges[c][k] or 0.0 for c in names], float) for k in (0, 1))
    move = levels / (2 * (levels - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"]:
                rng = np.random.default_rng([seed, int(t)])
                # from the lower half up, or from the upper half down
                way = rng.choice([-1.0, 1.0], len(names))
                start = rng.integers(0, levels // 2, len(names)) / (levels - 1)
                at = np.where(way > 0, start, 1 - start)
                order, path = rng.permutation(len(names)), [at.copy()]
                for j in order:
                    at[j] += way[j] * move
                    path.append(at.copy())
                y = model(low + np.array(path) * (high - low))
                yield pd.DataFrame({"feature": [names[j] for j in order], "effect": np.diff(y) / (way[order] * move)})

    effects = spark.range(trajectories).mapInPandas(run, "feature string, effect double")
    return effects.groupBy("feature").agg(F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.stddev_samp("effect").alias("sigma"))


def trajectory_effects(df: DataFrame, names: Sequence[str], model: Callable[[np.ndarray], np.ndarray], trajectories: int = 10, levels: int = 4, seed: int = 2) -> DataFrame:
    """``morris`` over the ranges of the columns ``names``."""
    r = df.agg(*[F.min(c).cast("double") for c in names], *[F.max(c).cast("double") for c in names]).first()
    return morris(df.sparkSession, {c: (r[i], r[len(names) + i]) for i, c in enumerate(names)}, model, trajectories, levels, seed)


def elementary_effects(df: DataFrame, key: str, names: Sequence[str], model: Fitted, share: float = 0.1) -> DataFrame:
    """feature and mean_effect: the prediction's mean change, by unit, as each feature moves by a share of its range."""
    r = df.agg(*[F.max(c) - F.min(c) for c in names]).first()
    move = np.array([(v or 0.0) * share or 1.0 for v in r])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(names)].to_numpy(float)
            at = model(x)
            moved = [(model(x + np.eye(len(names))[j] * move[j]) - at) / move[j] for j in range(len(names))]
            yield pd.DataFrame({"feature": np.repeat(list(names), len(b)), "effect": np.concatenate(moved)})

    return df.select(key, *names).mapInPandas(run, "feature string, effect double").groupBy("feature").agg(F.avg("effect").alias("mean_effect"))
