"""Linear models from one aggregate of moments: regression, partial least squares, normalization, rotation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Sums over rows: enough to fit any linear model of the columns."""

    n: int
    sum_x: np.ndarray
    sum_y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @property
    def cov_xx(self) -> np.ndarray:
        return (self.xx - np.outer(self.sum_x, self.sum_x) / self.n) / (self.n - 1)

    @property
    def cov_xy(self) -> np.ndarray:
        return (self.xy - self.sum_x * self.sum_y / self.n) / (self.n - 1)


def moments(df: DataFrame, x: Sequence[str], y: str) -> Moments:
    """One pass over the rows, with partial sums in each task; the result has k x k numbers."""
    names = [*x, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    value = [F.col(c).cast("double") for c in names]
    sums = [F.sum(v) for v in value] + [F.sum(value[i] * value[j]) for i, j in pairs]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    k, s, full = len(x), np.array([v or 0.0 for v in row[1 : 1 + len(names)]]), np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[1 + len(names) :], strict=True):
        full[i, j] = full[j, i] = v or 0.0
    return Moments(row[0], s[:k], float(s[k]), full[:k, :k], full[:k, k], float(full[k, k]))


def solve_ridge(m: Moments, ridge: float = 0.0) -> np.ndarray:
    """(X'X + ridge I)^-1 X'y; no intercept is spared."""
    a = m.xx + ridge * np.eye(len(m.xy))
    try:
        return np.linalg.solve(a, m.xy)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, m.xy, rcond=None)[0]


def ridge(df: DataFrame, x: Sequence[str], y: str, penalty: float = 0.0) -> np.ndarray:
    return solve_ridge(moments(df, x, y), penalty)


def predict(x: Sequence[Column], coef: Sequence[float], bias: float = 0.0, y_bias: float = 0.0, y_scale: float = 1.0) -> Column:
    """The linear prediction, brought back from normalized units."""
    out = F.lit(float(bias))
    for c, k in zip(x, coef, strict=True):
        out = out + c * float(k)
    return out * float(y_scale) + float(y_bias)


NORMS = ("standardize", "normalize", "scale", "none")


def norm_stats(df: DataFrame, names: Sequence[str], kind: str = "standardize", exempt: Sequence[str] = ()) -> dict[str, tuple[float, float]]:
    """(bias, scale) of each column: z-score, min-max, largest magnitude or none."""
    if kind not in NORMS:
        raise ValueError(f"unknown normalization {kind}")
    todo = [c for c in names if c not in exempt and kind != "none"]
    out = {c: (0.0, 1.0) for c in names}
    if todo:
        pick: dict[str, Callable] = {
            "standardize": lambda c: (F.avg(c), F.stddev_samp(c)),
            "normalize": lambda c: (F.min(c), F.max(c) - F.min(c)),
            "scale": lambda c: (F.lit(0.0), F.max(F.abs(c))),
        }
        row = df.agg(*[v.cast("double") for c in todo for v in pick[kind](F.col(c))]).first()
        out |= {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(todo)}
    return out


def normalized(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns less their bias, over their scale; a scale of zero gives null."""
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(b), F.lit(s)) for c, (b, s) in stats.items()})


def denormalized(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(b) for c, (b, s) in stats.items()})


def partial_least_squares(m: Moments, components: int) -> np.ndarray:
    """Coefficients (of centred columns) with 1 ... ``components`` components, a row each."""
    cxx, cyx = m.cov_xx.copy(), m.cov_xy.copy()
    us, ps, qs, out = [], [], [], []
    for _ in range(components):
        norm = np.linalg.norm(cyx)
        if norm < 1e-300:
            out.append(out[-1] if out else np.zeros(len(cyx)))
            continue
        u = cyx / norm
        spread = u @ cxx @ u
        p, q = cxx @ u / spread, cyx @ u / spread
        keep = np.eye(len(u)) - np.outer(p, u)
        cxx, cyx = keep @ cxx, cyx - q * spread * p
        us, ps, qs = [*us, u], [*ps, p], [*qs, q]
        uu, pp = np.stack(us, 1), np.stack(ps, 1)
        out.append(uu @ np.linalg.solve(pp.T @ uu, np.array(qs)))
    return np.stack(out)


def elastic_net(m: Moments, alpha: float = 0.99, penalty: float = 0.01, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) by coordinate descent on the moments of standardized columns.

    The objective is half the mean squared error plus penalty * (alpha |b| + (1 - alpha) b^2 / 2).
    """
    sx = np.sqrt(np.maximum(np.diag(m.cov_xx) * (m.n - 1) / m.n, 1e-300))
    c, g = (m.cov_xx * (m.n - 1) / m.n) / np.outer(sx, sx), (m.cov_xy * (m.n - 1) / m.n) / sx
    b = np.zeros(len(g))
    for _ in range(rounds):
        was = b.copy()
        for j in range(len(b)):
            rho = g[j] - c[j] @ b + c[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - penalty * alpha, 0) / (c[j, j] + penalty * (1 - alpha))
        if np.max(np.abs(b - was), initial=0) < 1e-10:
            break
    coef = b / sx
    return coef, float((m.sum_y - m.sum_x @ coef) / m.n)


def whitening(m: Moments, share: float = 1.0) -> np.ndarray:
    """Columns that whiten centred data: as many as keep ``share`` of the summed square-rooted variances."""
    u, s, _ = np.linalg.svd(m.cov_xx)
    root = np.sqrt(np.maximum(s, 0))
    k = int(np.searchsorted(np.cumsum(root) / root.sum(), share - 1e-12) + 1)
    k = min(k, int((s > 1e-12 * s[0]).sum()))
    return u[:, :k] / np.sqrt(s[:k])


def kernel_ridge(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(weights, predictor) of kernel ridge regression on a bounded set; the kernel is 1 + x x' by default."""
    kernel = kernel or (lambda a, b: 1 + a @ b.T)
    weights = np.linalg.solve(kernel(x, x) + penalty * np.eye(len(x)), y)
    return weights, lambda new: kernel(new, x) @ weights


def kernel_ridge_moments(m: Moments, penalty: float = 0.5) -> np.ndarray:
    """The same fit with the default kernel from moments alone, for any number of rows: (intercept, coefficients).

    The kernel 1 + x x' is ridge regression on the columns and a column of ones.
    """
    a = np.block([[np.array([[m.n]]), m.sum_x[None]], [m.sum_x[:, None], m.xx]])
    return np.linalg.solve(a + penalty * np.eye(len(a)), np.append(m.sum_y, m.xy))


def best_rotation(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The rotation R that brings vectors ``a`` closest to ``b`` (both centred), from nine cross sums."""
    names = [*a, *b]
    sums = [F.count(F.lit(1)), *[F.sum(F.col(c).cast("double")) for c in names], *[F.sum(F.col(i).cast("double") * F.col(j).cast("double")) for i in a for j in b]]
    row = df.agg(*sums).first()
    n, mean = row[0], np.array(row[1:7]) / row[0]
    h = np.array(row[7:]).reshape(3, 3) - n * np.outer(mean[:3], mean[3:])
    u, _, vt = np.linalg.svd(h)
    flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    return vt.T @ flip @ u.T


def rotated(df: DataFrame, names: Sequence[str], r: np.ndarray) -> DataFrame:
    v = [F.col(c) for c in names]
    return df.withColumns({c: sum((float(r[i, j]) * v[j] for j in (1, 2)), float(r[i, 0]) * v[0]) for i, c in enumerate(names)})


def unpacked_norms(norms: Sequence) -> tuple:
    """(A bias, A scale, rotation of x, x bias, x scale, y bias, y scale) of four to seven of them: matrix A's pair and the rotation may be absent."""
    norms = tuple(norms)
    if not 4 <= len(norms) <= 7:
        raise ValueError(f"{len(norms)} normalizations, not 4 to 7")
    a, rest = (norms[:2], norms[2:]) if len(norms) > 5 else ((0, 1), norms)
    turn, rest = (rest[0], rest[1:]) if len(rest) == 5 else (np.eye(np.atleast_2d(rest[1]).shape[1]), rest)
    return (*a, turn, *rest)
