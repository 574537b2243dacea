"""Tolles-Lawson aeromagnetic compensation: design matrix columns, coefficients and their algebra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.operators import linear
from fluxlane.operators.select import Order
from fluxlane.operators.sequence import bandpass, difference

SCALE = 50000.0
_AXES = "xyz"
_UPPER = [(i, j) for i in range(3) for j in range(i, 3)]
_ALL = [(i, j) for i in range(3) for j in range(3)]
_DIAGONAL = [(i, i) for i in range(3)]
#: Groups in the order of their columns, whatever order terms are given in: names and index pairs.
GROUPS = (
    (("permanent", "p", "permanent3", "p3"), "p", [(i, None) for i in range(3)]),
    (("induced", "i", "induced6", "i6"), "i", _UPPER),
    (("induced5", "i5"), "i", _UPPER[:-1]),
    (("induced3", "i3"), "i", _DIAGONAL),
    (("eddy", "e", "eddy9", "e9"), "e", _ALL),
    (("eddy8", "e8"), "e", _ALL[:-1]),
    (("eddy3", "e3"), "e", _DIAGONAL),
    (("fdm", "f", "fdm3", "f3"), "f", [(i, None) for i in range(3)]),
    (("bias", "b"), "b", [(None, None)]),
)


def chosen(terms: Sequence[str]) -> list[tuple[str, list[tuple]]]:
    """(kind, index pairs) of the terms' groups, in column order."""
    known = {n for names, _, _ in GROUPS for n in names}
    if not terms or set(terms) - known:
        raise ValueError(f"unknown or no terms: {sorted(set(terms) - known)}")
    return [(kind, pairs) for names, kind, pairs in GROUPS if set(names) & set(terms)]


def columns(terms: Sequence[str]) -> list[str]:
    """Names of the design matrix columns."""
    label = {"p": "p", "i": "i", "e": "e", "f": "f", "b": "bias"}
    return [label[kind] + "".join(f"_{_AXES[k]}" for k in pair if k is not None) for kind, pairs in chosen(terms) for pair in pairs]


def with_matrix(df: DataFrame, order: Order, x: str, y: str, z: str, terms: Sequence[str] = ("permanent", "induced", "eddy"), total: Column | None = None, scale: float = SCALE) -> DataFrame:
    """The design matrix as columns beside ``df``'s.

    ``total`` may stand in for the length of the vector, as a scalar sensor or
    a map value does. All columns come from one window over the sequence.
    """
    b = [F.col(c).cast("double") for c in (x, y, z)]
    wide = df.withColumns({f"_b{k}": v for k, v in zip(_AXES, b, strict=True)} | {f"_d{k}": difference(v, order) for k, v in zip(_AXES, b, strict=True)})
    wide = wide.withColumn("_t", F.sqrt(F.col("_bx") ** 2 + F.col("_by") ** 2 + F.col("_bz") ** 2) if total is None else total)
    field, change = [F.col(f"_b{k}") for k in _AXES], [F.col(f"_d{k}") for k in _AXES]
    unit = [F.try_divide(v, F.col("_t")) for v in field]
    make = {"p": lambda i, _: unit[i], "i": lambda i, j: unit[i] * field[j] / scale, "e": lambda i, j: unit[i] * change[j] / scale, "f": lambda i, _: change[i], "b": lambda *_: F.lit(1.0)}
    values = [make[kind](*pair) for kind, pairs in chosen(terms) for pair in pairs]
    return wide.withColumns(dict(zip(columns(terms), values, strict=True))).drop("_t", *[f"_{s}{k}" for s in "bd" for k in _AXES])


def fit(df: DataFrame, order: Order, x: str, y: str, z: str, scalar: str, terms: Sequence[str] = ("permanent", "induced", "eddy"), ridge: float = 0.0, band: tuple[float, float] = (0.1, 0.9), fs: float = 10.0, trim: int = 20) -> tuple[np.ndarray, float]:
    """(coefficients, residual variance): ridge regression of the filtered sensor on the filtered matrix.

    The filter runs along each sequence; the fit is one aggregate of moments.
    Filter and trimming are left out if neither cut-off lies in (0, fs / 2).
    """
    wide, names = with_matrix(df, order, x, y, z, terms), columns(terms)
    if any(0 < f < fs / 2 for f in band):
        wide = bandpass(wide, order, [*names, scalar], *band, fs=fs)
        numbered = wide.withColumn("_rn", F.row_number().over(order.window)).withColumn("_n", F.count(F.lit(1)).over(order.whole))
        wide = numbered.filter((F.col("_rn") > trim) & (F.col("_rn") <= F.col("_n") - trim))
    m = linear.moments(wide, names, scalar)
    coef = linear.solve_ridge(m, ridge)
    residual = m.yy - 2 * coef @ m.xy + coef @ m.xx @ coef
    mean = (m.sum_y - coef @ m.sum_x) / max(m.n, 1)
    return coef, float((residual - m.n * mean**2) / max(m.n - 1, 1))


def term_mask(term: str, terms: Sequence[str]) -> np.ndarray:
    """Which coefficients belong to a term."""
    want = chosen([term])[0]
    return np.concatenate([np.full(len(pairs), (kind, pairs) == want) for kind, pairs in chosen(terms)])


def split_parts(coef: Sequence[float], terms: Sequence[str]) -> dict[str, np.ndarray]:
    """Coefficients by kind: p, i, e (and f, b); a kind that is absent is empty."""
    out, at = {k: np.zeros(0) for k in "piefb"}, 0
    for kind, pairs in chosen(terms):
        out[kind], at = np.asarray(coef[at : at + len(pairs)], float), at + len(pairs)
    return out


def to_matrices(coef: Sequence[float], terms: Sequence[str], total_scale: float = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(permanent vector, symmetric induced matrix, eddy matrix) of a coefficient vector."""
    parts, by = split_parts(coef, terms), dict(chosen(terms))
    p, induced, eddy = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 3))
    if len(parts["p"]):
        p = parts["p"].copy()
    for (i, j), c in zip(by.get("i", []), parts["i"], strict=True):
        # what is off the diagonal is shared by both places
        induced[i, j] += c / total_scale / (1 if i == j else 2)
        if i != j:
            induced[j, i] += c / total_scale / 2
    for (i, j), c in zip(by.get("e", []), parts["e"], strict=True):
        eddy[i, j] = c / total_scale
    return p, induced, eddy


def to_vector(p: np.ndarray, induced: np.ndarray, eddy: np.ndarray, terms: Sequence[str], total_scale: float = SCALE) -> np.ndarray:
    """Inverse of :func:`to_matrices`."""
    make = {"p": lambda i, _: p[i], "i": lambda i, j: (induced[i, j] if i == j else induced[i, j] + induced[j, i]) * total_scale, "e": lambda i, j: eddy[i, j] * total_scale}
    return np.array([make[kind](*pair) for kind, pairs in chosen(terms) for pair in pairs if kind in make], float)


def aircraft_field(field: list[Column], change: list[Column], p: np.ndarray, induced: np.ndarray, eddy: np.ndarray) -> list[Column]:
    """The aircraft's own field, p + I B + E dB, as three columns."""

    def row(i: int) -> Column:
        out = F.lit(float(p[i]))
        for j in range(3):
            out = out + float(induced[i, j]) * field[j] + float(eddy[i, j]) * change[j]
        return out

    return [row(i) for i in range(3)]
