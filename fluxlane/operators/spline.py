"""Smooth interpolation of map grids of any size by quadratic and cubic B-splines.

A spline through a grid's values has one coefficient a node and one more beyond
each edge, where it is straight (no second derivative). The coefficients are solved
for along strips of rows, then of columns (``blocks.along_both``), and are a table
themselves: a point needs a patch of 3 x 3 or 4 x 4 of them. Patches are packed by
two windows, so that a point meets one row of an equi-join. Slopes come from the
same patch; the vertical derivative of a map is a map of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlane.operators import blocks, spectral
from fluxlane.operators.blocks import Sides
from fluxlane.operators.grid import Axes

#: Nodes of a patch along an axis, by kind.
NODES = {"quadratic": 3, "cubic": 4}


def coefficients(y: np.ndarray, kind: str = "cubic") -> np.ndarray:
    """B-spline coefficients along the first axis, one more at each end, of the spline through ``y``."""
    middle, scale = {"quadratic": (6.0, 8.0), "cubic": (4.0, 6.0)}[kind]
    y = np.asarray(y, float)
    n = len(y)
    if n == 1:
        return np.repeat(y, 3, 0)
    c = np.zeros((n + 2, *y.shape[1:]))
    # straight ends make the end nodes' coefficients their values
    c[1], c[n] = y[0], y[-1]
    if n > 2:
        right = scale * y[1:-1]
        right[0] -= c[1]
        right[-1] -= c[n]
        pivot = np.full(n - 2, middle)
        for i in range(1, n - 2):
            pivot[i] -= 1 / pivot[i - 1]
            right[i] -= right[i - 1] / pivot[i - 1]
        c[n - 1] = right[-1] / pivot[-1]
        for i in range(n - 4, -1, -1):
            c[i + 2] = (right[i] - c[i + 3]) / pivot[i]
    c[0], c[n + 1] = 2 * c[1] - c[2], 2 * c[n] - c[n - 1]
    return c


def coefficient_table(grid: DataFrame, kind: str = "cubic", by: Sequence[str] = ("map_name",), cells: int = blocks.CELLS) -> DataFrame:
    """``by``, iy, ix and coef of each level of ``grid``; rows and columns begin one before the grid's and end one behind."""
    kinds = dict(grid.dtypes)

    def first(head: dict, values: np.ndarray, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, coefficients(values.T, kind).T

    def second(head: dict, variant: int, values: np.ndarray, at: int, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, coefficients(values, kind)

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        iy, ix = np.indices(stack[0].shape)
        return pd.DataFrame(head | {"iy": (iy + at + sides.iy0 - 1).ravel().astype(np.int32), "ix": (ix + sides.ix0 - 1).ravel().astype(np.int32), "coef": stack[0].ravel()})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "iy int, ix int, coef double"])
    return blocks.along_both(grid, by, first, second, finish, schema, float, cells)


def weights(u: Column, kind: str) -> tuple[list[Column], list[Column]]:
    """The weights of a patch's nodes along an axis and their derivatives; ``u``: distance from the patch's second node."""
    if kind == "quadratic":
        return [(u - 0.5) ** 2 / 2, 0.75 - u * u, (u + 0.5) ** 2 / 2], [u - 0.5, -2 * u, u + 0.5]
    v = 1 - u
    return [v * v * v / 6, (3 * u - 6) * u * u / 6 + 2 / 3, ((-3 * u + 3) * u + 3) * u / 6 + 1 / 6, u * u * u / 6], [-v * v / 2, (1.5 * u - 2) * u, (-1.5 * u + 1) * u + 0.5, u * u / 2]


def _place(f: Column, first: int, n: int, kind: str) -> Column:
    """Number of the node that a patch's second node is, for places inside."""
    if kind == "quadratic":
        return F.least(F.floor(f + 0.5), F.lit(first + n - 1)).cast("int")
    return F.least(F.floor(f), F.lit(first + max(n - 2, 0))).cast("int")


def lookup(points: DataFrame, coefs: DataFrame, a: Axes, kind: str = "cubic", x: str = "lon", y: str = "lat", out: str = "map_val", by: Sequence[str] = (), slopes: bool = False) -> DataFrame:
    """The spline's value at each point, null outside the grid; with ``slopes`` also ``out``_by_x and ``out``_by_y.

    ``coefs``: as by ``coefficient_table``, of the grid whose axes are ``a``;
    ``by``: columns of both that tell grids on the same axes apart.
    """
    nodes = range(1, NODES[kind])
    across, up = Window.partitionBy(*by, "iy").orderBy("ix"), Window.partitionBy(*by, "ix").orderBy("iy")
    rows = coefs.select(*by, "iy", "ix", F.array("coef", *[F.lead("coef", k).over(across) for k in nodes]).alias("_row"))
    patches = rows.select(*by, (F.col("iy") + 1).alias("_iy"), (F.col("ix") + 1).alias("_ix"), F.array("_row", *[F.lead("_row", k).over(up) for k in nodes]).alias("_patch"))
    fx, fy = (F.col(x) - a.x0) / (a.dx or 1.0), (F.col(y) - a.y0) / (a.dy or 1.0)
    inside = (fx >= a.ix0) & (fx <= a.ix0 + a.nx - 1) & (fy >= a.iy0) & (fy <= a.iy0 + a.ny - 1)
    placed = points.withColumns({"_ix": F.when(inside, _place(fx, a.ix0, a.nx, kind)), "_iy": F.when(inside, _place(fy, a.iy0, a.ny, kind))})
    placed = placed.withColumns({"_u": fx - F.col("_ix"), "_v": fy - F.col("_iy")})
    hit = placed.join(patches, [*by, "_iy", "_ix"], "left")
    (wx, sx), (wy, sy) = weights(F.col("_u"), kind), weights(F.col("_v"), kind)
    # sums along x once a row of the patch
    along = {"_ax": wx} | ({"_sx": sx} if slopes else {})
    for name, w in along.items():
        sums = []
        for i in range(NODES[kind]):
            row = [w[j] * F.col("_patch")[i][j] for j in range(NODES[kind])]
            sums.append(sum(row[1:], row[0]))
        hit = hit.withColumn(name, F.array(*sums))
    over = lambda w, name: sum([w[i] * F.col(name)[i] for i in range(1, NODES[kind])], w[0] * F.col(name)[0])
    found = {out: over(wy, "_ax")}
    if slopes:
        found |= {f"{out}_by_x": over(wy, "_sx") / (a.dx or 1.0), f"{out}_by_y": over(sy, "_ax") / (a.dy or 1.0)}
    # a point that has no patch has no weight either
    return hit.withColumns({k: F.when(F.col("_patch").isNotNull(), v) for k, v in found.items()}).select(*points.columns, *found)


def interpolated(points: DataFrame, grid: DataFrame, a: Axes, kind: str = "cubic", x: str = "lon", y: str = "lat", out: str = "map_val", slopes: bool = False) -> DataFrame:
    """The value of the spline through one map at each point."""
    return lookup(points, coefficient_table(grid, kind), a, kind, x, y, out, (), slopes)


def interpolated_levels(points: DataFrame, stack: DataFrame, a: Axes, kind: str = "cubic", x: str = "lon", y: str = "lat", z: str = "alt", out: str = "map_val") -> DataFrame:
    """The value of the spline through a stack of evenly spaced levels (``alt``) at each point, null outside it.

    Levels are few: along them, coefficients are sums of a cell's levels, with
    weights from the inverse of the spline's equations.
    """
    levels = [float(r[0]) for r in stack.select("alt").distinct().orderBy("alt").collect()]  # a row a level
    if not levels:
        return points.withColumn(out, F.lit(None).cast("double"))
    step = (levels[-1] - levels[0]) / max(len(levels) - 1, 1) or 1.0
    inverse = coefficients(np.eye(len(levels)), kind)
    sums = [F.sum(sum((F.when(F.col("alt") == v, float(w)).otherwise(0.0) for v, w in zip(levels[1:], row[1:], strict=True)), F.when(F.col("alt") == levels[0], float(row[0])).otherwise(0.0)) * F.col("val")) for row in inverse]
    cells = stack.groupBy("iy", "ix").agg(F.first("yy").alias("yy"), F.first("xx").alias("xx"), F.array(*sums).alias("_sums")).select("iy", "ix", "yy", "xx", F.posexplode("_sums").alias("_level", "val"))
    table = coefficient_table(cells, kind, ["_level"])
    f = (F.col(z) - levels[0]) / step
    inside = (f >= 0) & (f <= len(levels) - 1)
    placed = points.withColumn("_base", F.when(inside, _place(f, 0, len(levels), kind))).withColumn("_w", f - F.col("_base"))
    wz, _ = weights(F.col("_w"), kind)
    names = [f"_z{j}" for j in range(NODES[kind])]
    for j, name in enumerate(names):
        placed = lookup(placed.withColumn("_level", F.col("_base") + j), table, a, kind, x, y, name, ["_level"]).drop("_level")
    value = sum((w * F.col(n) for w, n in zip(wz[1:], names[1:], strict=True)), wz[0] * F.col(names[0]))
    return placed.withColumn(out, value).select(*points.columns, out)


def vertical_derivative(grid: DataFrame, rise: float = 1.0, cells: int = blocks.CELLS) -> DataFrame:
    """The change of each map (map_name, alt) when it is continued ``rise`` up."""
    steps = spectral.Continued(lambda head: [(rise, 0.0)])

    def first(head: dict, values: np.ndarray, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield from steps.first(head, values, sides)
        yield 1, values

    def second(head: dict, variant: int, values: np.ndarray, at: int, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield from ((1, values),) if variant else steps.second(head, 0, values, at, sides)

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        return blocks.cells_of({"map_name": head["map_name"], "alt": head["alt"]}, at, steps.last(head, 0, stack[0], sides) - stack[1].real, sides)

    return blocks.along_both(grid, ["map_name", "alt"], first, second, finish, spectral.SCHEMA, cells=cells)
