"""Operators along both axes of map grids of any size.

A Fourier transform, a spline's prefilter or any other operator that acts along
the rows of a grid and then along its columns never needs the grid whole: a task
takes a strip of rows, then, after one exchange of tiles, a strip of columns, and
after another one strips of rows again. Strips hold about ``CELLS`` cells, or a
single row or column, so memory is bounded by a map's side, not its area. Tiles
travel packed, a row of bytes each, not cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a strip, about.
CELLS = 1 << 18


@dataclass(frozen=True)
class Sides:
    """A level's size, steps, first place and first cell, and how many rows and columns a strip has."""

    ny: int
    nx: int
    dy: float
    dx: float
    y0: float
    x0: float
    iy0: int
    ix0: int
    rows: int
    columns: int


_SIDES = tuple(Sides.__dataclass_fields__)

#: A strip and the level it is of, to numbered strips: rows to (variant, strip of as many rows).
First = Callable[[dict, np.ndarray, Sides], Iterable[tuple[int, np.ndarray]]]
#: A variant's strip of columns, from column number ``at`` on, to numbered strips of as many columns.
Second = Callable[[dict, int, np.ndarray, int, Sides], Iterable[tuple[int, np.ndarray]]]
#: All variants' strips of rows, from row number ``at`` on, to result rows.
Finish = Callable[[dict, int, dict[int, np.ndarray], Sides], pd.DataFrame]


def with_sides(grid: DataFrame, by: Sequence[str], cells: int) -> DataFrame:
    """Cells with their level's sides; levels that lie within each other's rows differ in ``by``."""
    step = lambda x, n: F.coalesce(F.nullif((F.max(x) - F.min(x)) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    ny, nx = (F.max(c) - F.min(c) + 1 for c in ("iy", "ix"))
    strip = lambda n: F.greatest(F.lit(1), F.floor(F.lit(cells) / n)).cast("int")
    values = {"ny": ny, "nx": nx, "dy": step("yy", ny), "dx": step("xx", nx), "y0": F.min("yy"), "x0": F.min("xx"), "iy0": F.min("iy"), "ix0": F.min("ix"), "rows": strip(nx), "columns": strip(ny)}
    sides = grid.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*[v.alias(f"_{k}") for k, v in values.items()])
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return grid.join(sides, same).drop(*[f"_by_{c}" for c in by])


def _sides(pdf: pd.DataFrame) -> Sides:
    return Sides(*(pdf[f"_{c}"].iloc[0] for c in _SIDES))


def _tiles(head: dict, sides: Sides, found: Iterable[tuple[int, np.ndarray]], at: int, by_column: bool, dtype: type) -> pd.DataFrame:
    """Numbered strips cut into tiles: of rows by strips of columns, or of columns by strips of rows."""
    out: list[tuple] = []
    for variant, strip in found:
        step = sides.columns if by_column else sides.rows
        for n, start in enumerate(range(0, strip.shape[1 if by_column else 0], step)):
            tile = strip[:, start : start + step] if by_column else strip[start : start + step]
            out.append((variant, n, at, tile.shape[0], tile.shape[1], np.ascontiguousarray(tile, dtype).tobytes()))
    pdf = pd.DataFrame(out, columns=["_variant", "_strip", "_at", "_height", "_width", "_cells"])
    return pdf.assign(**head, **{f"_{c}": getattr(sides, c) for c in _SIDES})


def along_both(grid: DataFrame, by: Sequence[str], first: First, second: Second, finish: Finish, schema: str, dtype: type = complex, cells: int = CELLS, more: Sequence[str] = ()) -> DataFrame:
    """The rows that ``finish`` makes of each level of ``grid`` (iy, ix, yy, xx, val and ``by``), after ``first`` along rows and ``second`` along columns.

    ``more``: columns of cells that ``first`` gets as strips behind the values.
    Cells that are absent are 0. Both steps must take zeros to zeros, as a strip
    without any cell is not looked at.
    """
    kinds = dict(grid.dtypes)
    levels = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    sizes = "_ny long, _nx long, _dy double, _dx double, _y0 double, _x0 double, _iy0 long, _ix0 long, _rows long, _columns long"
    tiles = f"{levels}, {sizes}, _variant int, _strip long, _at long, _height int, _width int, _cells binary"
    width = np.dtype(dtype).itemsize

    def head(pdf: pd.DataFrame) -> dict:
        return {c: pdf[c].iloc[0] for c in by}

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, strip = _sides(pdf), int(pdf["_strip"].iloc[0])
        at = strip * sides.rows
        place = pdf["iy"].to_numpy() - sides.iy0 - at, pdf["ix"].to_numpy() - sides.ix0
        strips = []
        for c in ("val", *more):
            strips.append(np.zeros((min(sides.rows, sides.ny - at), sides.nx)))
            strips[-1][place] = pdf[c].to_numpy(float)
        found = first(head(pdf), *strips, sides)
        return order(_tiles(head(pdf), sides, found, at, True, dtype))

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, strip, variant = _sides(pdf), int(pdf["_strip"].iloc[0]), int(pdf["_variant"].iloc[0])
        values = np.zeros((sides.ny, int(pdf["_width"].iloc[0])), dtype)
        for at, height, tile in zip(pdf["_at"], pdf["_height"], pdf["_cells"], strict=True):
            values[at : at + height] = np.frombuffer(tile, dtype).reshape(height, -1)
        at = strip * sides.columns
        return order(_tiles(head(pdf), sides, second(head(pdf), variant, values, at, sides), at, False, dtype))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, strip = _sides(pdf), int(pdf["_strip"].iloc[0])
        stack = {}
        for variant, part in pdf.sort_values("_at").groupby("_variant"):
            stack[int(variant)] = np.concatenate([np.frombuffer(x, dtype).reshape(h, len(x) // width // h) for h, x in zip(part["_height"], part["_cells"], strict=True)], 1)
        return finish(head(pdf), strip * sides.rows, stack, sides)

    names = [*by, *[f"_{c}" for c in _SIDES], "_variant", "_strip", "_at", "_height", "_width", "_cells"]
    order = lambda pdf: pdf[names]
    strips = with_sides(grid, by, cells).withColumn("_strip", F.floor((F.col("iy") - F.col("_iy0")) / F.col("_rows")))
    crosswise = strips.groupBy(*by, "_strip").applyInPandas(rows, tiles)
    back = crosswise.groupBy(*by, "_variant", "_strip").applyInPandas(columns, tiles)
    return back.groupBy(*by, "_strip").applyInPandas(last, schema)


def cells_of(head: dict, at: int, values: np.ndarray, sides: Sides, **more: object) -> pd.DataFrame:
    """A strip of rows as cells (iy, ix, yy, xx, val)."""
    iy, ix = np.indices(values.shape)
    iy += at
    places = {"iy": (iy + sides.iy0).ravel().astype(np.int32), "ix": (ix + sides.ix0).ravel().astype(np.int32), "yy": (sides.y0 + iy * sides.dy).ravel(), "xx": (sides.x0 + ix * sides.dx).ravel(), "val": values.ravel()}
    return pd.DataFrame(head | more | places) if values.size else pd.DataFrame(columns=[*head, *more, *places])

