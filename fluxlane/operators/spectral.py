"""Field continuation and spectra of map grids by two-dimensional Fourier transforms.

A transform runs along strips of rows, then along strips of columns, where filters
act and the way back begins, then along rows again (``blocks.along_both``), so
maps of any size do without a task that holds one. The functions of arrays say what
the distributed ones compute.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.operators import blocks
from fluxlane.operators.blocks import Sides

SCHEMA = "map_name string, alt double, iy int, ix int, yy double, xx double, val double"
#: Padding is never wider than this.
MOST_PAD = 5000


def smooth7(n: int) -> int:
    """The least number from n on whose prime factors are 7 or less."""
    while True:
        rest = n
        for p in (2, 3, 5, 7):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def wavenumbers(dx: float, dy: float, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, kx, ky) of a grid of ny rows and nx columns, in radians a unit of length."""
    kx, ky = np.meshgrid(2 * np.pi * np.fft.fftfreq(nx, dx), 2 * np.pi * np.fft.fftfreq(ny, dy))
    return np.hypot(kx, ky), kx, ky


def padding(n: int, pad: int) -> tuple[int, int]:
    """(places put in front, places in all) of an axis of ``n`` that gets ``pad`` places on each side or more."""
    total = smooth7(n + 2 * pad)
    return (total - n) // 2, total


def ramped(v: np.ndarray, before: int, total: int) -> np.ndarray:
    """Rows put in front of and behind ``v`` that run linearly from the last row over to the first."""
    gap = total - len(v)
    t = (np.arange(1, gap + 1) / (gap + 1))[:, None]
    ramp = v[-1] * (1 - t) + v[0] * t
    return np.concatenate([ramp[gap - before :], v, ramp[: gap - before]])


def expand(values: np.ndarray, pad: int = 1) -> tuple[np.ndarray, int, int]:
    """(padded grid of 7-smooth dimensions, rows and columns put in front). Edges run linearly into those across."""
    (py, my), (px, mx) = (padding(n, pad) for n in values.shape)
    return ramped(ramped(values, py, my).T, px, mx).T, py, px


def continued(values: np.ndarray, dx: float, dy: float, dz: float, alpha: float = 0.0, padded: bool = True) -> np.ndarray:
    """The field ``dz`` higher (or lower, then damped by ``alpha``; without it the grid comes back as it is)."""
    if dz == 0 or (dz < 0 and alpha == 0):
        return values.copy()
    ny, nx = values.shape
    py = px = 0
    wide = values
    if padded:
        wide, py, px = expand(values, pad_of(dz, dx, dy))
    k, _, _ = wavenumbers(dx, dy, wide.shape[1], wide.shape[0])
    return np.real(np.fft.ifft2(np.fft.fft2(wide) * continuation(k, dz, alpha)))[py : py + ny, px : px + nx]


def pad_of(dz: float, dx: float, dy: float) -> int:
    return min(MOST_PAD, int(np.ceil(10 * abs(dz) / min(abs(dx), abs(dy)))))


def continuation(k: np.ndarray, dz: float, alpha: float) -> np.ndarray:
    """The filter that carries a field ``dz`` up; down, damped by ``alpha``."""
    up = np.exp(-k * dz)
    return up / (1 + (alpha if dz < 0 else 0.0) * k**2 * up)


def vector_components(values: np.ndarray, dx: float, dy: float, declination: float, inclination: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, z) components of a scalar anomaly along a field direction; their means keep the scalar's."""
    ny, nx = values.shape
    f = np.fft.fft2(values)
    x, y, z = (np.real(np.fft.ifft2(f * h)) for h in direction_filters(*wavenumbers(dx, dy, nx, ny), declination, inclination))
    return x, y, z


def direction_filters(s: np.ndarray, u: np.ndarray, v: np.ndarray, declination: float, inclination: float) -> Iterator[np.ndarray]:
    """The filters from the field along a direction to its x, y and z components, at wavenumbers (whole, x, y)."""
    east, north, down = np.cos(inclination) * np.cos(declination), np.cos(inclination) * np.sin(declination), np.sin(inclination)
    below = 1j * (u * east + v * north) + down * s
    mean = s == 0
    for above in (1j * u, 1j * v, s.astype(complex)):
        yield np.where(mean, 1, above / np.where(mean, 1, below))


def spectrum(values: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(power, kx, ky)."""
    _, kx, ky = wavenumbers(dx, dy, values.shape[1], values.shape[0])
    return np.abs(np.fft.fft2(values)) ** 2, kx, ky


def damping_curve(values: np.ndarray, dx: float, dy: float, dz: float, alphas: Sequence[float]) -> list[float]:
    """Largest change of a downward continuation from each damping to the next; a dip marks a good one."""
    maps = [continued(values, dx, dy, dz, a) for a in alphas]
    diffs = [float(np.max(np.abs(b - a))) for a, b in zip(maps, maps[1:], strict=False)]
    return [*diffs, diffs[-1] if diffs else 0.0]


def _columns_of(sides: Sides, mx: int, my: int, at: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, kx, ky) of ``n`` columns from ``at`` on of a grid of mx columns and my rows."""
    kx, ky = np.meshgrid(2 * np.pi * np.fft.fftfreq(mx, sides.dx)[at : at + n], 2 * np.pi * np.fft.fftfreq(my, sides.dy))
    return np.hypot(kx, ky), kx, ky


class Continued:
    """The three steps of a continuation by several distances at once; ``moves``: (distance, damping) of a level, by its head."""

    def __init__(self, moves) -> None:
        self.moves = moves

    def _still(self, dz: float, alpha: float) -> bool:
        return dz == 0 or (dz < 0 and alpha == 0)

    def first(self, head: dict, values: np.ndarray, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        for n, (dz, alpha) in enumerate(self.moves(head)):
            if self._still(dz, alpha):
                yield n, values
            else:
                px, mx = padding(sides.nx, pad_of(dz, sides.dx, sides.dy))
                yield n, np.fft.fft(ramped(values.T, px, mx).T, axis=1)

    def second(self, head: dict, variant: int, values: np.ndarray, at: int, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        dz, alpha = self.moves(head)[variant]
        if not self._still(dz, alpha):
            pad = pad_of(dz, sides.dx, sides.dy)
            py, my = padding(sides.ny, pad)
            k, _, _ = _columns_of(sides, padding(sides.nx, pad)[1], my, at, values.shape[1])
            values = np.fft.ifft(np.fft.fft(ramped(values, py, my), axis=0) * continuation(k, dz, alpha), axis=0)[py : py + sides.ny]
        yield variant, values

    def last(self, head: dict, variant: int, strip: np.ndarray, sides: Sides) -> np.ndarray:
        """A strip of rows of the continued field."""
        dz, alpha = self.moves(head)[variant]
        if self._still(dz, alpha):
            return strip.real
        px, _ = padding(sides.nx, pad_of(dz, sides.dx, sides.dy))
        return np.fft.ifft(strip, axis=1).real[:, px : px + sides.nx]


def continue_map(grid: DataFrame, altitudes: Sequence[float], alpha: float = 0.0, cells: int = blocks.CELLS) -> DataFrame:
    """Each map (map_name, alt and cells) at each altitude. Its cells move once, its spectra twice."""
    goals = sorted(float(a) for a in altitudes)
    steps = Continued(lambda head: [(to - float(head["alt"]), alpha) for to in goals])

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        return pd.concat([blocks.cells_of({"map_name": head["map_name"], "alt": goals[n]}, at, steps.last(head, n, strip, sides), sides) for n, strip in stack.items()])

    return blocks.along_both(grid, ["map_name", "alt"], steps.first, steps.second, finish, SCHEMA, cells=cells)


def damping_of_map(grid: DataFrame, dz: float, alphas: Sequence[float], cells: int = blocks.CELLS) -> DataFrame:
    """map_name, alt, alpha and change: the largest change of a downward continuation from each damping to the next (the last one keeps that before it)."""
    steps = Continued(lambda head: [(dz, a) for a in alphas])

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        maps = [steps.last(head, n, stack[n], sides) for n in sorted(stack)]
        changes = [float(np.max(np.abs(b - a))) for a, b in zip(maps, maps[1:], strict=False)]
        return pd.DataFrame([(head["map_name"], head["alt"], float(a), c) for a, c in zip(alphas, [*changes, (changes or [0.0])[-1]], strict=True)], columns=["map_name", "alt", "alpha", "change"])

    strips = blocks.along_both(grid, ["map_name", "alt"], steps.first, steps.second, finish, "map_name string, alt double, alpha double, change double", cells=cells)
    return strips.groupBy("map_name", "alt", "alpha").agg(F.max("change").alias("change"))


def extend_stack(grid3d: DataFrame, low: float, high: float, alpha: float = 0.0) -> DataFrame:
    """A stack of levels carried on by its own step, down to ``low`` and up to ``high``, from its lowest and highest level."""
    r = grid3d.agg(F.min("alt"), F.max("alt"), F.countDistinct("alt")).first()
    step = (r[1] - r[0]) / max(r[2] - 1, 1) or 1.0
    down = [r[0] - step * i for i in range(int(np.ceil(max(0.0, r[0] - low) / step - 1e-9)), 0, -1)]
    up = [r[1] + step * i for i in range(1, int(np.ceil(max(0.0, high - r[1]) / step - 1e-9)) + 1)]
    out = grid3d.select("map_name", "alt", "iy", "ix", "yy", "xx", "val")
    if down:
        out = out.unionByName(continue_map(grid3d.filter(F.col("alt") == r[0]), down, alpha))
    if up:
        out = out.unionByName(continue_map(grid3d.filter(F.col("alt") == r[1]), up, alpha))
    return out


def level_drape(grid: DataFrame, alt: float, down: float = 150.0, up: float = 150.0, dz: float = 5.0, alpha: float = 200.0, cells: int = 1 << 14) -> DataFrame:
    """A drape map (own altitude in each cell) brought to one altitude.

    A stack of continuations from the mean drape is made, and each cell takes
    the level that its own distance asks for, between two levels linearly. A strip
    of rows holds all levels at once, so it has fewer cells than others; only
    levels that some cell of the table asks for are made.
    """
    move = F.least(F.greatest(alt - F.col("alt"), F.lit(-float(down))), F.lit(float(up)))
    r = grid.agg(F.min(move), F.max(move)).first()
    n = np.arange(-np.ceil(down / dz), np.ceil(up / dz) + 1) * dz
    n = n[(n >= r[0] - dz) & (n <= r[1] + dz)] if r[0] is not None else n
    steps = Continued(lambda head: [(float(s), alpha) for s in n])
    heights, values = len(n), len(n) + 1

    def first(head: dict, own: np.ndarray, at: np.ndarray, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield from steps.first(head, own, sides)
        yield heights, at
        yield values, own

    def second(head: dict, variant: int, strip: np.ndarray, at: int, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield from ((variant, strip),) if variant >= heights else steps.second(head, variant, strip, at, sides)

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        moves = np.clip(alt - stack[heights].real, -down, up)
        place = np.clip((moves - n[0]) / dz, 0, len(n) - 1)
        low = np.minimum(place.astype(int), max(len(n) - 2, 0))
        levels = np.stack([steps.last(head, k, stack[k], sides) for k in range(len(n))])
        a, b = (np.take_along_axis(levels, k[None], 0)[0] for k in (low, np.minimum(low + 1, len(n) - 1)))
        return blocks.cells_of({"map_name": head["map_name"], "alt": alt}, at, np.where(stack[values].real == 0, 0.0, a + (place - low) * (b - a)), sides)

    return blocks.along_both(grid.withColumn("_own", F.col("alt").cast("double")), ["map_name"], first, second, finish, SCHEMA, cells=cells, more=["_own"])


def _forward(head: dict, values: np.ndarray, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, np.fft.fft(values, axis=1)


def vectors_of_map(grid: DataFrame, declination: float, inclination: float, cells: int = blocks.CELLS) -> DataFrame:
    """map_name, iy, ix and the three components of each map."""

    def second(head: dict, variant: int, strip: np.ndarray, at: int, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        f = np.fft.fft(strip, axis=0)
        waves = _columns_of(sides, sides.nx, sides.ny, at, strip.shape[1])
        for n, h in enumerate(direction_filters(*waves, declination, inclination)):
            yield n, np.fft.ifft(f * h, axis=0)

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        x, y, z = (np.fft.ifft(stack[n], axis=1).real for n in range(3))
        rows = blocks.cells_of(head, at, x, sides)
        return rows[["map_name", "iy", "ix"]].assign(val_x=x.ravel(), val_y=y.ravel(), val_z=z.ravel())

    return blocks.along_both(grid, ["map_name"], _forward, second, finish, "map_name string, iy int, ix int, val_x double, val_y double, val_z double", cells=cells)


def spectrum_of_map(grid: DataFrame, cells: int = blocks.CELLS) -> DataFrame:
    """map_name, kx, ky and power of each map."""

    def second(head: dict, variant: int, strip: np.ndarray, at: int, sides: Sides) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.abs(np.fft.fft(strip, axis=0)) ** 2

    def finish(head: dict, at: int, stack: dict[int, np.ndarray], sides: Sides) -> pd.DataFrame:
        power = stack[0].real
        ky, kx = (2 * np.pi * np.fft.fftfreq(n, d) for n, d in ((sides.ny, sides.dy), (sides.nx, sides.dx)))
        return pd.DataFrame({"map_name": head["map_name"], "kx": np.tile(kx, len(power)), "ky": np.repeat(ky[at : at + len(power)], sides.nx), "power": power.ravel()})

    return blocks.along_both(grid, ["map_name"], _forward, second, finish, "map_name string, kx double, ky double, power double", cells=cells)
