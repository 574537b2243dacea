"""Gridded maps as long tables: (map_name, iz, iy, ix, yy, xx, alt, val); val 0 marks a cell without data.

Steps that touch a cell's neighbours are equi-joins on cell numbers or windows
along rows and columns, so they are dealt out like any join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlane.functions import geodesy


def is_missing(val: Column) -> Column:
    return val.isNull() | F.isnan(val) | (val == 0)


def cleaned(grid: DataFrame, value: str = "val") -> DataFrame:
    """NaN and null become 0, the mark of missing cells."""
    return grid.withColumn(value, F.when(is_missing(F.col(value).cast("double")), 0.0).otherwise(F.col(value)))


@dataclass(frozen=True)
class Axes:
    """Place of cell (0, 0) and step of a regular grid, its numbers of columns and rows, and its first cell's numbers."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int
    ix0: int = 0
    iy0: int = 0


def axes(grid: DataFrame) -> Axes:
    """From one row of aggregates; a step is (last - first) / (n - 1). The grid must be of one map."""
    name = F.col("map_name") if "map_name" in grid.columns else F.lit(None).cast("string")
    r = grid.agg(F.min("xx"), F.max("xx"), F.min("yy"), F.max("yy"), F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy"), F.min(name), F.max(name)).first()
    if r[4] is None:
        raise ValueError("an empty grid has no axes")
    if r[8] != r[9]:
        raise ValueError(f"a grid of one map is needed, not of {r[8]} and {r[9]}")
    nx, ny = r[5] - r[4] + 1, r[7] - r[6] + 1
    dx, dy = (r[1] - r[0]) / max(nx - 1, 1), (r[3] - r[2]) / max(ny - 1, 1)
    return Axes(r[0] - r[4] * dx, r[2] - r[6] * dy, dx, dy, nx, ny, r[4], r[6])


def step(x: Column, n: Column) -> Column:
    """Aggregate: the step of an axis of n places."""
    return (F.max(x) - F.min(x)) / (n - 1)


def params(grid: DataFrame, value: str = "val") -> DataFrame:
    """One row a map: numbers of cells with and without data, and dimensions."""
    missing = is_missing(F.col(value)).cast("long")
    return grid.groupBy("map_name").agg(F.sum(1 - missing).alias("n_data"), F.sum(missing).alias("n_missing"), (F.max("ix") - F.min("ix") + 1).cast("long").alias("nx"), (F.max("iy") - F.min("iy") + 1).cast("long").alias("ny"))


def trim(grid: DataFrame, pad: int = 0, x_limits: tuple[float, float] = (-np.inf, np.inf), y_limits: tuple[float, float] = (-np.inf, np.inf)) -> DataFrame:
    """Rows and columns without data are cut off, and those outside the limits; ``pad`` more are kept on each side.

    A row counts as empty if it has no data at all (a sum could cancel out).
    """
    data = ~is_missing(F.col("val")) & F.col("xx").between(*x_limits) & F.col("yy").between(*y_limits)
    edge = grid.filter(data).groupBy("map_name").agg(F.min("ix").alias("_x1"), F.max("ix").alias("_x2"), F.min("iy").alias("_y1"), F.max("iy").alias("_y2"))
    inside = F.col("ix").between(F.col("_x1") - pad, F.col("_x2") + pad) & F.col("iy").between(F.col("_y1") - pad, F.col("_y2") + pad)
    return grid.join(edge, "map_name").filter(inside).drop("_x1", "_x2", "_y1", "_y2")


def trim_to_path(grid: DataFrame, path: DataFrame, pad: int = 0) -> DataFrame:
    r = path.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    return trim(grid, pad, (r[0], r[1]), (r[2], r[3]))


def _offsets(name: str, values: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def border(grid: DataFrame, inner: bool = True) -> DataFrame:
    """Cells on the border of the data: cells with data (``inner``) or without that have one of the other sort among their eight neighbours.

    Neighbours beyond the grid count as without data.
    """
    data = grid.filter(~is_missing(F.col("val")))
    near = data.select("map_name", "ix", "iy").select("map_name", "ix", "iy", _offsets("_dx", (-1, 0, 1))).select("*", _offsets("_dy", (-1, 0, 1)))
    near = near.filter("_dx != 0 or _dy != 0").select("map_name", (F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy"))
    full = near.groupBy("map_name", "ix", "iy").agg(F.count(F.lit(1)).alias("_n"))
    joined = grid.join(full, ["map_name", "ix", "iy"], "left")
    missing = is_missing(F.col("val"))
    keep = ~missing & (F.coalesce("_n", F.lit(0)) < 8) if inner else missing & (F.coalesce("_n", F.lit(0)) > 0)
    return joined.filter(keep).drop("_n")


def order_border(yy: np.ndarray, xx: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """A chain through border cells, each time to the nearest that is left; a border is one-dimensional, so it fits one task."""
    y, x = np.asarray(yy, float) / dy, np.asarray(xx, float) / dx
    left, out = np.ones(len(y), bool), []
    at = 0
    while left.any():
        out.append(at)
        left[at] = False
        if left.any():
            d = np.where(left, (y - y[at]) ** 2 + (x - x[at]) ** 2, np.inf)
            at = int(np.argmin(d))
    return np.array(out, int)


def without_spurs(mask: np.ndarray) -> np.ndarray:
    """A border mask less its dead ends of one or two cells, removed until none is left."""
    mask = mask.copy()
    while True:
        wide = np.pad(mask, 1).astype(int)
        around = sum(np.roll(np.roll(wide, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)[1:-1, 1:-1]
        single = mask & (around <= 1)
        pairs = np.pad(mask & (around == 2), 1)
        touching = sum(np.roll(np.roll(wide, i, 0), j, 1) * 1 for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))[1:-1, 1:-1]
        double = mask & pairs[1:-1, 1:-1] & (touching == 1) & (around - touching == 1)
        if not (single | double).any():
            return mask
        mask &= ~(single | double)


def fill(grid: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """Missing cells take the mean of the k nearest cells with data, by (xx, yy); ties go to lower (iy, ix).

    Holes look within ``radius`` cells first, by an equi-join on coarse cells;
    rings grow fourfold for those that found fewer than k, until all have.
    """
    todo = grid.filter(is_missing(F.col("val"))).select("map_name", "ix", "iy", "xx", "yy")
    data = grid.filter(~is_missing(F.col("val"))).select("map_name", F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("xx").alias("_xx"), F.col("yy").alias("_yy"), F.col("val").alias("_val"))
    a, filled = axes(grid), None
    while True:
        size = max(1, radius)
        cell = lambda p: [F.floor(F.col(f"{p}ix") / size).alias("_cx"), F.floor(F.col(f"{p}iy") / size).alias("_cy")]  # noqa: E731, B023
        holes = todo.select("*", *cell("")).select("map_name", "ix", "iy", "xx", "yy", "_cx", "_cy", _offsets("_dx", (-1, 0, 1))).select("*", _offsets("_dy", (-1, 0, 1)))
        holes = holes.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")
        near = holes.join(data.select("*", *cell("_")), ["map_name", "_cx", "_cy"])
        d = (F.col("xx") - F.col("_xx")) ** 2 + (F.col("yy") - F.col("_yy")) ** 2
        w = Window.partitionBy("map_name", "iy", "ix").orderBy("_d", "_iy", "_ix")
        best = near.withColumn("_d", d).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).groupBy("map_name", "ix", "iy").agg(F.avg("_val").alias("_fill"), F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_far"))
        whole = size >= max(a.nx, a.ny)
        reach = (size * min(abs(a.dx) or np.inf, abs(a.dy) or np.inf)) ** 2
        ready = best if whole else best.filter((F.col("_n") == k) & (F.col("_far") <= reach))
        part = ready.select("map_name", "ix", "iy", "_fill")
        filled = part if filled is None else filled.unionByName(part)
        if whole:
            break
        todo = todo.join(part, ["map_name", "ix", "iy"], "left_anti")
        if todo.isEmpty():
            break
        radius = size * 4
    return grid.join(filled, ["map_name", "ix", "iy"], "left").withColumn("val", F.coalesce("_fill", "val")).drop("_fill").select(*grid.columns)


def lookup(points: DataFrame, grid: DataFrame, a: Axes, x: str = "lon", y: str = "lat", out: str = "map_val", by: Sequence[str] = ()) -> DataFrame:
    """Bilinear value at each point, null outside the grid: one equi-join of the points' cells with the grid's.

    ``by``: columns of both, such as a map's name or level, that tell grids on
    the same axes apart.

    Each grid cell is packed with its right, upper and diagonal neighbours by
    two windows, so that a point needs one row. Beyond an edge, and where a
    neighbour has no row at all, the value of the nearest corner stands in.
    """
    across, up = Window.partitionBy(*by, "iy").orderBy("ix"), Window.partitionBy(*by, "ix").orderBy("iy")
    beside = lambda c, number, w: F.when(F.lead(number).over(w) == F.col(number) + 1, F.lead(c).over(w))
    cells = grid.select(*by, "ix", "iy", F.col("val").alias("_v00"), beside("val", "ix", across).alias("_v10"))
    cells = cells.select("*", beside("_v00", "iy", up).alias("_v01"), beside("_v10", "iy", up).alias("_v11"))
    fx, fy = (F.col(x) - a.x0) / (a.dx or 1.0), (F.col(y) - a.y0) / (a.dy or 1.0)
    x2, y2 = a.ix0 + a.nx - 1, a.iy0 + a.ny - 1
    inside = (fx >= a.ix0) & (fx <= x2) & (fy >= a.iy0) & (fy <= y2)
    ix, iy = F.least(F.floor(fx), F.lit(max(x2 - 1, a.ix0))), F.least(F.floor(fy), F.lit(max(y2 - 1, a.iy0)))
    placed = points.withColumn("_ix", F.when(inside, ix)).withColumn("_iy", F.when(inside, iy)).withColumn("_u", fx - F.col("_ix")).withColumn("_w", fy - F.col("_iy"))
    hit = placed.join(cells.withColumnsRenamed({"ix": "_ix", "iy": "_iy"}), [*by, "_ix", "_iy"], "left")
    u, w = F.col("_u"), F.col("_w")
    value = (1 - u) * (1 - w) * F.col("_v00") + u * (1 - w) * F.coalesce("_v10", "_v00") + (1 - u) * w * F.coalesce("_v01", "_v00") + u * w * F.coalesce("_v11", "_v10", "_v01", "_v00")
    return hit.withColumn(out, value).select(*points.columns, out)


def lookup_levels(points: DataFrame, stack: DataFrame, a: Axes, x: str = "lon", y: str = "lat", z: str = "alt", out: str = "map_val") -> DataFrame:
    """Trilinear value at each point: bilinear on the levels (``alt``) below and above it, linear between; the nearest level outside, null off the grid.

    The levels of a stack are few; each point asks for two of them by an equi-join.
    A stack without levels gives null.
    """
    levels = [r[0] for r in stack.select("alt").distinct().orderBy("alt").collect()]  # a row a level
    if not levels:
        return points.withColumn(out, F.lit(None).cast("double"))
    known = F.array(*[F.lit(v) for v in levels])
    low = F.coalesce(F.array_max(F.filter(known, lambda v: v <= F.col(z))), F.lit(levels[0]))
    high = F.coalesce(F.array_min(F.filter(known, lambda v: v >= F.col(z))), F.lit(levels[-1]))
    share = F.coalesce(F.try_divide(F.col(z) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    placed = points.withColumns({"_low": low, "_high": high}).withColumn("_share", share)
    for side in ("low", "high"):
        cells = stack.withColumnRenamed("alt", f"_{side}")
        placed = lookup(placed, cells, a, x, y, f"_at_{side}", [f"_{side}"])
    return placed.withColumn(out, F.col("_at_low") + F.col("_share") * (F.col("_at_high") - F.col("_at_low"))).select(*points.columns, out)


def from_utm(grid: DataFrame, zone: int, new: Axes, north: bool = True, name: str | None = None) -> DataFrame:
    """A map in metres of a UTM zone (xx east, yy north) on new axes in radians: bilinear, 0 outside and next to missing cells."""
    lat, lon = F.col("yy"), F.col("xx")
    east, up = geodesy.to_utm(lat, lon, F.lit(zone))
    shift = 0.0 if north else geodesy.UTM_NORTH
    up = up - F.when(lat < 0, geodesy.UTM_NORTH).otherwise(0.0) + shift  # a map that crosses the equator keeps its own half's northing
    return _regridded(grid, new, name, {"_x": east, "_y": up})


def limits(x: Column, share: float = 0.0) -> tuple[Column, Column]:
    """Aggregates: the least and greatest value, moved apart by a share of their distance on each side."""
    gap = (F.max(x) - F.min(x)) * share
    return F.min(x) - gap, F.max(x) + gap


def utm_limits(grid: DataFrame, zone: int, north: bool = True) -> DataFrame:
    """One row a map in metres of a UTM zone: the longitudes of its four corners and the extreme latitudes of its lowest and highest row, each sorted, in radians."""
    edge = grid.groupBy(F.col("map_name").alias("_map")).agg(*[f(c).alias(f"_{n}{c}") for n, f in (("a", F.min), ("b", F.max)) for c in ("ix", "iy")])
    # meridians bend little along the sides, parallels do along the rows
    rows = grid.join(edge, F.col("map_name").eqNullSafe(F.col("_map"))).filter(F.col("iy").isin(F.col("_aiy"), F.col("_biy")))
    lat, lon = geodesy.from_utm(F.col("xx"), F.col("yy"), F.lit(zone), F.lit(north))
    corner, low = F.col("ix").isin(F.col("_aix"), F.col("_bix")), F.col("iy") == F.col("_aiy")
    at = rows.select("map_name", lat.alias("lat"), lon.alias("lon"), corner.alias("corner"), low.alias("low"))
    ends = [f(F.when(F.col("low") == side, F.col("lat"))) for side in (True, False) for f in (F.min, F.max)]
    return at.groupBy("map_name").agg(F.array_sort(F.collect_list(F.when(F.col("corner"), F.col("lon")))).alias("lons"), F.array_sort(F.array(*ends)).alias("lats"))


def on_data(points: DataFrame, grid: DataFrame, a: Axes, x: str = "lon", y: str = "lat", out: str = "on_data") -> DataFrame:
    """Whether each point lies strictly inside the grid, on cells that all have data."""
    mask = grid.withColumn("val", (~is_missing(F.col("val"))).cast("double"))
    on = lookup(points, mask, a, x, y, "_share")
    fx, fy = (F.col(x) - a.x0) / (a.dx or 1.0), (F.col(y) - a.y0) / (a.dy or 1.0)
    strict = (fx > a.ix0) & (fx < a.ix0 + a.nx - 1) & (fy > a.iy0) & (fy < a.iy0 + a.ny - 1)
    return on.withColumn(out, F.coalesce(strict & (F.col("_share") > 1 - 1e-9), F.lit(False))).select(*points.columns, out)


def check(points: DataFrame, grid: DataFrame, a: Axes, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row: whether every point is ``on_data``."""
    return on_data(points, grid, a, x, y, "_on").agg(F.coalesce(F.bool_and("_on"), F.lit(True)).alias("inside"))


def resample(grid: DataFrame, new: Axes, name: str | None = None) -> DataFrame:
    """The grid on new axes, by bilinear interpolation; 0 outside the old grid and next to missing cells."""
    return _regridded(grid, new, name, {"_x": F.col("xx"), "_y": F.col("yy")})


def _regridded(grid: DataFrame, new: Axes, name: str | None, place: dict[str, Column]) -> DataFrame:
    """The grid's values at the places (_x, _y) of the cells of new axes."""
    a, spark = axes(grid), grid.sparkSession
    at = spark.range(new.nx * new.ny).select((F.col("id") % new.nx).cast("int").alias("ix"), F.expr(f"cast(id div {new.nx} as int)").alias("iy"))
    at = at.withColumn("xx", new.x0 + F.col("ix") * new.dx).withColumn("yy", new.y0 + F.col("iy") * new.dy).withColumns(place)
    valued = lookup(at, grid, a, "_x", "_y", "val")
    mask = lookup(at, grid.withColumn("val", (~is_missing(F.col("val"))).cast("double")), a, "_x", "_y", "_on").select("ix", "iy", "_on")
    both = valued.join(mask, ["ix", "iy"])
    label = F.lit(name) if name is not None else F.lit(None).cast("string")
    return both.select(label.alias("map_name"), "iy", "ix", "yy", "xx", F.when(F.col("_on") > 1 - 1e-9, F.col("val")).otherwise(0.0).alias("val"))


def combine(grid: DataFrame, fallback: DataFrame) -> DataFrame:
    """Cells of ``grid``; those without data take the fallback's value at the same cell, 0 if it has none. The fallback must be of one map."""
    axes(fallback)
    other = fallback.select("ix", "iy", F.col("val").alias("_other"))
    return grid.join(other, ["ix", "iy"], "left").withColumn("val", F.when(is_missing(F.col("val")), F.coalesce("_other", F.lit(0.0))).otherwise(F.col("val"))).drop("_other").select(*grid.columns)


def combine_levels(grids: DataFrame, levels: Sequence[float], priority: str = "alt") -> DataFrame:
    """For each level and cell, the value of the highest map at or below it (the lowest map where none is).

    The maps are layers on the same axes, whatever their names.
    """
    level = F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level")
    long = grids.filter(~is_missing(F.col("val"))).select("*", level)
    rank = F.struct((F.col(priority) <= F.col("level")).alias("below"), F.when(F.col(priority) <= F.col("level"), F.col(priority)).otherwise(-F.col(priority)).alias("near"))
    return long.groupBy("level", "iy", "ix").agg(F.max_by("val", rank).alias("val"), F.max_by(priority, rank).alias("from_alt"))


def level_at(grid3d: DataFrame, alt: float) -> DataFrame:
    """A level of each stack (map_name, where there is one): linear between the levels around it, the nearest outside."""
    by = [c for c in ("map_name",) if c in grid3d.columns]
    below = F.max_by("val", F.when(F.col("alt") <= alt, F.col("alt")))
    above = F.min_by("val", F.when(F.col("alt") >= alt, F.col("alt")))
    a1, a2 = F.max(F.when(F.col("alt") <= alt, F.col("alt"))), F.min(F.when(F.col("alt") >= alt, F.col("alt")))
    cells = grid3d.groupBy(*by, "iy", "ix").agg(F.first("yy").alias("yy"), F.first("xx").alias("xx"), below.alias("_b"), above.alias("_a"), a1.alias("_a1"), a2.alias("_a2"))
    share = F.coalesce(F.try_divide(F.lit(alt) - F.col("_a1"), F.col("_a2") - F.col("_a1")), F.lit(0.0))
    value = F.when(F.col("_a1").isNull(), F.col("_a")).when(F.col("_a2").isNull(), F.col("_b")).otherwise(F.col("_b") + share * (F.col("_a") - F.col("_b")))
    return cells.select(*by, "iy", "ix", "yy", "xx", F.lit(alt).alias("alt"), value.alias("val"))


def altitude_bucket(alt: Column, dz: float) -> Column:
    """The altitude that maps are cached under."""
    return F.floor(alt / dz) * dz


def pick_map(points: DataFrame, maps: DataFrame, dz: float, alt: str = "alt") -> DataFrame:
    """The map that serves each point: the highest one at or below its altitude bucket, else null. ``maps``: map_name, map_alt; few rows."""
    table = sorted((r["map_alt"], r["map_name"]) for r in maps.select("map_alt", "map_name").collect())  # a row a map
    choice = F.lit(None).cast("string")
    for level, name in table:
        choice = F.when(F.col("bucket") >= level, F.lit(name)).otherwise(choice)
    return points.withColumn("bucket", altitude_bucket(F.col(alt), dz)).withColumn("map_name", choice)


def colour_limits(grid: DataFrame, colours: int) -> DataFrame:
    """Quantile edges that put equal numbers of cells with data in each colour."""
    quantiles = [i / colours for i in range(colours + 1)]
    edges = grid.filter(~is_missing(F.col("val"))).agg(F.percentile("val", quantiles).alias("_edges"))
    return edges.select(F.posexplode("_edges").alias("colour", "limit"))


def natural_spline(y: np.ndarray, axis: int = 0) -> np.ndarray:
    """B-spline coefficients, one beyond each end, of a natural cubic spline through ``y``."""
    y = np.moveaxis(np.asarray(y, float), axis, 0)
    n = len(y)
    if n == 1:
        return np.moveaxis(np.repeat(y, 3, 0), 0, axis)
    c = np.zeros((n + 2, *y.shape[1:]))
    c[1], c[n] = y[0], y[-1]  # no curvature at the ends
    if n > 2:
        band = np.full(n - 2, 4.0)
        d = 6 * y[1:-1].copy()
        d[0] -= c[1]
        d[-1] -= c[n]
        for i in range(1, n - 2):
            f = 1 / band[i - 1]
            band[i] -= f
            d[i] -= f * d[i - 1]
        x = np.zeros_like(d)
        x[-1] = d[-1] / band[-1]
        for i in range(n - 4, -1, -1):
            x[i] = (d[i] - x[i + 1]) / band[i]
        c[2:n] = x
    c[0], c[n + 1] = 2 * c[1] - c[2], 2 * c[n] - c[n - 1]
    return np.moveaxis(c, 0, axis)


@dataclass
class Interpolant:
    """A natural cubic surface (or a bilinear one) over a regular grid, for numpy arrays of points."""

    values: np.ndarray
    a: Axes
    kind: str = "cubic"

    def __post_init__(self) -> None:
        if self.kind == "cubic":
            self.coef = np.ascontiguousarray(natural_spline(natural_spline(self.values, 0), 1))

    def __call__(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        fy, fx = (np.asarray(lat, float) - self.a.y0) / (self.a.dy or 1), (np.asarray(lon, float) - self.a.x0) / (self.a.dx or 1)
        if self.kind == "cubic" and fy.size > 64 and fy.ndim == 1 and fy.shape == fx.shape and (few := self._few_cells(fy, fx)) is not None:
            return few
        iy, ix = (np.clip(np.floor(f).astype(int), 0, max(n - 2, 0)) for f, n in ((fy, self.values.shape[0]), (fx, self.values.shape[1])))
        u, v = np.clip(fy - iy, 0, 1), np.clip(fx - ix, 0, 1)  # outside, the value of the edge
        if self.kind != "cubic":
            y1, x1 = np.minimum(iy + 1, self.values.shape[0] - 1), np.minimum(ix + 1, self.values.shape[1] - 1)
            g = self.values
            return (1 - u) * ((1 - v) * g[iy, ix] + v * g[iy, x1]) + u * ((1 - v) * g[y1, ix] + v * g[y1, x1])
        out, across, flat, wide = 0.0, _weights(v), self.coef.ravel(), self.coef.shape[1]
        at = iy * wide + ix
        for i, wy in enumerate(_weights(u)):
            row = 0.0
            for j, wx in enumerate(across):
                row = row + wx * flat[i * wide + j :].take(at, mode="clip")
            out = out + wy * row
        return out

    def _few_cells(self, fy: np.ndarray, fx: np.ndarray) -> np.ndarray | None:
        """Values at many places of a few cells, by a polynomial a cell; None if they lie in many, or outside."""
        low, wide = [], 0
        for f, n in ((fy, self.values.shape[0]), (fx, self.values.shape[1])):
            least, most = float(f.min()), float(f.max())
            if not (least >= 0 and most < n - 1):
                return None
            low.append(math.floor(least))
            wide += math.floor(most) - low[-1]
        if wide > 2:
            return None
        for f, i in zip((fy, fx), low, strict=True):
            near = f < i + 1
            if wide and not near.all():
                out, far = np.empty(len(f)), ~near
                out[near], out[far] = self._few_cells(fy[near], fx[near]), self._few_cells(fy[far], fx[far])
                return out
        i, j = low
        u, v = fy - i, fx - j
        powers = np.empty((4, *v.shape))
        powers[0], powers[1] = 1, v
        np.multiply(v, v, out=powers[2])
        np.multiply(powers[2], v, out=powers[3])
        across = np.tensordot(POWERS.T @ self.coef[i : i + 4, j : j + 4] @ POWERS, powers, 1)
        out = across[3] * u
        for k in (2, 1, 0):
            out += across[k]
            if k:
                out *= u
        return out

    def gradient(self, lat: float, lon: float, delta: float = 1e-8) -> np.ndarray:
        """Slopes along latitude and longitude: exact on a cubic surface, else central differences."""
        if self.kind == "cubic":
            return self.value_and_slopes(lat, lon)[1]
        return np.array([(self(lat + delta, lon) - self(lat - delta, lon)) / (2 * delta), (self(lat, lon + delta) - self(lat, lon - delta)) / (2 * delta)])

    def value_and_slopes(self, lat: float, lon: float) -> tuple[float, np.ndarray]:
        """Value and slopes at one point, from one 4 x 4 patch; beyond the edges the surface is level."""
        if self.kind != "cubic":
            return float(self(lat, lon)), self.gradient(lat, lon)
        (i, wy, sy), (j, wx, sx) = (
            _patch((at - zero) / (step or 1), n) for at, zero, step, n in ((lat, self.a.y0, self.a.dy, self.values.shape[0]), (lon, self.a.x0, self.a.dx, self.values.shape[1]))
        )
        across = self.coef[i : i + 4, j : j + 4] @ np.array((wx, sx)).T
        (value, east), (north, _) = (np.array((wy, sy)) @ across).tolist()
        return value, np.array([north / (self.a.dy or 1), east / (self.a.dx or 1)])

    def values_and_slopes(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``value_and_slopes`` at many points: values, and slopes a row a point."""
        if self.kind != "cubic":
            return self(lat, lon), self.gradient(lat, lon).T
        sides = []
        for at, zero, step, n in ((lat, self.a.y0, self.a.dy, self.values.shape[0]), (lon, self.a.x0, self.a.dx, self.values.shape[1])):
            f = (np.asarray(at, float) - zero) / (step or 1)
            i = np.clip(np.floor(f), 0, max(n - 2, 0))
            u = np.clip(f - i, 0, 1)
            slope = np.stack([-((1 - u) ** 2) / 2, (3 * u - 4) * u / 2, ((-3 * u + 2) * u + 1) / 2, u * u / 2], 1) * (u == f - i)[:, None] / (step or 1)
            sides.append((np.nan_to_num(i).astype(int), np.stack(_weights(u), 1), slope))
        (i, y, by_y), (j, x, by_x) = sides
        patch = self.coef[i[:, None, None] + np.arange(4)[:, None], j[:, None, None] + np.arange(4)]
        across, along = np.einsum("nkl,nl->nk", patch, x), np.einsum("nkl,nl->nk", patch, by_x)
        return np.einsum("nk,nk->n", across, y), np.stack([np.einsum("nk,nk->n", across, by_y), np.einsum("nk,nk->n", along, y)], 1)

    def curved(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, slopes (by latitude, longitude) and curvatures (twice by latitude, by both, twice by longitude) of a cubic surface at many points; beyond the edges it is level."""
        if self.kind != "cubic":
            raise ValueError("a cubic surface is needed")
        sides = []
        for at, zero, step, n in ((lat, self.a.y0, self.a.dy, self.values.shape[0]), (lon, self.a.x0, self.a.dx, self.values.shape[1])):
            f = (np.asarray(at, float) - zero) / (step or 1)
            i = np.clip(np.floor(f).astype(int), 0, max(n - 2, 0))
            u = np.clip(f - i, 0, 1)
            on, step = (u == f - i).astype(float), step or 1
            slope = np.stack([-((1 - u) ** 2) / 2, (3 * u - 4) * u / 2, ((-3 * u + 2) * u + 1) / 2, u * u / 2]) * on / step
            bend = np.stack([1 - u, 3 * u - 2, 1 - 3 * u, u]) * on / step**2
            sides.append((i, np.stack(_weights(u)), slope, bend))
        (i, *y), (j, *x) = sides
        patch = self.coef[i[:, None, None] + np.arange(4)[:, None], j[:, None, None] + np.arange(4)]
        over = lambda a, b: np.einsum("kn,nkl,ln->n", a, patch, b)
        return over(y[0], x[0]), np.stack([over(y[1], x[0]), over(y[0], x[1])], 1), np.stack([over(y[2], x[0]), over(y[1], x[1]), over(y[0], x[2])], 1)


#: The weights of a patch by powers of the place in its cell: a row a node, a column a power.
POWERS = np.array([[1.0, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6


def _patch(f: float, n: int) -> tuple[int, tuple, tuple]:
    """First node of the patch of place ``f`` on an axis of ``n`` nodes, the weights there and their derivatives."""
    i = min(max(math.floor(f), 0), max(n - 2, 0))
    u = min(max(f - i, 0.0), 1.0)
    if u != f - i:
        return i, _weights(u), (0.0, 0.0, 0.0, 0.0)
    return i, _weights(u), (-((1 - u) ** 2) / 2, (3 * u**2 - 4 * u) / 2, (-3 * u**2 + 2 * u + 1) / 2, u**2 / 2)


def _weights(u: np.ndarray) -> tuple:
    v, square = 1 - u, u * u
    cube = square * u
    return v * v * v / 6, (3 * cube - 6 * square + 4) / 6, (-3 * cube + 3 * square + 3 * u + 1) / 6, cube / 6


def interpolant(grid: DataFrame, kind: str = "cubic", most_cells: int = 1 << 24) -> Interpolant:
    """The surface of one map level, held whole: maps of more cells than ``most_cells`` must be trimmed to a path first."""
    a = axes(grid)
    if a.nx * a.ny > most_cells:
        raise ValueError(f"{a.nx} x {a.ny} cells; trim the map to the path")
    rows = grid.select("iy", "ix", "val").toPandas()
    values = np.zeros((a.ny, a.nx))
    values[rows["iy"] - rows["iy"].min(), rows["ix"] - rows["ix"].min()] = rows["val"]
    shifted = Axes(a.x0 + a.dx * rows["ix"].min(), a.y0 + a.dy * rows["iy"].min(), a.dx, a.dy, a.nx, a.ny)
    return Interpolant(values, shifted, kind)
