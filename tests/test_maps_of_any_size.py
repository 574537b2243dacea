"""Transforms and splines of maps in strips against the same of one array."""

import numpy as np
import pytest
from fluxlane.operators import grid as g
from fluxlane.operators import spectral, spline
from pyspark.sql import functions as F

DX, DY = 0.5, 2.0


def as_cells(spark, values, name="m", alt=100.0):
    values = np.asarray(values, float)
    rows = [(name, i + 3, j - 2, i * DY + 7, j * DX - 1, alt, float(values[i, j]), "clash") for i in range(values.shape[0]) for j in range(values.shape[1])]
    return spark.createDataFrame(rows, "map_name string, iy int, ix int, yy double, xx double, alt double, val double, _strip string").drop("_strip")


def as_array(rows, shape, column="val"):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.iy - 3, r.ix + 2] = r[column]
    return out


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(4)
    i, j = np.indices((24, 20))
    return 300 + 20 * np.sin(i / 3.0) + 10 * np.cos(j / 2.5) + rng.normal(size=(24, 20))


@pytest.mark.parametrize("cells", [120, 1 << 18])
def test_continuation_equals_one_array(spark, waves, cells):
    """Sixteen tiles and more, two maps at once, up, down and not at all."""
    both = as_cells(spark, waves).unionByName(as_cells(spark, waves[:9, :13] * 2, "other", 50.0))
    rows = spectral.continue_map(both, [100.0, 103.0, 99.5], 2.0, cells).collect()
    for name, values, alt in (("m", waves, 100.0), ("other", waves[:9, :13] * 2, 50.0)):
        for to in (100.0, 103.0, 99.5):
            got = as_array([r for r in rows if (r.map_name, r.alt) == (name, to)], values.shape)
            assert np.allclose(got, spectral.continued(values, DX, DY, to - alt, 2.0), rtol=0, atol=1e-9)
    assert len(rows) == 3 * (24 * 20 + 9 * 13)
    r = next(r for r in rows if (r.map_name, r.alt, r.iy, r.ix) == ("m", 103.0, 8, 4))
    assert (r.yy, r.xx) == (5 * DY + 7, 6 * DX - 1)


@pytest.mark.parametrize("cells", [100])
def test_vectors_spectra_and_damping_equal_one_array(spark, waves, cells):
    table = as_cells(spark, waves)
    rows = spectral.vectors_of_map(table, 0.2, 1.1, cells).collect()
    for column, expected in zip(("val_x", "val_y", "val_z"), spectral.vector_components(waves, DX, DY, 0.2, 1.1), strict=True):
        assert np.allclose(as_array(rows, waves.shape, column), expected, rtol=0, atol=1e-9)
    power, kx, ky = spectral.spectrum(waves, DX, DY)
    rows = sorted((r.ky, r.kx, r.power) for r in spectral.spectrum_of_map(table, cells).collect())
    assert np.allclose(rows, sorted(zip(ky.ravel(), kx.ravel(), power.ravel(), strict=True)), rtol=1e-9)
    rows = sorted((r.alpha, r.change) for r in spectral.damping_of_map(table, -1.0, [1.0, 10.0, 100.0], cells).collect())
    assert np.allclose([c for _, c in rows], spectral.damping_curve(waves, DX, DY, -1.0, [1.0, 10.0, 100.0]))


def test_missing_rows_and_empty_maps(spark, waves):
    holes = waves.copy()
    holes[5:12] = 0
    table = as_cells(spark, holes).filter("val <> 0")
    got = as_array(spectral.continue_map(table, [101.0], 0.0, 40).collect(), holes.shape)
    assert np.allclose(got, spectral.continued(holes, DX, DY, 1.0), rtol=0, atol=1e-9)
    assert spectral.continue_map(table.limit(0), [1.0]).count() == 0
    one = as_cells(spark, [[5.0]])
    assert np.isclose(spectral.continue_map(one, [101.0]).first().val, spectral.continued(np.array([[5.0]]), 1.0, 1.0, 1.0)[0, 0])


def test_drape_equals_interpolated_stack(spark, waves):
    heights = 100 + np.indices(waves.shape)[1] * 0.05
    table = as_cells(spark, waves).withColumn("alt", F.lit(100.0) + (F.col("ix") + 2) * 0.05)
    got = as_array(spectral.level_drape(table, 100.4, 0.5, 0.5, 0.1, 0.5, 60).collect(), waves.shape)
    move = np.clip(100.4 - heights, -0.5, 0.5)
    steps = np.arange(-5, 6) * 0.1
    stack = np.stack([spectral.continued(waves, DX, DY, s, 0.5) for s in steps])
    at = np.clip((move - steps[0]) / 0.1, 0, 10)
    low = np.minimum(at.astype(int), 9)
    a, b = (np.take_along_axis(stack, k[None], 0)[0] for k in (low, low + 1))
    assert np.allclose(got, a + (at - low) * (b - a), rtol=0, atol=1e-6)


def points(spark, n=60):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(k, float(x), float(y), "clash") for k, x, y in zip(range(n), rng.uniform(-1.5, 9.5, n), rng.uniform(6, 54, n), strict=True)], "id long, lon double, lat double, _patch string").drop("_patch")


def dense(y, kind):
    """The spline's coefficients by one dense solve of its equations."""
    n, (middle, scale) = len(y), {"quadratic": (6, 8), "cubic": (4, 6)}[kind]
    m = np.zeros((n + 2, n + 2))
    for i in range(n):
        m[i, i : i + 3] = np.array([1, middle, 1]) / scale
    m[n, :3] = m[n + 1, -3:] = 1, -2, 1
    return np.linalg.solve(m, np.concatenate([y, np.zeros((2, *y.shape[1:]))]))


def basis(kind, t):
    """B-spline of a kind at distance t from its node."""
    t = abs(t)
    if kind == "quadratic":
        return 0.75 - t * t if t <= 0.5 else (1.5 - t) ** 2 / 2 if t <= 1.5 else 0.0
    return 2 / 3 - t * t + t**3 / 2 if t <= 1 else (2 - t) ** 3 / 6 if t <= 2 else 0.0


def value(coef, kind, fy, fx):
    return sum(coef[i, j] * basis(kind, fy - i + 1) * basis(kind, fx - j + 1) for i in range(coef.shape[0]) for j in range(coef.shape[1]))


@pytest.mark.parametrize("kind", ["quadratic", "cubic"])
def test_splines_equal_dense_solves(spark, waves, kind):
    for n in (1, 2, 3, 7):
        assert np.allclose(spline.coefficients(waves[:n], kind), dense(waves[:n], kind) if n > 1 else np.repeat(waves[:1], 3, 0))
    table = as_cells(spark, waves)
    a = g.axes(table)
    coef = dense(dense(waves, kind).T, kind).T
    assert np.allclose(np.sort([r.coef for r in spline.coefficient_table(table, kind, cells=50).collect()]), np.sort(coef.ravel()))
    rows = spline.lookup(points(spark), spline.coefficient_table(table, kind, cells=50), a, kind, slopes=True).collect()
    inside = 0
    for r in rows:
        fx, fy = (r.lon + 1) / DX, (r.lat - 7) / DY
        if 0 <= fx <= 19 and 0 <= fy <= 23:
            inside += 1
            assert np.isclose(r.map_val, value(coef, kind, fy, fx), rtol=0, atol=1e-9)
            d = 1e-6
            assert np.isclose(r.map_val_by_x * DX, (value(coef, kind, fy, fx + d) - value(coef, kind, fy, fx - d)) / (2 * d), atol=1e-4)
            assert np.isclose(r.map_val_by_y * DY, (value(coef, kind, fy + d, fx) - value(coef, kind, fy - d, fx)) / (2 * d), atol=1e-4)
        else:
            assert r.map_val is None and r.map_val_by_x is None
    assert 20 < inside < len(rows) == 60
    # nodes, edges among them, give the grid's values
    nodes = table.select("iy", "ix", F.col("xx").alias("lon"), F.col("yy").alias("lat"))
    assert np.allclose(as_array(spline.interpolated(nodes, table, a, kind).collect(), waves.shape, "map_val"), waves)


def test_cubic_equals_the_interpolant(spark, waves):
    table = as_cells(spark, waves)
    whole = g.interpolant(table)
    for r in spline.interpolated(points(spark), table, g.axes(table)).collect():
        if r.map_val is not None:
            assert np.isclose(r.map_val, whole(r.lat, r.lon))


@pytest.mark.parametrize("kind", ["quadratic", "cubic"])
def test_stack_spline(spark, waves, kind):
    small = waves[:6, :5]
    alts = [10.0, 15.0, 20.0, 25.0]
    factors = np.array([1.0, 2.5, 1.5, 4.0])
    stack = None
    for alt, k in zip(alts, factors, strict=True):
        level = as_cells(spark, small * k, alt=alt)
        stack = level if stack is None else stack.unionByName(level)
    a = g.axes(stack)
    spots = points(spark).select("id", (F.col("lon") / 5).alias("lon"), (F.col("lat") / 5 + 6).alias("lat"), (F.col("id") % 19 + 8.5).alias("alt"))
    coef, along = dense(dense(small, kind).T, kind).T, dense(factors[:, None], kind)[:, 0]
    known = 0
    for r in spline.interpolated_levels(spots, stack, a, kind).collect():
        fx, fy, fz = (r.lon + 1) / DX, (r.lat - 7) / DY, (r.alt - 10) / 5
        if 0 <= fx <= 4 and 0 <= fy <= 5 and 0 <= fz <= 3:
            known += 1
            assert np.isclose(r.map_val, value(coef, kind, fy, fx) * sum(c * basis(kind, fz - k + 1) for k, c in enumerate(along)))
        else:
            assert r.map_val is None
    assert known > 5


def test_vertical_derivative(spark, waves):
    got = as_array(spline.vertical_derivative(as_cells(spark, waves), 1.0, 70).collect(), waves.shape)
    assert np.allclose(got, spectral.continued(waves, DX, DY, 1.0) - waves, rtol=0, atol=1e-9)
