"""Limits of maps and values, norms of old models, units and clipping of ellipses, and a run's three outputs."""

import numpy as np
import pytest
from fluxlane.functions import geodesy
from fluxlane.operators import grid as g
from fluxlane.operators import linear
from fluxlane.operators import navigation as nav
from pyspark.sql import functions as F


def test_limits(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "v double")
    assert tuple(df.agg(*g.limits(F.col("v"))).first()) == (1, 5) and tuple(df.agg(*g.limits(F.col("v"), 0.25)).first()) == (0, 6)
    cells = spark.createDataFrame([(name, i, j, 5_000_000.0 + 1000 * i, 300_000.0 + 50_000 * j, 1.0) for name in ("m", None) for i in range(3) for j in range(8)], "map_name string, iy int, ix int, yy double, xx double, val double")
    lat, lon = geodesy.from_utm(F.col("xx"), F.col("yy"), F.lit(18), F.lit(True))
    placed = cells.filter("map_name = 'm'").select("iy", "ix", lat.alias("lat"), lon.alias("lon")).collect()
    rows = {r.map_name: r for r in g.utm_limits(cells, 18).collect()}
    assert set(rows) == {"m", None}
    for r in rows.values():
        assert np.allclose(r.lons, sorted(p.lon for p in placed if p.ix in (0, 7) and p.iy in (0, 2)))
        ends = [f(p.lat for p in placed if p.iy == k) for k in (0, 2) for f in (min, max)]
        assert np.allclose(r.lats, sorted(ends), atol=1e-15)


def test_norms():
    x, y = (np.zeros((1, 3)), np.ones((1, 3))), (0.5, 2.0)
    turn = np.arange(9.0).reshape(3, 3)
    for given, a, v in (((*x, *y), (0, 1), np.eye(3)), ((turn, *x, *y), (0, 1), turn), ((7, 8, *x, *y), (7, 8), np.eye(3)), ((7, 8, turn, *x, *y), (7, 8), turn)):
        found = linear.unpacked_norms(given)
        assert found[:2] == a and np.array_equal(found[2], v) and found[3] is x[0] and found[4] is x[1] and found[5:] == y
    with pytest.raises(ValueError):
        linear.unpacked_norms((1, 2, 3))


def test_ellipses(spark):
    one = spark.range(1)
    p = np.array([[4e-12, 1e-12], [1e-12, 2e-12]])
    n, e = (float(one.select(f(F.lit(1.0), F.lit(0.7))).first()[0]) for f in (geodesy.lat_to_north, geodesy.lon_to_east))
    for units, scale in (("rad", np.ones((2, 2))), ("deg", np.full((2, 2), np.degrees(1) ** 2)), ("m", np.outer((n, e), (n, e))), ("ft", np.outer((n, e), (n, e)) / 0.3048**2)):
        got = one.select(*[v.alias(k) for k, v in zip("abc", nav.ellipse_units(*(F.lit(float(x)) for x in (p[0, 0], p[0, 1], p[1, 1])), units, F.lit(0.7)), strict=True)]).first()
        assert np.allclose([got.a, got.b, got.c], (p * scale)[[0, 0, 1], [0, 1, 1]])
    with pytest.raises(ValueError):
        nav.ellipse_units(F.lit(1.0), F.lit(0.0), F.lit(1.0), "yard")
    long = F.lit(9.0), F.lit(0.0), F.lit(1.0)
    whole, cut = (one.select(nav.ellipse(*long, 9, 0.95, clip).alias("p")).first().p for clip in (None, 4.0))
    for a, b in zip(whole, cut, strict=True):
        assert (b.x, b.y) == ((a.x, a.y) if np.hypot(a.x, a.y) <= 4 else (None, None))
    assert any(b.x is None for b in cut) and any(b.x is not None for b in cut)


def test_results(spark):
    turn = [float(v) for v in (np.cos(0.01), -np.sin(0.01), 0, np.sin(0.01), np.cos(0.01), 0, 0, 0, 1)]
    truth = spark.createDataFrame([(1, 0.7, 0.1, 300.0, 1.0, 2.0, 3.0, 0.7001, 0.1002, 305.0, 1.5, 2.5, 3.5, [float(v) for v in np.eye(3).ravel()], turn, [float(v) for v in np.diag([4e-12] * 18).ravel()])], "k int, true_lat double, true_lon double, true_alt double, true_vn double, true_ve double, true_vd double, ins_lat double, ins_lon double, ins_alt double, ins_vn double, ins_ve double, ins_vd double, true_cnb array<double>, ins_cnb array<double>, ins_p array<double>")
    x = [-9e-5, -1.9e-4, -4.0, -0.4, -0.4, -0.4, 1e-3, 2e-3, 0.011, *[0.0] * 8, 6.0]
    states = spark.createDataFrame([(1, x, [float(v) for v in np.diag(np.arange(1.0, 19) * 1e-12).ravel()])], "k int, x array<double>, p array<double>")
    bound, ins, filt = (df.first() for df in nav.results(states, states.select("k", "p"), truth, ["k"], 18))
    assert np.isclose(bound.lon_std, np.sqrt(2e-12)) and np.isclose(ins.lat_err, 1e-4) and np.isclose(ins.lat_std, 2e-6) and ins.n_std > 12
    assert np.isclose(filt.lat_err, 1e-5) and np.isclose(filt.vd_err, 0.1) and np.isclose(filt.tn_err, 1e-3) and np.isclose(filt.td_err, 0.011 - np.sin(0.01)) and filt.fogm == 6 and 60 < filt.n_err < 65
