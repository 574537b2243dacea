import numpy as np
import pandas as pd
import pytest
from fluxlane.functions import geodesy
from fluxlane.operators import grid as g
from fluxlane.operators import navigation as nav
from fluxlane.operators import simulate, spectral
from fluxlane.operators.select import Order
from fluxlane.sources import tables
from fluxlane.streaming import realtime
from pyspark.sql import functions as F


def as_grid(spark, values, name="m"):
    values = np.asarray(values, float)
    rows = [(name, i, j, i * 2.0, j * 0.5, 100.0, float(values[i, j])) for i in range(values.shape[0]) for j in range(values.shape[1])]
    return spark.createDataFrame(rows, "map_name string, iy int, ix int, yy double, xx double, alt double, val double")


def as_array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.iy, r.ix] = r.val
    return out


@pytest.fixture(scope="module")
def plane():
    i, j = np.indices((10, 10))
    v = 100 + 3.0 * i + 2.0 * j
    v[4:6, 4:7] = 0
    v[0, :3] = 0
    return v


def test_trim_border_and_params(spark):
    v = np.zeros((6, 7))
    v[2:5, 1:4] = 5
    cells = as_grid(spark, v)
    t = g.trim(cells).agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    assert tuple(t) == (1, 3, 2, 4)
    assert g.trim(cells, 1).count() == 25
    assert {(r.iy, r.ix) for r in g.border(cells).collect()} == {(i, j) for i in (2, 3, 4) for j in (1, 2, 3)} - {(3, 2)}
    assert g.border(cells, inner=False).count() == 16
    assert tuple(g.params(cells).first())[1:] == (9, 33, 7, 6)


def test_fill_equals_brute_force(spark, plane):
    got = as_array(g.fill(as_grid(spark, plane), k=3, radius=1), plane.shape)
    data = [(i, j) for i in range(10) for j in range(10) if plane[i, j]]
    for i in range(10):
        for j in range(10):
            if plane[i, j] == 0:
                near = sorted(data, key=lambda p: (((p[1] - j) * 0.5) ** 2 + ((p[0] - i) * 2.0) ** 2, p))[:3]
                assert np.isclose(got[i, j], np.mean([plane[p] for p in near]))
            else:
                assert got[i, j] == plane[i, j]


def test_lookup_check_and_resample_on_a_plane(spark):
    i, j = np.indices((6, 8))
    cells = as_grid(spark, 10 + i + 2.0 * j)
    a = g.axes(cells)
    points = spark.createDataFrame([(0.25, 3.0), (3.5, 10.0), (9.0, 1.0)], "lon double, lat double")
    got = {r.lon: r.map_val for r in g.lookup(points, cells, a).collect()}
    assert np.isclose(got[0.25], 10 + 1.5 + 1.0) and np.isclose(got[3.5], 10 + 5 + 14) and got[9.0] is None
    assert not g.check(points, cells, a).first().inside and g.check(points.filter("lon < 1"), cells, a).first().inside
    new = as_array(g.resample(cells, g.Axes(0.1, 0.5, 0.3, 1.0, 5, 4), "n"), (4, 5))
    assert np.isclose(new[2, 3], 10 + (0.5 + 2) / 2 + 2 * (0.1 + 0.9) / 0.5)


def test_border_chain_and_spurs():
    assert g.order_border([0, 0, 0], [0, 2, 1], 1, 1).tolist() == [0, 2, 1]
    m = np.zeros((7, 7), bool)
    m[1:5, 1:5] = True
    m[2:4, 2:4] = False
    m[5, 1] = m[6, 1] = True
    out = g.without_spurs(m)
    assert not out[5:, :].any() and out[1:5, 1:5].sum() == 12


def test_splines_go_through_points_and_keep_planes():
    rng = np.random.default_rng(1)
    a = g.Axes(0, 0, 1, 1, 7, 6)
    v = rng.normal(size=(6, 7))
    s = g.Interpolant(v, a)
    y, x = np.indices(v.shape)
    assert np.allclose(s(y.ravel(), x.ravel()), v.ravel())
    flat = g.Interpolant(1 + 2.0 * y + 3.0 * x, a)
    assert np.isclose(flat(2.3, 4.6), 1 + 4.6 + 13.8) and np.allclose(flat.gradient(2.3, 4.6), [2, 3], atol=1e-5)


def test_continuation_properties():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(16, 20))
    up = lambda x, dz: spectral.continued(x, 1, 1, dz, padded=False)
    assert np.allclose(up(v, 0), v) and np.allclose(up(up(v, 1.0), 2.0), up(v, 3.0)) and np.allclose(up(v, -1), v)
    assert np.std(up(v, 2)) < np.std(v) and spectral.smooth7(11) == 12 and spectral.smooth7(97) == 98
    wide, py, px = spectral.expand(v, 3)
    assert np.array_equal(wide[py : py + 16, px : px + 20], v)
    x, y, z = spectral.vector_components(v, 1, 1, 0.3, 1.0)
    assert np.isclose(x.mean(), v.mean()) and np.isclose(z.mean(), v.mean())
    assert len(spectral.damping_curve(v, 1, 1, -1, [1, 10, 100])) == 3


def test_levels_and_drape(spark):
    i, j = np.indices((12, 12))
    cells = as_grid(spark, 50 + np.sin(i / 2.0) + np.cos(j / 3.0))
    stack = spectral.extend_stack(cells.unionByName(cells.withColumn("alt", F.lit(110.0))), 90.0, 125.0)
    assert sorted(r.alt for r in stack.select("alt").distinct().collect()) == [90, 100, 110, 120, 130]
    flat = spectral.level_drape(cells, 100.0, 1, 1, 0.1, 1.0)
    assert np.allclose(as_array(flat, (12, 12)), as_array(cells, (12, 12)), atol=1e-6)


def test_exponentials_and_dynamics():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4, 6, 6)) * np.array([0.01, 1, 5, 20])[:, None, None] / 6
    for m, got in zip(a, nav.exponential(a)):
        w, v = np.linalg.eig(m)
        assert np.allclose(got, np.real(v @ np.diag(np.exp(w)) @ np.linalg.inv(v)))
    f = nav.dynamics(np.array([[0.7, -1.3, 300.0, 10, 70, 1, 0.1, 0.2, -9.8]]), np.eye(3)[None], nav.Model())[0]
    assert np.allclose(f[3:6, 6:9], -f[3:6, 6:9].T) and np.allclose(f[6:9, 6:9], -f[6:9, 6:9].T) and f[2, 9] == 0.03 and np.isclose(f[4, 6], -9.8)


def track(n=60):
    from fluxlane.plans.navigation import LAT0, LON0, surface

    s, m = surface(), nav.Model(dt=1.0, pos=30.0, noise=1.0)
    lat, lon = np.full(n, LAT0), LON0 + 1.5e-5 * np.arange(n)
    motion = np.column_stack([lat, lon, np.full(n, 300.0), np.zeros(n), np.full(n, 70.0), np.zeros((n, 3)), np.full(n, -9.8)])
    z = s(lat, lon) + np.random.default_rng(4).normal(size=n)
    shown = motion.copy()
    shown[:, 0] += 3e-6
    shown[:, 1] -= 3e-6
    return s, m, motion, shown, np.tile(np.eye(3), (n, 1, 1)), z


def test_filter_finds_the_offset_within_its_bound():
    s, m, motion, shown, cnb, z = track()
    xs, ps, _ = nav.ekf(shown, cnb, z, s, m)
    assert abs(xs[-1, 0] + 3e-6) < 1e-6 and abs(xs[-1, 1] - 3e-6) < 1e-6
    bound = nav.lower_bound(motion, cnb, s, m)
    assert all(np.linalg.eigvalsh(p).min() > -1e-9 for p in bound[::20]) and np.all(np.diagonal(bound[-1])[:2] <= np.diagonal(bound[0])[:2])
    xs, _, done = nav.particle_filter(shown, cnb, z, s, m, 400)
    assert done and abs(xs[-1, 0] + 3e-6) < 2e-6
    xs, _, _ = nav.ekf(shown, cnb, z, s, nav.replace(m, noise_limits=(0.5, 50.0)))
    assert abs(xs[-1, 0] + 3e-6) < 2e-6
    design = np.column_stack([np.sin(np.arange(60.0)), np.cos(np.arange(60.0) / 3)])
    xs, _, _ = nav.ekf(shown, cnb, z + design @ [30.0, -20.0], s, nav.replace(m, extra=(50.0, 50.0)), design, np.zeros(2))
    assert np.allclose(xs[-1, 17:19], [30, -20], atol=3)


def test_stepwise_equals_batch(spark):
    s, m, _, shown, cnb, z = track(20)
    xs, _, rs = nav.ekf(shown, cnb, z, s, m)
    state = None
    for i in range(20):
        state, x, _, r = nav.step(state, float(i), shown[i], cnb[i], float(z[i]), s, m)
        assert np.allclose(x, xs[i], rtol=1e-9, atol=1e-15) and np.isclose(r, rs[i])
    again, x, _, r = nav.step(state, 19.0, shown[0], cnb[0], 0.0, s, m)
    assert again is state and np.isnan(r)
    rows = [(1, float(i), *map(float, shown[i]), [float(v) for v in np.eye(3).ravel()], float(z[i])) for i in range(20)]
    df = spark.createDataFrame(rows, "line long, tt double, " + ", ".join(f"{c} double" for c in nav.MOTION) + ", cnb array<double>, z double")
    streamed = {r.tt: r for r in realtime.filter_stream(df, s, m).collect()}
    batch = {r.tt: r for r in nav.run_filter(df, Order(("line",), ("tt",)), s, m).collect()}
    assert len(streamed) == 20 and all(np.isclose(streamed[t].d_lat, batch[t].x[0], rtol=1e-9) for t in batch)
    with pytest.raises(ValueError):
        nav.run_filter(df, Order(("line",), ("tt",)), s, m, "other")


def test_streamed_query_has_all_lines(spark):
    from fluxlane.plans import navigation

    sf = "/root/testdata/sf0.001"
    streamed = {(r.line, r.tt): r.d_lat for r in navigation.stream_ekf(spark, sf).collect()}
    rows = navigation.measured(navigation.path(spark, sf))
    batch = {(r.line, r.tt): r.x[0] for r in nav.run_filter(rows, navigation.PATH, navigation.surface(), navigation.MODEL).collect()}
    assert set(streamed) == set(batch) and len(streamed) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert all(np.isclose(streamed[k], batch[k], rtol=1e-9, atol=1e-15) for k in batch)
    none = realtime.filter_stream(rows.filter("line is null"), navigation.surface(), navigation.MODEL)
    assert none.collect() == [] and none.columns == ["line", "tt", "d_lat", "d_lon", "bias", "residual"]


def test_queries_run_with_the_operators_defaults(spark, monkeypatch):
    import inspect

    from fluxlane.operators import networks
    from fluxlane.plans import navigation

    seen = {}
    for module, name in ((nav, "run_filter"), (networks, "shapley")):

        def noted(*a, _f=getattr(module, name), _name=name, **b):
            seen[_name] = inspect.signature(_f).bind(*a, **b).arguments
            return _f(*a, **b)

        monkeypatch.setattr(module, name, noted)
    navigation.particle_track(spark, "/root/testdata/sf0.001")
    navigation.network_importance(spark, "/root/testdata/sf0.001")
    assert "particles" not in seen["run_filter"] and "draws" not in seen["shapley"]


def test_chi_square_and_resampling():
    assert np.isclose(nav.chi_square_quantile(0.95, 2), 5.991464547) and np.isclose(nav.chi_square_quantile(0.95, 1), 3.841458821) and np.isclose(nav.chi_square_cdf(7.814727903, 3), 0.95)
    assert nav.resample(np.array([0.0, 1.0, 0.0]), 0.5).tolist() == [1, 1, 1]


def test_simulated_flights_repeat():
    from fluxlane.plans.navigation import LAT0, LON0, surface

    f = simulate.Flight(seconds=5, lat=LAT0 + 0.003, lon=LON0 + 0.003)
    a, b = simulate.flight(f, surface(), 5), simulate.flight(f, surface(), 5)
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 51 and np.abs(a["ins_lat"] - a["lat"]).max() < 1e-5
    c = simulate.euler_matrices(np.array([0.1]), np.array([0.2]), np.array([0.3]))[0]
    assert np.allclose(c @ c.T, np.eye(3))


def test_text_survey_and_lookup(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("/ header\nline tt mag\n1  2.5 *\n1 3.5 7\n 2 1.0 8 9\n2 4 5\n")
    df = tables.read_xyz_text(spark, str(tmp_path / "a.xyz"), ["line", "tt", "mag"])
    rows = df.collect()
    assert [(r.line, r.tt) for r in rows] == [(1, 2.5), (1, 3.5), (2, 4)] and np.isnan(rows[0].mag)
    assert tables.keep_lines(df, [(1, 3, 9)]).count() == 1 and tables.keep_lines(df, [(1, 3, 9)], exclude=True).count() == 2
    (tmp_path / "f.csv").write_text("tt,lat\n1,90\n")
    r = tables.read_flight_csv(spark, str(tmp_path / "f.csv"), ["tt", "lat", "lon"]).first()
    assert np.isclose(r.lat, np.pi / 2) and np.isnan(r.lon)
    (tmp_path / "l.csv").write_text("﻿flight,tt\nx,1.5\n", encoding="utf-8")
    assert tables.read_lookup_csv(spark, str(tmp_path / "l.csv")).columns == ["flight", "tt", "row"]


def test_maps_models_and_paths(spark, tmp_path):
    for name, text in (("map", "1,2\n3,NaN\n"), ("xx", "10\n20\n"), ("yy", "30\n40\n"), ("alt", "300\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    cells = tables.read_map_csv(spark, str(tmp_path), "m")
    assert {(r.iy, r.ix): r.val for r in cells.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 0}
    tables.write_grid(cells, str(tmp_path / "grid"))
    assert tables.read_grid(spark, str(tmp_path / "grid"), "m").count() == 4
    tables.save_model(spark, {"k": 3, "coef": np.array([1.0])}, str(tmp_path / "model"))
    assert tables.load_model(spark, str(tmp_path / "model"), {"other": 1}) == {"k": 3, "coef": [1.0], "other": 1}
    kml = tables.path_kml(spark.createDataFrame([(0, 0.1, 0.2, 5.0), (1, 0.1, 0.3, 5.0)], "t int, lat double, lon double, alt double"), ["t"])
    assert "11.4591559,5.7295780,5.00" in kml
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    assert tables.compare_fields(a, a.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 0.5).otherwise(0.0)), ["k"]).first().difference == 0.5
    assert tables.with_extension("a.CSV", ".csv") == "a.csv" and set(tables.with_fields(a, ["w"]).columns) == {"k", "v", "w"}
    with pytest.raises(ValueError):
        tables.has_fields(a, {"v": "string"})


def test_grids_of_two_maps_are_refused(spark):
    one = spark.createDataFrame([("a", y, x, float(y), float(x), 1.0 + x) for y in range(3) for x in range(3)], "map_name string, iy int, ix int, yy double, xx double, val double")
    two = one.union(one.withColumn("map_name", F.lit("b")))
    assert g.axes(one).nx == 3
    for call in (lambda: g.axes(two), lambda: g.fill(two), lambda: g.combine(one, two), lambda: g.interpolant(two)):
        with pytest.raises(ValueError):
            call()


def test_slopes_of_a_patch_equal_differences():
    rng = np.random.default_rng(4)
    s = g.Interpolant(rng.normal(size=(6, 7)), g.Axes(1.0, 2.0, 0.5, 0.25, 7, 6))
    for lat, lon in [(2.3, 1.7), (2.0, 1.0), (3.24, 3.99), (0.0, 9.0)]:
        value, slopes = s.value_and_slopes(lat, lon)
        d = 1e-6
        inside = 2.01 < lat < 3.24 and 1.01 < lon < 3.99
        assert np.isclose(value, float(s(lat, lon)))
        if inside:
            assert np.allclose(slopes, [(s(lat + d, lon) - s(lat - d, lon)) / (2 * d), (s(lat, lon + d) - s(lat, lon - d)) / (2 * d)], atol=1e-5)
    assert s.value_and_slopes(0.0, 9.0)[1].tolist() == [0.0, 0.0]


def test_a_utm_map_becomes_a_map_in_radians(spark):
    """A plane in metres of a zone, looked up at the metres of each new cell."""
    e0, n0, step = 440_000.0, 4_980_000.0, 500.0
    rows = [("u", y, x, n0 + y * step, e0 + x * step, 1000 + 3.0 * x + 2.0 * y) for y in range(40) for x in range(40)]
    utm = spark.createDataFrame(rows, "map_name string, iy int, ix int, yy double, xx double, val double")
    at = spark.range(1).select(*geodesy.from_utm(F.lit(e0 + 10 * step), F.lit(n0 + 10 * step), F.lit(18), F.lit(True))).first()
    new = g.Axes(at[1], at[0], 2e-5, 2e-5, 20, 20)
    got = g.from_utm(utm, 18, new)
    east, north = geodesy.to_utm(F.col("yy"), F.col("xx"), F.lit(18))
    errors = got.select(F.abs(F.col("val") - (1000 + 3 * (east - e0) / step + 2 * (north - n0) / step)).alias("e")).agg(F.max("e"), F.count("*")).first()
    assert errors[0] < 1e-6 and errors[1] == 400
    far = g.from_utm(utm, 18, g.Axes(at[1] + 1, at[0], 2e-5, 2e-5, 2, 2))
    assert {r.val for r in far.collect()} == {0.0}


def test_utm_of_known_places(spark):
    """Central meridian at 45 degrees: half the meridian arc's known length (4,984,944.378 m) times the scale; and the zones' edges."""
    lat, lon = F.radians(F.lit(45.0)), F.radians(F.lit(-75.0))
    east, north = geodesy.to_utm(lat, lon, F.lit(18))
    r = spark.range(1).select(east.alias("e"), north.alias("n"), geodesy.utm_zone(lon).alias("z"), geodesy.utm_zone(F.radians(F.lit(180.0))).alias("last")).first()
    assert abs(r.e - 500_000) < 1e-6 and abs(r.n - 0.9996 * 4_984_944.378) < 2e-3 and (r.z, r.last) == (18, 1)


def by_hand(motion, cnb, z, s, m, extra=None, factor=None):
    """The Kalman filter of one line, sample by sample, as it is written in books."""
    phi, q = nav.transition(motion, cnb, m), nav.process_noise(m)
    x, p, xs, ps, last = np.zeros(m.size), nav.initial_covariance(m, motion[0, 0]), [], [], []
    for i in range(len(z)):
        value, slopes = s.value_and_slopes(motion[i, 0] + x[0], motion[i, 1] + x[1])
        h = np.zeros(m.size)
        h[:2], h[-1] = slopes, 1
        if extra is not None:
            h[17 : 17 + extra.shape[1]] = extra[i]
        residual = z[i] - value - x[-1] - (0 if extra is None else extra[i] @ x[17 : 17 + extra.shape[1]])
        spread = h @ p @ h
        noise = m.noise
        if m.noise_limits:
            noise = np.mean(m.noise_limits) if len(last) < 10 else np.clip(np.mean(np.square(last[-10:])) - spread, *m.noise_limits)
        gain = p @ h / (spread + noise * (1 if factor is None else 1 + factor[i]))
        x, p = x + gain * residual, p - np.outer(gain, h @ p)
        xs.append(x)
        ps.append(np.diag(p))
        last.append(residual)
        x, p = phi[i] @ x, phi[i] @ p @ phi[i].T + q
    return np.array(xs), np.array(ps)


def lines_of(sizes):
    """Lines of different lengths over the same map, one behind the other."""
    parts = [track(n) for n in sizes]
    s, m = parts[0][:2]
    motion, cnb = np.concatenate([t[3] for t in parts]), np.concatenate([t[4] for t in parts])
    motion[:, 0] += np.repeat(np.arange(len(sizes)) * 1e-6, sizes)
    return s, m, motion, cnb, np.concatenate([t[5] for t in parts])


@pytest.mark.parametrize("kind", ["plain", "adaptive", "online", "noise"])
def test_lines_step_together(kind):
    sizes = np.array([7, 30, 1, 18])
    s, m, motion, cnb, z = lines_of(sizes)
    m = {"adaptive": nav.replace(m, noise_limits=(0.5, 50.0)), "online": nav.replace(m, extra=(5.0, 5.0))}.get(kind, m)
    design = np.column_stack([np.sin(np.arange(len(z))), np.cos(np.arange(len(z)) / 3)]) if kind == "online" else None
    factor = np.arange(len(z)) % 4 / 2 if kind == "noise" else None
    cut = lambda a, part: None if a is None else a[part]
    begins = np.cumsum(sizes) - sizes
    state = nav.State.new(m, motion[begins, 0])
    xs, ps, _ = nav.filter_lines(state, sizes, motion, cnb, z, s, m, design, factor, full=False)
    for at, n in zip(begins, sizes, strict=True):
        part = slice(at, at + n)
        x, p = by_hand(motion[part], cnb[part], z[part], s, m, cut(design, part), cut(factor, part))
        assert np.allclose(xs[part], x, rtol=1e-6, atol=1e-13) and np.allclose(ps[part], p, rtol=1e-6, atol=1e-20)
    # a line that is cut goes on from the state that was left
    first = nav.State.new(m, motion[7:8, 0])
    halves = [nav.filter_lines(first, np.array([15]), motion[c], cnb[c], z[c], s, m, cut(design, c), cut(factor, c))[0] for c in (slice(7, 22), slice(22, 37))]
    assert np.allclose(np.concatenate(halves), xs[7:37], rtol=1e-9, atol=1e-14) and first.seen[0] == 30


def test_lines_run_on_over_batches(spark):
    """Partitions stream through in batches smaller than their lines, and no batch is a line."""
    sizes = np.array([25, 3, 40])
    s, m, motion, cnb, z = lines_of(sizes)
    line, tt = np.repeat(np.arange(3), sizes), np.concatenate([np.arange(n) for n in sizes])
    rows = [(int(k), float(t), *map(float, v), [float(c) for c in np.eye(3).ravel()], float(y)) for k, t, v, y in zip(line, tt, motion, z, strict=True)]
    df = spark.createDataFrame(rows[::-1], "line long, tt double, " + ", ".join(f"{c} double" for c in nav.MOTION) + ", cnb array<double>, z double").coalesce(1)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    order, found = Order(("line",), ("tt",)), {}
    try:
        for kind in ("ekf", "crlb", "particle"):
            for size in (8, 10_000):
                spark.conf.set(key, size)
                plan = nav.run_filter(df, order, s, m, kind, particles=50, full=False)
                assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
                found[kind, size] = sorted((r.line, r.tt, *r.x, *r.p, r.residual or 0, r.converged) for r in plan.collect())
            assert len(found[kind, 8]) == len(z) and np.allclose(found[kind, 8], found[kind, 10_000], rtol=1e-9, atol=1e-18)
    finally:
        spark.conf.set(key, before)
    bound = nav.lower_bound(motion[:25], cnb[:25], s, m)
    assert np.allclose([r[20:38] for r in found["crlb", 8][:25]], np.diagonal(bound, axis1=1, axis2=2), rtol=1e-9)
    xs, ps, _ = nav.particle_filter(motion[28:], cnb[28:], z[28:], s, m, 50)
    assert np.allclose([r[2:20] for r in found["particle", 8][28:]], xs, rtol=1e-9, atol=1e-15) and np.allclose([r[20:38] for r in found["particle", 8][28:]], np.diagonal(ps, axis1=1, axis2=2), rtol=1e-9)


def test_surfaces_agree_in_few_and_many_cells():
    from fluxlane.plans.navigation import LAT0, LON0, surface

    s, rng = surface(), np.random.default_rng(6)
    for spread in (1e-7, 3e-6, 2e-5, 5e-3):  # one cell, a few, many, and beyond the edges
        lat, lon = LAT0 + spread * rng.normal(size=300), LON0 + spread * rng.normal(size=300)
        one = [s.value_and_slopes(a, b) for a, b in zip(lat, lon, strict=True)]
        values, slopes = s.values_and_slopes(lat, lon)
        assert np.allclose(s(lat, lon), [v for v, _ in one], rtol=1e-10, atol=1e-9) and np.allclose(values, [v for v, _ in one], rtol=1e-10, atol=1e-9)
        assert np.allclose(slopes, [g for _, g in one], rtol=1e-9, atol=1e-3)
