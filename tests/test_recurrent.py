"""Recurrent networks against step-by-step loops, and gradients through filters against differences."""

import numpy as np
import pytest
from fluxlane.operators import grid as g
from fluxlane.operators import navigation as nav
from fluxlane.operators import recurrent
from fluxlane.operators.networks import Network
from fluxlane.operators.select import Order

LINES = Order(("line",), ("tt",))


def net_of(n_in=2, hidden=3, activation="swish", seed=1):
    rng = np.random.default_rng(seed)
    net = recurrent.Recurrent.create(n_in, hidden, rng, activation)
    net.b += rng.normal(size=net.b.shape) * 0.2
    net.bo += 0.3
    return net


def by_steps(net, x):
    """Outputs of one sequence, number by number."""
    k = net.hidden
    h, c, out = np.zeros(k), np.zeros(k), []
    s = lambda v: 1 / (1 + np.exp(-v))
    for row in x:
        z = [sum(row[j] * net.wx[j, q] for j in range(len(row))) + sum(h[j] * net.wh[j, q] for j in range(k)) + net.b[q] for q in range(4 * k)]
        c = np.array([s(z[k + q]) * c[q] + s(z[q]) * np.tanh(z[2 * k + q]) for q in range(k)])
        h = np.array([s(z[3 * k + q]) * np.tanh(c[q]) for q in range(k)])
        y = float(h @ net.wo[:, 0] + net.bo[0])
        out.append(y * s(y) if net.activation == "swish" else y)
    return out


def lines(spark, lengths=(1, 7, 40, 3, 25)):
    rng = np.random.default_rng(6)
    rows = [(n, float(t), *map(float, rng.normal(size=2)), "clash") for n, k in enumerate(lengths) for t in range(k)]
    rng.shuffle(rows)
    return spark.createDataFrame([(int(a), float(b), float(c), float(d), e) for a, b, c, d, e in rows], "line long, tt double, f1 double, f2 double, _x0 string").drop("_x0")


@pytest.mark.parametrize("batch", [1, 4, 10_000])
def test_predictions_equal_a_loop_at_any_batch_size(spark, batch):
    net, rows = net_of(), lines(spark)
    data = sorted((r.line, r.tt, r.f1, r.f2) for r in rows.collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        full = sorted((r.line, r.tt, r.y_hat) for r in recurrent.predict_full(rows, LINES, ["f1", "f2"], net).collect())
        windowed = {w: sorted((r.line, r.tt, r.y_hat) for r in recurrent.predict_windowed(rows, LINES, ["f1", "f2"], net, w).collect()) for w in (1, 4)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for line in {r[0] for r in data}:
        x = np.array([r[2:] for r in data if r[0] == line])
        assert np.allclose([y for n, _, y in full if n == line], by_steps(net, x))
        for w, found in windowed.items():
            assert np.allclose([y for n, _, y in found if n == line], [by_steps(net, x[max(0, j - w + 1) : j + 1])[-1] for j in range(len(x))])


def test_nulls_and_empty_tables(spark):
    net = net_of()
    rows = spark.createDataFrame([(1, 0.0, 1.0, 1.0), (1, 1.0, None, 1.0), (1, 2.0, 1.0, 1.0), (1, 3.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)], "line long, tt double, f1 double, f2 double")
    full = {(r.line, r.tt): r.y_hat for r in recurrent.predict_full(rows, LINES, ["f1", "f2"], net).collect()}
    assert full[1, 0.0] == full[None, 0.0] is not None and full[1, 1.0] is full[1, 3.0] is None
    windowed = {(r.line, r.tt): r.y_hat for r in recurrent.predict_windowed(rows, LINES, ["f1", "f2"], net, 2).collect()}
    assert windowed[1, 2.0] is None and windowed[1, 3.0] is not None
    assert recurrent.predict_full(rows.limit(0), LINES, ["f1", "f2"], net).count() == 0


@pytest.mark.parametrize("activation", ["swish", "identity", "tanh"])
def test_gradients_equal_differences(activation):
    rng = np.random.default_rng(3)
    net, x, pull = net_of(activation=activation), rng.normal(size=(6, 4, 2)), rng.normal(size=(6, 4))
    y, kept = net.forward(x)
    grads = net.backward(pull, kept)
    for p, got in zip(net.parameters(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[::3]:
            was, ends = p[at], []
            for sign in (1, -1):
                p[at] = was + sign * 1e-6
                ends.append(float((net.forward(x)[0] * pull).sum()))
            p[at] = was
            assert np.isclose(got[at], (ends[0] - ends[1]) / 2e-6, atol=1e-6)


def surface():
    a = g.Axes(-1.3091, 0.7852, 5.5e-5, 4e-5, 60, 60)
    y, x = np.indices((60, 60))
    return g.Interpolant(300 * np.sin(x / 4.0) + 250 * np.cos(y / 5.0 + x / 9.0), a)


def test_curvature_equals_differences():
    s, rng = surface(), np.random.default_rng(2)
    lat, lon = 0.7852 + rng.uniform(5, 50, 20) * 4e-5, -1.3091 + rng.uniform(5, 50, 20) * 5.5e-5
    value, slope, curve = s.curved(lat, lon)
    assert np.allclose(value, s(lat, lon))
    d = 1e-9
    for n, (dy, dx) in enumerate(((d, 0), (0, d))):
        up, down = s.curved(lat + dy, lon + dx), s.curved(lat - dy, lon - dx)
        assert np.allclose(slope[:, n], (up[0] - down[0]) / (2 * d), rtol=1e-4, atol=50)
        assert np.allclose(curve[:, n : n + 2], (up[1] - down[1]) / (2 * d), rtol=1e-3, atol=1e6)
    edge = s.curved(np.array([0.0]), np.array([-2.0]))
    assert np.all(edge[1] == 0) and np.all(edge[2] == 0)


def windows(m, steps=12, n=3):
    rng = np.random.default_rng(8)
    motion = np.tile([0.7862, -1.308, 300.0, 1.0, 70.0, 0.1, 0.1, 0.2, -9.8], (steps, n, 1))
    motion[..., 1] += 1.4e-5 * np.arange(steps)[:, None] + 1e-5 * np.arange(n)
    truth = motion[..., :2] + [3e-6, -4e-6]
    s = surface()
    z = s(truth[..., 0], truth[..., 1]) + rng.normal(size=(steps, n)) * 3
    phi = nav.transition(motion.reshape(-1, 9), np.tile(np.eye(3), (steps * n, 1, 1)), m).reshape(steps, n, m.size, m.size)
    p0 = np.stack([nav.initial_covariance(m, 0.786)] * n)
    return recurrent.Windows(phi, z, motion[..., :2], truth, rng.normal(size=(steps, n, 2)), p0, nav.process_noise(m)), motion


def test_filter_steps_equal_the_filter():
    m, s = nav.Model(dt=1.0, pos=30.0, noise=4.0), surface()
    w, motion = windows(m)
    scale = np.abs(np.sin(np.arange(12)))
    xs, ps, _ = nav.ekf(motion[:, 1], np.tile(np.eye(3), (12, 1, 1)), w.z[:, 1], s, m, noise_factor=scale, p0=w.p0[1])
    x, p = np.zeros((3, m.size)), w.p0
    for t in range(12):
        x, p, _ = recurrent.filter_step(s, m, w.place[t], w.phi[t], w.q, w.z[t], np.full(3, scale[t]), x, p)
        assert np.allclose(x[1], w.phi[t][1] @ xs[t], rtol=1e-6) and np.allclose(p[1], w.phi[t][1] @ ps[t] @ w.phi[t][1].T + w.q, rtol=1e-6)


def test_gradient_through_the_filter_equals_differences():
    m, s, net = nav.Model(dt=1.0, pos=30.0, noise=4.0), surface(), net_of(2, 2)
    w, _ = windows(m)
    loss, grads = recurrent.noise_loss(net, w, s, m)
    assert loss.shape == (3,) and (loss > 0).all()
    for p, got in zip(net.parameters(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[::2]:
            was, ends = p[at], []
            for sign in (1, -1):
                p[at] = was + sign * 1e-4
                ends.append(float(recurrent.noise_loss(net, w, s, m, False)[0].sum()))
            p[at] = was
            assert np.isclose(got[at], (ends[0] - ends[1]) / 2e-4, rtol=1e-4, atol=1e-6)


def flights(spark, m, lines=5, steps=25):
    rows = []
    for n in range(lines):
        w, motion = windows(m, steps, lines)
        for t in range(steps):
            rows.append((n, float(t), *map(float, motion[t, n]), [float(v) for v in np.eye(3).ravel()], float(w.z[t, n]), float(w.truth[t, n, 0]), float(w.truth[t, n, 1]), *map(float, w.x[t, n])))
    names = ", ".join(f"{c} double" for c in nav.MOTION)
    return spark.createDataFrame(rows, f"line long, tt double, {names}, cnb array<double>, z double, true_lat double, true_lon double, f1 double, f2 double")


def test_training_sums_windows_and_lowers_the_loss(spark):
    m, s = nav.Model(dt=1.0, pos=30.0, noise=4.0), surface()
    rows = flights(spark, m)
    net, losses = recurrent.fit_noise(rows, LINES, s, m, ["f1", "f2"], hidden=2, window=10, epochs=6, rate=0.05)
    assert len(losses) == 7 and losses[-1] < losses[0]
    # the first epoch's loss, window by window
    start, parts = recurrent.Recurrent.create(2, 2, np.random.default_rng(2)), []
    data = sorted(rows.collect(), key=lambda r: (r.line, r.tt))
    for line in range(5):
        own = [r for r in data if r.line == line]
        for at in (0, 10):
            motion = np.array([[r[c] for c in nav.MOTION] for r in own[at : at + 10]])
            take = lambda *c, at=at, own=own: np.array([[r[k] for k in c] for r in own[at : at + 10]])
            phi = nav.transition(motion, np.tile(np.eye(3), (10, 1, 1)), m)[:, None]
            w = recurrent.Windows(phi, take("z"), motion[:, None, :2], take("true_lat", "true_lon")[:, None], take("f1", "f2")[:, None], nav.initial_covariance(m, motion[0, 0])[None], nav.process_noise(m))
            parts.append(recurrent.noise_loss(start, w, s, m, False)[0][0])
    assert np.isclose(losses[0], np.mean(parts))
    assert recurrent.fit_noise(rows.limit(0), LINES, s, m, ["f1", "f2"], epochs=2)[1] == []
    scaled = recurrent.predict_full(rows, LINES, ["f1", "f2"], net, "r_nn")
    assert nav.run_filter(scaled, LINES, s, m, "noise", noise_factor="r_nn").count() == 125


def test_network_without_hidden_layer_is_the_online_filter(spark):
    """Weights as states: a linear network's are the coefficients of its inputs and of one."""
    m, s = nav.Model(dt=1.0, pos=30.0, noise=4.0, extra=(1.0, 1.0, 2.0)), surface()
    rows = flights(spark, m, 3, 20).withColumn("one", nav.F.lit(1.0))
    rows = rows.withColumn("z", nav.F.col("z") + 3 * nav.F.col("f1") - 2 * nav.F.col("f2") + 1)
    net = Network([(np.array([[0.5], [-0.25]]), np.array([0.75]))])
    key = lambda df: sorted((r.line, r.tt, list(r.x), list(r.p), r.residual) for r in df.collect())
    learnt = key(nav.run_filter(rows, LINES, s, m, "network", extra=("f1", "f2"), network=nav.LearntNetwork(net)))
    online = key(nav.run_filter(rows, LINES, s, m, "online", extra=("f1", "f2", "one"), x0=(0.5, -0.25, 0.75)))
    for a, b in zip(learnt, online, strict=True):
        assert np.allclose(a[2], b[2]) and np.allclose(a[3], b[3]) and np.isclose(a[4], b[4])
    with pytest.raises(ValueError):
        nav.run_filter(rows, LINES, s, nav.Model(), "network", extra=("f1", "f2"), network=nav.LearntNetwork(net))


def test_hidden_network_is_relinearised_each_sample():
    """The filter's measurement follows the network at the weights of the moment."""
    rng = np.random.default_rng(1)
    net = nav.LearntNetwork(Network([(rng.normal(size=(2, 3)), rng.normal(size=3)), (rng.normal(size=(3, 1)), rng.normal(size=1))], "tanh"), 5.0, 2.0)
    w, x = net.weights, rng.normal(size=2)
    value, slopes = net.at(x, w)
    assert np.isclose(value, float(net.net(x[None])[0, 0]) * 2 + 5)
    for n in range(len(w)):
        d = np.zeros(len(w))
        d[n] = 1e-6
        assert np.isclose(slopes[n], (net.at(x, w + d)[0] - net.at(x, w - d)[0]) / 2e-6, atol=1e-6)


def test_windows_of_a_batch_are_read_as_arrays():
    import pyarrow as pa

    rng, n, steps = np.random.default_rng(8), 3, 4
    columns = {c: rng.normal(size=(n, steps)) * 0.01 + 0.7 for c in [*nav.MOTION, "z", "true_lat", "true_lon", "f1"]}
    arrays = {c: pa.array(v.tolist()) for c, v in columns.items()} | {"cnb": pa.array(rng.normal(size=(n, steps, 9)).tolist())}
    b = pa.record_batch(arrays).slice(1, 2)
    w = recurrent._windows(b, {"z": ["z"], "truth": ["true_lat", "true_lon"], "x": ["f1"]}, nav.Model())
    assert np.array_equal(w.z, columns["z"][1:].T) and np.array_equal(w.truth[2, 1], [columns["true_lat"][2, 2], columns["true_lon"][2, 2]])
    motion = np.stack([columns[c][2] for c in nav.MOTION], 1)
    cnb = np.array(arrays["cnb"].to_pylist())[2].reshape(-1, 3, 3)
    assert np.allclose(w.phi[:, 1], nav.transition(motion, cnb, nav.Model()), rtol=1e-12, atol=1e-15)
