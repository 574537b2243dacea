import numpy as np
import pytest
from fluxlane.functions import geodesy
from fluxlane.operators import compensation, features, linear, networks, tolles_lawson
from fluxlane.operators.select import Order
from pyspark.sql import functions as F

ORDER = Order(("line",), ("t",))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 120
    turn = np.linspace(0, 9, n)
    b = 50000 * np.stack([np.cos(turn) * np.cos(turn / 3), np.sin(turn) * np.cos(turn / 3), np.sin(turn / 3)], 1)
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3
    rows = [(i // 60, i, *map(float, b[i]), *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "line int, t int, bx double, by double, bz double, f1 double, f2 double, f3 double, y double")


def test_constants_of_latitude(spark):
    lat = F.lit(np.deg2rad(39.16066735024198))
    r = spark.range(1).select(geodesy.north_to_lat(F.lit(1.0), lat).alias("a"), geodesy.east_to_lon(F.lit(1.0), lat).alias("b")).first()
    assert np.isclose(r.a, 1.565761736512648e-07, rtol=1e-12) and np.isclose(r.b, 2.019352321699552e-07, rtol=1e-12)


def test_attitude_round_trip_and_tilt(spark):
    c = geodesy.body_to_nav(F.lit(0.3), F.lit(-0.2), F.lit(2.5))
    r = spark.range(1).select(*[v.alias(n) for v, n in zip(geodesy.euler_of(c), "rpy")], *[v.alias(f"t{i}{j}") for i, row in enumerate(geodesy.tilted(c, [F.lit(0.0)] * 3)) for j, v in enumerate(row)], *[v.alias(f"c{i}{j}") for i, row in enumerate(c) for j, v in enumerate(row)]).first()
    assert np.allclose([r.r, r.p, r.y], [0.3, -0.2, 2.5]) and all(r[f"t{i}{j}"] == r[f"c{i}{j}"] for i in range(3) for j in range(3))


def test_days_by_fourth_years(spark):
    df = spark.createDataFrame([(1900.0,), (2000.0,), (2021.0,)], "y double").select(geodesy.days_in_year(F.col("y")).alias("d"))
    assert [r.d for r in df.collect()] == [366, 366, 365]


def test_ridge_and_least_squares(table):
    x = np.array([[r.f1, r.f2, r.f3] for r in table.collect()])
    y = np.array([r.y for r in table.collect()])
    assert np.allclose(linear.ridge(table, ["f1", "f2", "f3"], "y", 0.7), np.linalg.solve(x.T @ x + 0.7 * np.eye(3), x.T @ y))
    m = linear.moments(table, ["f1", "f2", "f3"], "y")
    assert np.allclose(linear.partial_least_squares(m, 3)[-1], [1, -2, 0.5])  # as many components as columns: least squares
    coef, bias = linear.elastic_net(m, 0.5, 1e-9)
    assert np.allclose(coef, [1, -2, 0.5], atol=1e-5) and np.isclose(bias, 0.3, atol=1e-5)
    assert np.allclose(linear.elastic_net(m, 1.0, 100.0)[0], 0)
    w, predictor = linear.kernel_ridge(x, y, 0.5)
    c = linear.kernel_ridge_moments(m, 0.5)
    assert np.allclose(predictor(x), c[0] + x @ c[1:])
    v = linear.whitening(m)
    assert np.allclose(np.cov((x @ v).T), np.eye(3))


def test_norms_round_trip_and_constant_columns(table):
    df = table.withColumn("one", F.lit(2.0))
    for kind in linear.NORMS:
        stats = linear.norm_stats(df, ["f1", "one"], kind, exempt=("one",) if kind == "scale" else ())
        if kind in ("standardize", "normalize"):
            assert linear.normalized(df, stats).filter("one is not null").count() == 0
        back = linear.denormalized(linear.normalized(df, {"f1": stats["f1"]}), {"f1": stats["f1"]})
        assert np.allclose([r.f1 for r in back.collect()], [r.f1 for r in df.collect()])
    with pytest.raises(ValueError):
        linear.norm_stats(df, ["f1"], "other")


def test_matrix_recovers_known_coefficients(table):
    terms = ["permanent", "induced", "eddy"]
    names = tolles_lawson.columns(terms)
    assert len(names) == 18 and tolles_lawson.columns(["e", "i", "p"]) == names
    assert len(tolles_lawson.columns(["p3", "i5", "e8", "f", "b"])) == 20
    wide = tolles_lawson.with_matrix(table, ORDER, "bx", "by", "bz", ["p", "e3"])
    true = np.arange(1.0, 7.0)
    used = tolles_lawson.columns(["p", "e3"])
    wide = wide.withColumn("mag", linear.predict([F.col(c) for c in used], true))
    assert np.allclose(linear.ridge(wide, used, "mag"), true, rtol=1e-4)
    coef, variance = tolles_lawson.fit(wide.drop(*used), ORDER, "bx", "by", "bz", "mag", ["p", "e3"], band=(-1, -1))
    assert np.allclose(coef, true, rtol=1e-4) and abs(variance) < 1e-6
    with pytest.raises(ValueError):
        tolles_lawson.columns(["nothing"])


@pytest.mark.parametrize("terms", [["p", "i", "e"], ["p", "i5", "e8"], ["i3", "e3"], ["p"]])
def test_coefficients_round_trip(terms):
    n = len(tolles_lawson.columns(terms))
    c = np.arange(1.0, n + 1)
    assert np.allclose(tolles_lawson.to_vector(*tolles_lawson.to_matrices(c, terms), terms), c)
    assert sum(tolles_lawson.term_mask(t, terms).sum() for t in terms) == n


def test_aircraft_field_along_the_earths_is_the_matrix(table, spark):
    c = np.linspace(-1, 1, 18)
    wide = tolles_lawson.with_matrix(table, ORDER, "bx", "by", "bz")
    from fluxlane.operators.sequence import difference

    names = ["bx", "by", "bz"]
    wide = wide.withColumns({f"d{n}": difference(F.col(n), ORDER) for n in names})
    field = tolles_lawson.aircraft_field([F.col(n) for n in names], [F.col(f"d{n}") for n in names], *tolles_lawson.to_matrices(c, ["p", "i", "e"]))
    total = F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2 + F.col("bz") ** 2)
    along = geodesy.dot(field, [F.col(n) / total for n in names])
    both = wide.select(along.alias("a"), linear.predict([F.col(n) for n in tolles_lawson.columns(["p", "i", "e"])], c).alias("b")).collect()
    assert np.allclose([r.a for r in both], [r.b for r in both])


def test_rotation_is_found(table):
    t = 0.7
    r = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    df = table.withColumns({f"r{c}": F.col(c) for c in ("f1", "f2", "f3")})
    df = linear.rotated(df, ["rf1", "rf2", "rf3"], r)
    assert np.allclose(linear.best_rotation(df, ["f1", "f2", "f3"], ["rf1", "rf2", "rf3"]), r)


def test_features_by_name(table):
    s = features.Setup(scalars={"m1": "f1", "m2": "f2"}, vectors={"flux": ("bx", "by", "bz")}, attitude=("f1", "f2", "f3"), subtract=("f3",), currents=("y",), terms=("p",))
    df, names = features.matrix(table, ORDER, ["m1", "m1_dot4", "m1_lag_2", "mag_1_2", "dcm", "crcpcy", "roll_sin_fdm", "lpf_y", "TL_A_flux", "f3"], s)
    assert len(names) == 4 + 9 + 1 + 1 + 1 + 3 + 1 and set(names) <= set(df.columns)
    r = df.filter("t = 5").first()
    assert np.isclose(r.m1, r.f1 - r.f3) and np.isclose(r.mag_1_2, r.f1 - r.f2) and np.isclose(r.crcpcy, np.cos(r.f1) * np.cos(r.f2) * np.cos(r.f3))
    features.assert_complete(df, names)
    with pytest.raises(ValueError):
        features.assert_complete(df.withColumn("f3", F.lit(float("nan"))), ["f3"])
    with pytest.raises(ValueError):
        features.matrix(table, ORDER, ["nothing"], s)
    with pytest.raises(ValueError):
        features.target("z", F.col("y"), F.col("y"))


def test_gradients_of_networks():
    rng = np.random.default_rng(0)
    for act in networks.ACTIVATIONS:
        net = networks.Network.create(3, 1, networks.Setup(hidden=(4, 3), activation=act), rng)
        x = rng.normal(size=(1, 3))
        j, flat = net.jacobian(x)[0], np.concatenate([p.ravel() for p in net.parameters()])
        assert len(j) == len(flat)
        at = 0
        for p in net.parameters():
            for k in range(p.size):
                old = p.flat[k]
                p.flat[k] = old + 1e-6
                up = net(x)[0, 0]
                p.flat[k] = old - 1e-6
                down = net(x)[0, 0]
                p.flat[k] = old
                assert abs((up - down) / 2e-6 - j[at]) < 1e-5
                at += 1


def test_networks_learn_and_group_penalty(table):
    setup = networks.Setup(hidden=(6,), epochs=300, batch=64, rate=0.02)
    model = networks.fit_columns(table, ["f1", "f2", "f3"], "y", setup)
    got = networks.predict_columns(table, ["f1", "f2", "f3"], model).collect()
    assert np.std([r.y_hat - r.y for r in got]) < 0.5 * np.std([r.y for r in got])
    assert networks.shapley(table, "t", ["f1", "f2", "f3"], model, 3).first().feature == "f2"
    assert np.allclose(networks.group_penalty(np.array([[3.0, 4.0]]), 1.0), 5) and np.allclose(networks.group_penalty(np.array([[3.0, -4.0]]), 0.0), 7)


@pytest.mark.parametrize("kind,n_a,n_coef", [("plain", 0, 0), ("plain", 5, 5), ("dot", 4, 0), ("dot", 4, 4), ("dot", 7, 4)])
def test_gradients_with_heads(kind, n_a, n_coef):
    rng = np.random.default_rng(1)
    x, a, y = rng.normal(size=(9, 3)), rng.normal(size=(9, n_a)), rng.normal(size=9)
    head = networks.Head(kind, rng.normal(size=n_coef))
    net = networks.Network.create(3, 1 if kind == "plain" else n_a - (n_coef if n_coef != n_a else 0), networks.Setup(hidden=(4,)), rng)
    flat, at = networks.sums(net, head, x, a, y), 0
    assert flat[-1] == 9 and np.isclose(flat[-2], ((head.value(net(x), a) - y) ** 2).sum())
    for p in [*net.parameters(), head.coef]:
        for k in range(p.size):
            old, error = p.flat[k], []
            for move in (1e-6, -1e-6):
                p.flat[k] = old + move
                error.append(networks.sums(net, head, x, a, y)[-2])
            p.flat[k] = old
            assert abs((error[0] - error[1]) / 2e-6 - flat[at]) < 1e-4 * max(1, abs(flat[at]))
            at += 1
    assert at == len(flat) - 2
    head.applied = False
    assert not networks.sums(net, head, x, a, y)[: sum(p.size for p in net.parameters())].any()
    assert networks.sums(net, head, x, a, y, within=0.5)[-1] == (np.abs(y) <= 0.5).sum()


def test_rows_in_spark_and_on_the_driver_give_one_fit(table, tmp_path):
    base = networks.Setup(hidden=(5,), epochs=6, batch=20, steps=3, group_lasso=0.01)
    x = np.random.default_rng(0).normal(size=(10, 3))
    held = networks.fit_columns(table, ["f1", "f2", "f3"], "y", base)
    stored = networks.fit_columns(table, ["f1", "f2", "f3"], "y", networks.Setup(**{**base.__dict__, "bound": 0}))
    assert np.allclose(held(x), stored(x), rtol=1e-6)
    p = compensation.Params("m3vc", ("f1", "f2", "f3"), ("bx", "by", "bz"), "y", network=base)
    q = compensation.Params("m3vc", ("f1", "f2", "f3"), ("bx", "by", "bz"), "y", network=networks.Setup(**{**base.__dict__, "bound": 0}))
    a, b = [{r.t: r.y_hat for r in compensation.predict(table, ORDER, s, compensation.train(table, ORDER, s)).collect()} for s in (p, q)]
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], rtol=1e-6)


def test_fits_of_odd_tables(spark, table):
    setup = networks.Setup(hidden=(2,), epochs=2)
    same = table.limit(1).crossJoin(spark.range(40)).drop("id")  # one row, many times
    assert np.isfinite(networks.fit_columns(same, ["f1"], "y", setup)(np.zeros((1, 1)))).all()
    with pytest.raises(ValueError):
        networks.fit_columns(table.filter("false"), ["f1"], "y", setup)


def test_adam_leaves_resting_numbers_alone():
    p = [np.zeros(3), np.zeros(2)]
    adam = networks.Adam(p, 0.1)
    adam.step([np.ones(3), np.ones(2)], [np.array([True, False, True]), False])
    assert np.allclose(p[0], [-0.1, 0, -0.1]) and not p[1].any()
    adam.step([np.ones(3), np.ones(2)], [True, True])
    assert np.allclose(p[0], [-0.2, -0.1, -0.2]) and np.allclose(p[1], -0.1)


@pytest.mark.parametrize("kind", ["m2b", "m2d", "m3tl", "m3s", "m3vc", "m3w"])
def test_parts_add_up(table, kind):
    clash = table.withColumn("y_total", F.lit(1.0))
    p = compensation.Params(kind, ("f1", "f2", "f3"), ("bx", "by", "bz"), "y", network=networks.Setup(hidden=(4,), epochs=10, batch=64), window=3)
    model = compensation.train(clash, ORDER, p)
    rows = compensation.explained(clash, ORDER, p, model).collect()
    plain = {r.t: r.y_hat for r in compensation.predict(clash, ORDER, p, model).collect()}
    assert len(rows) == 120 and all(np.isclose(r.y_hat, r.y_permanent + r.y_induced + r.y_eddy + r.y_network) and np.isclose(r.y_hat, plain[r.t]) for r in rows)
    if kind == "m3tl":  # the network takes no part: what is left is one constant
        assert np.ptp([r.y_network for r in rows]) < 1e-6
    with pytest.raises(ValueError):
        compensation.explained(table, ORDER, compensation.Params("TL", (), ("bx", "by", "bz"), "y"), {"coef": 0})


def test_curriculum_takes_up_one_kind_after_the_other():
    p = compensation.Params("m3sc", ("f1",), ("bx", "by", "bz"), "y")
    trained = [(x.network, sum(x.coef) if x.coef else None, x.within) for x in compensation.phases(p)]
    assert trained == [(False, 3, 1.0), (False, 9, 1.0), (False, 18, 1.0), (True, 0, np.inf), (True, None, np.inf)]


def test_coefficients_are_trained_on(table):
    p = compensation.Params("m3tl", ("f1", "f2", "f3"), ("bx", "by", "bz"), "y", ridge=50.0, network=networks.Setup(hidden=(2,), epochs=200, batch=64, rate=0.02))
    model = compensation.train(table, ORDER, p)
    start = compensation.error(compensation.predict(table, ORDER, p, {"coef": model["start"], "bias": 0.0, "on": tolles_lawson.columns(p.terms)}), ("line",))
    assert compensation.error(compensation.predict(table, ORDER, p, model), ("line",)) < start


@pytest.mark.parametrize("kind", ["TL", "plsr", "elasticnet", "m1", "m2a", "m2c", "m2d", "m3tl", "m3s", "m3v", "m3sc", "m3vc", "m3w"])
def test_compensation_models_fit_and_predict(table, kind):
    p = compensation.Params(kind, ("f1", "f2", "f3"), ("bx", "by", "bz"), "y", network=networks.Setup(hidden=(4,), epochs=20, batch=64))
    model = compensation.train(table, ORDER, p)
    out = compensation.predict(table, ORDER, p, model)
    assert out.count() == table.count() and np.isfinite(compensation.error(out, ("line",)))


def test_unknown_models_are_errors():
    with pytest.raises(ValueError):
        compensation.Params("m9", (), ("a", "b", "c"), "y")


def test_models_on_the_same_columns_send_their_rows_once(spark, monkeypatch):
    from dataclasses import replace

    from fluxlane.operators import compensation, networks
    from fluxlane.plans.tables import VECTOR, vector

    rows, sent = vector(spark, "/root/testdata/sf0.001"), []

    class Counted(networks.Held):
        def __init__(self, df):
            sent.append(df)
            super().__init__(df)

    monkeypatch.setattr(networks, "Held", Counted)
    params = lambda kind: compensation.Params(kind, features=("f1", "f2", "f3"), vector=("bx", "by", "bz"), y="mag", network=networks.Setup(hidden=(3,), epochs=2))
    kinds, kept = ("m2a", "m2c", "m3s", "m3sc"), {}
    shared = [compensation.train(rows, VECTOR, params(k), kept)["fitted"] for k in kinds]
    assert len(sent) == 2
    alone = [compensation.train(rows, VECTOR, params(k))["fitted"] for k in kinds]
    assert len(sent) == 6
    for a, b in zip(shared, alone, strict=True):
        assert all(np.allclose(u, v, rtol=1e-9, atol=1e-12) for u, v in zip(a.net.parameters(), b.net.parameters(), strict=True)) and np.allclose(a.head.coef, b.head.coef, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        compensation.train(rows, VECTOR, replace(params("m2a"), y="f1"), kept)
    networks.release(kept)
    assert "rows" not in kept
