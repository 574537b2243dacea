"""Limited-memory BFGS and Morris' trajectories."""

import numpy as np
import pytest
from fluxlane.operators import networks
from pyspark.sql import functions as F


def table(spark, n=600):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.05
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "f1 double, f2 double, y double").cache()


class Counted(networks.Held):
    jobs = 0

    def total(self, steps, *more):
        Counted.jobs += 1
        return super().total(steps, *more)


def test_two_loops_solve_a_quadratic():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(6, 6))
    a, b = m @ m.T + np.eye(6), rng.normal(size=6)
    curve, x = networks.Curve(6), np.zeros(6)
    for _ in range(40):
        slope = a @ x - b
        way = curve.direction(slope)
        move = way * -(way @ slope) / (way @ a @ way)
        curve.learn(move, a @ move)
        x = x + move
    assert np.allclose(x, np.linalg.solve(a, b))


def test_lower_error_than_adam_in_a_tenth_of_the_jobs(spark, monkeypatch):
    rows = table(spark)
    monkeypatch.setattr(networks, "Held", Counted)
    found = {}
    for optimizer, epochs in (("adam", 100), ("lbfgs", 50)):
        Counted.jobs = 0
        setup = networks.Setup(hidden=(8,), activation="tanh", epochs=epochs, batch=50, optimizer=optimizer)
        model = networks.fit(rows, ["f1", "f2"], "y", setup)
        pdf = rows.toPandas()
        found[optimizer] = (float(np.mean((model(pdf[["f1", "f2"]].to_numpy()) - pdf["y"]) ** 2)), Counted.jobs)
    assert found["lbfgs"][0] < found["adam"][0] and found["lbfgs"][1] * 10 <= found["adam"][1], found


def test_both_ways_take_the_same_steps(spark):
    rows, out = table(spark, 120), []
    for bound in (0, 1 << 20):
        setup = networks.Setup(hidden=(4,), epochs=4, batch=30, optimizer="lbfgs", bound=bound, group_lasso=0.01)
        model = networks.fit(rows, ["f1", "f2"], "y", setup, ["f1"], "plain", np.zeros(1), (networks.Phase(coef=(False,)), networks.Phase(0.5)))
        out.append(np.concatenate([*(p.ravel() for p in model.net.parameters()), model.head.coef]))
    assert np.allclose(*out)


def test_trajectories(spark):
    linear = {r.feature: (r.mu, r.mu_star, r.sigma) for r in networks.morris(spark, {"a": (0.0, 2.0), "b": (-1.0, 3.0), "c": (5.0, 5.0)}, lambda x: 3 * x[:, 0] - x[:, 1] + 9 * x[:, 2], 12).collect()}
    assert np.allclose([linear[k] for k in "abc"], [(6, 6, 0), (-4, 4, 0), (0, 0, 0)])
    crossed = {r.feature: r for r in networks.morris(spark, {"a": (-1.0, 1.0), "b": (-1.0, 1.0)}, lambda x: x[:, 0] * x[:, 1], 200, 6).collect()}
    assert abs(crossed["a"].mu) < 0.4 and crossed["a"].mu_star > 0.5 and crossed["a"].sigma > 0.5
    # all places lie in the ranges
    def inside(x):
        assert (x >= 0).all() and (x <= 1).all()
        return x.sum(1)

    assert networks.morris(spark, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, inside, 30).count() == 2
    df = table(spark, 50)
    r = df.agg(F.max("f1") - F.min("f1")).first()[0]
    assert np.isclose(networks.trajectory_effects(df, ["f1", "f2"], lambda x: x[:, 0], 5).filter("feature = 'f1'").first().mu, r)


def test_unknown_optimizer(spark):
    with pytest.raises(KeyError):
        networks.fit(table(spark, 20), ["f1"], "y", networks.Setup(optimizer="newton"))
