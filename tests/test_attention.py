"""The transformer's parts against loops, and its gradients against differences."""

import numpy as np
import pytest
from fluxlane.operators import attention, compensation, networks
from fluxlane.operators.select import Order
from pyspark.sql import functions as F


def made(pre=False, heads=2, hidden=(4, 3), window=3, n_in=6, n_out=2):
    net = attention.Transformer.create(n_in, n_out, networks.Setup(hidden=hidden, activation="tanh"), np.random.default_rng(4), window, heads, pre)
    rng = np.random.default_rng(5)
    net.layers = [(w + rng.normal(size=w.shape) * 0.1, b + rng.normal(size=b.shape) * 0.1) for w, b in net.layers]
    return net


def by_loops(net, row):
    """One window through the layers after the definition, number by number."""
    (we, be), (place, _), q, k, v, o, n1, f1, f2, n2, (wf, bf) = net.layers
    window, width = place.shape
    x = np.array([[row[f * window + t] for f in range(len(we))] for t in range(window)])
    now = [(x[t] @ we + be) * np.sqrt(width) + place[t] for t in range(window)]

    def norm(z, pair):
        return (z - z.mean()) / np.sqrt(z.var() + 1e-5) * pair[0] + pair[1]

    def attend(rows):
        part = width // net.heads
        out = [np.zeros(width) for _ in rows]
        for t in range(window):
            for h in range(net.heads):
                cut = slice(h * part, (h + 1) * part)
                scores = np.array([(rows[t] @ q[0] + q[1])[cut] @ (rows[u] @ k[0] + k[1])[cut] for u in range(window)]) / np.sqrt(part)
                shares = np.exp(scores) / np.exp(scores).sum()
                out[t][cut] = sum(shares[u] * (rows[u] @ v[0] + v[1])[cut] for u in range(window))
        return [r @ o[0] + o[1] for r in out]

    feed = lambda rows: [np.tanh(r @ f1[0] + f1[1]) @ f2[0] + f2[1] for r in rows]
    for pair, part in ((n1, attend), (n2, feed)):
        if net.pre:
            now = [a + b for a, b in zip(now, part([norm(r, pair) for r in now]), strict=True)]
        else:
            now = [norm(a + b, pair) for a, b in zip(now, part(now), strict=True)]
    return np.concatenate(now) @ wf + bf


@pytest.mark.parametrize("pre", [False, True])
def test_output_equals_loops_and_gradients_equal_differences(pre):
    net, rng = made(pre), np.random.default_rng(6)
    x, pull = rng.normal(size=(5, 6)), rng.normal(size=(5, 2))
    y, inputs, sums = net.forward(x)
    assert np.allclose(y, [by_loops(net, r) for r in x])
    grads = net.backward(pull, inputs, sums)
    assert [g.shape for g in grads] == [p.shape for p in net.parameters()]
    for p, got in zip(net.parameters(), grads, strict=True):
        for at in np.ndindex(p.shape):
            was, ends = p[at], []
            for sign in (1, -1):
                p[at] = was + sign * 1e-6
                ends.append(float((net(x) * pull).sum()))
            p[at] = was
            assert np.isclose(got[at], (ends[0] - ends[1]) / 2e-6, rtol=1e-4, atol=1e-6)


def test_shapes_and_norms():
    with pytest.raises(ValueError):
        made(heads=3)
    with pytest.raises(ValueError):
        made(window=4)
    x = np.random.default_rng(1).normal(size=(3, 4, 5)) * 7 + 2
    got = attention.batch_norm(x)
    assert np.allclose(got.mean((1, 2)), 0) and np.allclose(got.std((1, 2)), 1, atol=1e-3)


def test_transformer_compensates_windows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for line in range(3):
        f = rng.normal(size=80)
        for t in range(80):
            target = 3 * f[max(t - 2, 0)] * f[t]
            rows.append((line, t, float(f[t]), *map(float, rng.normal(size=3) * 50 + [20000, 1000, 45000]), float(target)))
    df = spark.createDataFrame(rows, "line long, t long, f1 double, bx double, by double, bz double, mag double")
    order = Order(("line",), ("t",))
    errors = {}
    for kind, epochs in (("m3tl", 1), ("m3tf", 60)):
        setup = compensation.Params(kind, ("f1",), ("bx", "by", "bz"), "mag", ("permanent",), network=networks.Setup(hidden=(8, 8), epochs=epochs, batch=64, rate=0.01), window=3)
        model = compensation.train(df, order, setup)
        predicted = compensation.predict(df, order, setup, model)
        assert predicted.count() == 240 and predicted.filter(F.col("y_hat").isNull()).count() == 0
        errors[kind] = compensation.error(predicted, ("line",))
    assert errors["m3tf"] < 0.6 * errors["m3tl"]
