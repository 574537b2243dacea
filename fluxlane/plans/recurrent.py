"""Queries on recurrent networks and on networks inside filters, along the lines of ``events``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.operators import navigation as nav
from fluxlane.operators import recurrent
from fluxlane.operators.networks import Network
from fluxlane.plans.catalog import query
from fluxlane.plans.navigation import MODEL, PATH, measured, path, surface
from fluxlane.plans.tables import SIGNAL, rounded, signal

HIDDEN, WINDOW = 2, 4
NET = recurrent.Recurrent.create(2, HIDDEN, np.random.default_rng(7))

_ROWS_SQL = "rows_ AS (SELECT user_id AS line, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS rn, value / 50 - 1 AS x0, (event_id % 7) / 7::DOUBLE AS x1 FROM events)"
_STATE = [f"{s}{q}" for s in "hc" for q in range(HIDDEN)]


def _cell_sql(source: str, keys: str) -> str:
    """One step of the cell, from a source with ``keys``, x0, x1 and the state h0, h1, ..., c0, c1, ... before it."""
    number = lambda v: f"({float(v)!r})::DOUBLE"
    gate = [" + ".join([*(f"x{j} * {number(NET.wx[j, q])}" for j in range(2)), *(f"h{j} * {number(NET.wh[j, q])}" for j in range(HIDDEN)), number(NET.b[q])]) for q in range(4 * HIDDEN)]
    gates = ", ".join(f"{g} AS z{q}" for q, g in enumerate(gate))
    s = lambda q: f"1 / (1 + exp(-z{q}))"
    cells = ", ".join(f"{s(HIDDEN + q)} * c{q} + {s(q)} * tanh(z{2 * HIDDEN + q}) AS n{q}" for q in range(HIDDEN))
    states = ", ".join([*(f"{s(3 * HIDDEN + q)} * tanh(n{q}) AS h{q}" for q in range(HIDDEN)), *(f"n{q} AS c{q}" for q in range(HIDDEN))])
    return f"SELECT {keys}, {states} FROM (SELECT *, {cells} FROM (SELECT *, {gates} FROM ({source})))"


_OUT = " + ".join([*(f"h{q} * ({float(NET.wo[q, 0])!r})::DOUBLE" for q in range(HIDDEN)), f"({float(NET.bo[0])!r})::DOUBLE"])
_ANSWER = f"round(({_OUT}) / (1 + exp(-({_OUT}))), 6) + 0.0 AS y_hat"
_ZEROS = ", ".join(f"0::DOUBLE AS {c}" for c in _STATE)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("line", "tt", "event_id", (F.col("value") / 50 - 1).alias("x0"), (F.col("event_id") % 7 / 7).alias("x1"))


@query(f"""WITH RECURSIVE {_ROWS_SQL}, walk AS (SELECT DISTINCT line, 0::BIGINT AS event_id, 0::BIGINT AS rn, {_ZEROS} FROM rows_
UNION ALL {_cell_sql(f"SELECT r.line, r.event_id, r.rn, r.x0, r.x1, {', '.join(f'w.{c}' for c in _STATE)} FROM walk w JOIN rows_ r ON r.line = w.line AND r.rn = w.rn + 1", "line, event_id, rn")})
SELECT line, event_id, {_ANSWER} FROM walk WHERE rn > 0""")
def rnn_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrent network along whole lines."""
    return rounded(recurrent.predict_full(_features(spark, sf_dir), SIGNAL, ["x0", "x1"], NET).select("line", "event_id", "y_hat"))


def _windowed_sql() -> str:
    steps = [f"w0 AS (SELECT line, event_id, rn, {_ZEROS} FROM rows_)"]
    for k in range(1, WINDOW + 1):
        moved = _cell_sql(f"SELECT w.line, w.event_id, w.rn, r.x0, r.x1, {', '.join(f'w.{c}' for c in _STATE)} FROM w{k - 1} w JOIN rows_ r ON r.line = w.line AND r.rn = w.rn - {WINDOW - k}", "line, event_id, rn")
        steps.append(f"w{k} AS ({moved} UNION ALL SELECT * FROM w{k - 1} WHERE rn <= {WINDOW - k})")
    return f"WITH {_ROWS_SQL}, {', '.join(steps)} SELECT line, event_id, {_ANSWER} FROM w{WINDOW}"


@query(_windowed_sql())
def rnn_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same network on the latest rows at each row."""
    return rounded(recurrent.predict_windowed(_features(spark, sf_dir), SIGNAL, ["x0", "x1"], NET, WINDOW).select("line", "event_id", "y_hat"))


@query()
def nekf_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network that scales the filter's noise, trained on the lines and then applied to them: errors in metres."""
    rows = measured(path(spark, sf_dir)).withColumns({"f1": F.abs("noise"), "f2": F.sin(F.col("tt") / 5)})
    net, _ = recurrent.fit_noise(rows, PATH, surface(), MODEL, ["f1", "f2"], hidden=2, window=25, epochs=3)
    scaled = recurrent.predict_full(rows, PATH, ["f1", "f2"], net, "r_nn")
    out = nav.run_filter(scaled, PATH, surface(), MODEL, "noise", noise_factor="r_nn", full=False)
    places = out.select("line", "tt", F.element_at("x", 1).alias("d_lat"), F.element_at("x", 2).alias("d_lon"))
    both = scaled.join(places, ["line", "tt"]).withColumns({"lat": F.col("lat") + F.col("d_lat"), "lon": F.col("lon") + F.col("d_lon")})
    return nav.position_errors(both, "lat", "lon", "true_lat", "true_lon").select("line", "tt", "r_nn", "n_err", "e_err")


@query()
def ekf_online_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that learns a network's weights while it flies; the sensor reads a wave of two inputs besides the map."""
    rng = np.random.default_rng(5)
    net = nav.LearntNetwork(Network([(rng.normal(size=(2, 3)) * 0.5, np.zeros(3)), (rng.normal(size=(3, 1)) * 0.5, np.zeros(1))], "tanh"), 0.0, 5.0)
    m = nav.replace(MODEL, extra=(0.3,) * len(net.weights))
    rows = measured(path(spark, sf_dir)).withColumns({"a1": F.sin("tt"), "a2": F.cos(F.col("tt") / 3)})
    rows = rows.withColumn("z", F.col("z") + 4 * F.tanh(F.col("a1") - F.col("a2")))
    out = nav.run_filter(rows, PATH, surface(), m, "network", extra=("a1", "a2"), network=net, full=False)
    return out.select("line", "tt", F.element_at("x", 1).alias("d_lat"), F.element_at("x", 2).alias("d_lon"), "residual")
