"""Queries on filters, their evaluation, simulation, networks and streams.

Paths come from ``events``: each user flies east at 70 m/s with a sample every
second for each event, over a smooth map; the sensor reads the map and noise
made of the events' values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators import grid as g
from fluxlane.operators import navigation as nav
from fluxlane.operators import networks, simulate
from fluxlane.operators.select import Order
from fluxlane.plans.catalog import query
from fluxlane.plans.tables import SIGNAL, VECTOR, load, rounded, signal, vector

PATH = Order(("line",), ("tt",))
MODEL = nav.Model(dt=1.0, pos=30.0, noise=4.0)
LAT0, LON0 = float(np.deg2rad(45)), float(np.deg2rad(-75))


def surface() -> g.Interpolant:
    """A map of 200 by 200 cells of about 250 m."""
    a = g.Axes(LON0 - 2e-4, LAT0 - 2e-4, 5.5e-5, 4e-5, 200, 200)
    y, x = np.indices((a.ny, a.nx))
    return g.Interpolant(300 * np.sin(x / 4.0) + 250 * np.cos(y / 5.0 + x / 9.0), a)


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOTION's columns, cnb, true_lat, true_lon, noise and tt of each line."""
    rows = signal(spark, sf_dir).withColumn("tt", F.row_number().over(SIGNAL.window).cast("double"))
    lat = LAT0 + (F.col("line") % 50) * 1e-5
    rows = rows.withColumn("true_lat", lat).withColumn("true_lon", LON0 + geodesy.east_to_lon(70.0 * F.col("tt"), lat))
    drift = geodesy.north_to_lat(F.lit(20.0) + 0.02 * F.col("tt"), lat)
    return rows.select(
        "line", "tt", "true_lat", "true_lon", ((F.col("value") % 5) - 2.5).alias("noise"), (F.col("true_lat") + drift).alias("lat"), (F.col("true_lon") - drift).alias("lon"),
        *[F.lit(v).alias(n) for n, v in zip(nav.MOTION[2:], (300.0, 0.0, 70.0, 0.0, 0.0, 0.0, -9.81), strict=True)],
        F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)]).alias("cnb"),
    )


def measured(rows: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(surface())  # one map level of bounded size

    def run(batches):
        for b in batches:
            yield b.assign(z=shared.value(b["true_lat"].to_numpy(), b["true_lon"].to_numpy()) + b["noise"])

    return rows.mapInPandas(run, rows.selectExpr("*", "cast(0 as double) as z").schema)


def _filtered(spark: SparkSession, sf_dir: str, kind: str, m: nav.Model = MODEL, **more) -> DataFrame:
    out = nav.run_filter(measured(path(spark, sf_dir)), PATH, surface(), m, kind, full=False, **more)
    return nav.deviations(out, F.lit(LAT0), m.size, full=False).select("line", "tt", F.element_at("x", 1).alias("d_lat"), F.element_at("x", 2).alias("d_lon"), F.element_at("x", -1).alias("bias"), "n_std", "e_std", "residual", "converged")


@query()
def ekf_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "ekf")


@query()
def ekf_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "ekf", nav.replace(MODEL, noise_limits=(1.0, 100.0)))


@query()
def crlb_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "crlb")


@query()
def particle_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "particle")


@query()
def ekf_online_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nav.replace(MODEL, extra=(1.0, 1.0))
    rows = measured(path(spark, sf_dir)).withColumn("a1", F.sin("tt")).withColumn("a2", F.cos(F.col("tt") / 3))
    rows = rows.withColumn("z", F.col("z") + 3 * F.col("a1") - 2 * F.col("a2"))
    out = nav.run_filter(rows, PATH, surface(), m, "online", extra=("a1", "a2"), x0=(0.0, 0.0), full=False)
    return out.select("line", "tt", F.element_at("x", 18).alias("c1"), F.element_at("x", 19).alias("c2"), "residual")


@query()
def ekf_scaled_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(path(spark, sf_dir)).withColumn("r_nn", F.abs("noise"))
    return nav.run_filter(rows, PATH, surface(), MODEL, "noise", noise_factor="r_nn", full=False).select("line", "tt", F.element_at("x", 1).alias("d_lat"), "residual")


_Q = "sqrt(1 - pow(0.0818191908426 * sin(t), 2))"


@query(f"""WITH p AS (SELECT l_returnflag, radians(l_discount * 100 + 30) AS t, l_tax * 1e-6 AS dlat, l_quantity * 1e-8 AS dlon FROM lineitem)
SELECT l_returnflag, round(sqrt(avg(pow(dlat / {_Q} * 6378137, 2) + pow(dlon / {_Q} * 6378137 * cos(t), 2))), 5) AS drms FROM p GROUP BY 1""")
def drms_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.radians(F.col("l_discount") * 100 + 30)
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", t.alias("t_lat"), (t + 0).alias("zero"), (F.col("l_tax") * 1e-6).alias("a"), (F.col("l_quantity") * 1e-8).alias("b"))
    rows = rows.withColumns({"n_err": geodesy.lat_to_north(F.col("a"), F.col("t_lat")), "e_err": geodesy.lon_to_east(F.col("b"), F.col("t_lat"))})
    return rounded(nav.drms(rows, ["l_returnflag"]), 5)


@query("""WITH c AS (SELECT n_nationkey, 1 + n_nationkey * 0.5::DOUBLE AS a, 0.3::DOUBLE AS b, 2 + n_regionkey * 0.25::DOUBLE AS c FROM nation),
e AS (SELECT *, (a + c) / 2 AS mid, sqrt(pow((a - c) / 2, 2) + b * b) AS half, atan2(2 * b, a - c) / 2 AS turn FROM c),
p AS (SELECT *, i, i * 2 * pi() / 8 AS t, sqrt(-2 * ln(0.05)) AS s FROM e, range(9) r(i))
SELECT n_nationkey, CAST(i AS INTEGER) AS i, round(s * (sqrt(mid + half) * cos(t) * cos(turn) - sqrt(mid - half) * sin(t) * sin(turn)), 5) + 0.0 AS x, round(s * (sqrt(mid + half) * cos(t) * sin(turn) + sqrt(mid - half) * sin(t) * cos(turn)), 5) + 0.0 AS y FROM p""")
def ellipse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = nav.ellipse(1 + F.col("n_nationkey") * 0.5, F.lit(0.3), 2 + F.col("n_regionkey") * 0.25, 9)
    rows = load(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(points).alias("i", "p"))
    return rounded(rows.select("n_nationkey", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y")), 5)


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 160 - 80) * 0.017::DOUBLE AS tl, (o_custkey % 40) * 1e-6 AS d, (o_orderkey % 23 - 11) * 1e-3 AS w FROM orders),
q AS (SELECT *, tl + 2 * d - 3 * d AS lat, sqrt(1 - pow(0.0818191908426 * sin(tl), 2)) AS q FROM o)
SELECT o_orderkey, round((2 * d - 3 * d) / q * 6378137, 4) + 0.0 AS n_err, round((d + 2 * d) / q * 6378137 * cos(tl), 4) + 0.0 AS e_err, round(5 * d - 7 * d, 9) + 0.0 AS alt_err, round(4e-3 - sin(w), 9) + 0.0 AS td_err, round(4e-3 * 2, 9) + 0.0 AS tn_err,
 round(sqrt(1e-12) / q * 6378137, 6) + 0.0 AS n_std, round(sqrt(0.25::DOUBLE), 6) AS fogm_std, round(abs(1e-12 * (6378137 / q) * (6378137 / q)), 6) AS n_var FROM q""")
def filter_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a filter whose states and covariances are made of orders: errors, tilts against a turn in the plane, deviations, and a variance in metres."""
    key = F.col("o_orderkey")
    d, true_lat, w = F.col("o_custkey") % 40 * 1e-6, (key % 160 - 80) * 0.017, (key % 23 - 11) * 1e-3
    base = load(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), true_lat.alias("true_lat"), w.alias("w"))
    zero, c, s = F.lit(0.0), F.cos("w"), F.sin("w")
    states = [-3 * F.col("d"), 2 * F.col("d"), -7 * F.col("d"), zero, zero, zero, F.lit(8e-3), zero, F.lit(4e-3), *[zero] * 9]
    variance = [F.lit(1e-12) if i == 0 else F.lit(0.25) if i == 17 else zero for i in range(18)]
    filtered = base.select("o_orderkey", F.array(*states).alias("x"), F.array(*[variance[i] if i == j else zero for i in range(18) for j in range(18)]).alias("p"))
    true = {f"true_{n}": zero for n in ("lon", "alt", "vn", "ve", "vd")} | {"true_cnb": F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)])}
    ins = {"ins_lat": F.col("true_lat") + 2 * F.col("d"), "ins_lon": F.col("d"), "ins_alt": 5 * F.col("d"), "ins_vn": zero, "ins_ve": zero, "ins_vd": zero, "ins_cnb": F.array(c, -s, zero, s, c, zero, zero, zero, F.lit(1.0))}
    out = nav.filter_outputs(filtered, base.withColumns(true | ins), ["o_orderkey"], 18)
    variances = nav.ellipse_units(F.lit(1e-12), zero, zero, "m", F.col("true_lat"))
    return rounded(out.withColumn("n_var", F.abs(variances[0])).select("o_orderkey", F.round("n_err", 4).alias("n_err"), F.round("e_err", 4).alias("e_err"), F.round("alt_err", 9).alias("alt_err"), F.round("td_err", 9).alias("td_err"), F.round("tn_err", 9).alias("tn_err"), F.round("n_std", 6).alias("n_std"), F.round("fogm_std", 6).alias("fogm_std"), F.round("n_var", 6).alias("n_var")), 9)


@query()
def simulated_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seed"))
    return simulate.flights(flights, surface(), simulate.Flight(seconds=20.0, lat=LAT0 + 0.002, lon=LON0 + 0.002))


@query()
def network_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector(spark, sf_dir)
    model = networks.fit_columns(rows, ["f1", "f2", "f3"], "mag", networks.Setup(hidden=(8,), epochs=40))
    return networks.predict_columns(rows, ["f1", "f2", "f3"], model).select("vec_id", "y_hat")


@query()
def network_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["f1", "f2", "f3"]
    rows = vector(spark, sf_dir)
    model = networks.fit_columns(rows, names, "mag", networks.Setup(hidden=(8,), epochs=40))
    return networks.shapley(rows.select("vec_id", *names), "vec_id", names, model)


@query()
def network_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["f1", "f2", "f3"]
    rows = vector(spark, sf_dir)
    model = networks.fit_columns(rows, names, "mag", networks.Setup(hidden=(8,), epochs=40))
    return networks.elementary_effects(rows.select("vec_id", *names), "vec_id", names, model)


@query()
def network_morris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity along trajectories of a network that is fitted by limited-memory BFGS on a stored table."""
    names = ["f1", "f2", "f3"]
    rows = vector(spark, sf_dir)
    model = networks.fit_columns(rows, names, "mag", networks.Setup(hidden=(8,), epochs=6, optimizer="lbfgs", bound=0, steps=1))
    return networks.trajectory_effects(rows, names, model, 20)


@query("""WITH r AS (SELECT max(f1) - min(f1) AS r1, max(f2) - min(f2) AS r2, max(f3) - min(f3) AS r3 FROM (SELECT CAST(embedding[5] AS DOUBLE) AS f1, CAST(embedding[6] AS DOUBLE) AS f2, CAST(embedding[7] AS DOUBLE) AS f3 FROM embeddings))
SELECT unnest(['f1', 'f2', 'f3']) AS feature, round(unnest([3 * r1, -2 * r2, 0.5::DOUBLE * r3]), 6) + 0.0 AS mu, round(unnest([3 * r1, 2 * r2, 0.5::DOUBLE * r3]), 6) + 0.0 AS mu_star, 0::DOUBLE AS sigma FROM r""")
def morris_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories over a linear model: every effect is the coefficient times the range."""
    return rounded(networks.trajectory_effects(vector(spark, sf_dir), ["f1", "f2", "f3"], lambda x: x @ np.array([3.0, -2.0, 0.5]) + 7, 20))


@query()
def compensation_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each compensation model on lines that it was fitted on and on others."""
    from fluxlane.operators import compensation

    rows = vector(spark, sf_dir).withColumns({"scalar": F.lit(52000.0) + 10 * F.col("f1"), "map": F.lit(52000.0) + 10 * F.col("f2")})
    kinds, out, kept = ("TL", "mod_TL", "map_TL", "elasticnet", "plsr", "m1", "m2a", "m2b", "m2c", "m2d", "m3tl", "m3s", "m3v", "m3sc", "m3vc", "m3w", "m3tf"), [], {}
    fitted = rows.filter("line < 7")
    try:
        # those that read the same columns one after the other, so that each table is sent once
        for kind in sorted(kinds, key=lambda k: (k in ("m3v", "m3vc"), k in compensation.WINDOWED)):
            setup = compensation.Params(kind, features=("f1", "f2", "f3"), vector=("bx", "by", "bz"), y="mag", total={"mod_TL": "scalar", "map_TL": "map"}.get(kind), network=networks.Setup(hidden=(6,), epochs=15))
            model = compensation.train(fitted, VECTOR, setup, kept)
            out += [(kind, part, float(compensation.error(compensation.predict(part_rows, VECTOR, setup, model), ("line",)))) for part, part_rows in (("train", fitted), ("test", rows.filter("line >= 7")))]
    finally:
        networks.release(kept)
    out.sort(key=lambda r: kinds.index(r[0]))
    return spark.createDataFrame(out, "model string, part string, error_std double")


@query()
def compensation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part of the aircraft's field and the network add to a prediction."""
    from fluxlane.operators import compensation

    rows = vector(spark, sf_dir)
    setup = compensation.Params("m3vc", features=("f1", "f2", "f3"), vector=("bx", "by", "bz"), y="mag", network=networks.Setup(hidden=(6,), epochs=20))
    model = compensation.train(rows, VECTOR, setup)
    return compensation.explained(rows, VECTOR, setup, model).select("vec_id", "y_permanent", "y_induced", "y_eddy", "y_network", "y_hat")


@query("SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxlane.streaming import windows

    return windows.hourly(spark, f"{sf_dir}/events.parquet")


@query()
def stream_ekf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxlane.streaming import realtime

    return realtime.filter_stream(measured(path(spark, sf_dir)), surface(), MODEL)
