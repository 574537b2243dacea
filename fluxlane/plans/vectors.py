"""Queries on linear models, Tolles-Lawson matrices, features, geodesy and attitude."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators import features, linear, sequence, tolles_lawson
from fluxlane.plans.catalog import query
from fluxlane.plans.tables import SIGNAL, SIGNAL_SQL, VECTOR, VECTOR_SQL, load, rounded, signal, vector

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax", *_COLUMNS)


def _summed(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    """Few numbers that tell normalized columns apart: mean square, least and greatest."""
    return df.agg(*[F.round(f(c), digits).alias(f"{n}_{c}") for c in names for n, f in (("ms", lambda c: F.avg(F.col(c) * F.col(c))), ("lo", F.min), ("hi", F.max))])


def _norm_sql(expression: str, digits: int = 4, where: str = "lineitem") -> str:
    parts = []
    for c in _COLUMNS:
        e = expression.format(c=c)
        parts += [f"round(avg(({e}) * ({e})), {digits}) AS ms_{c}", f"round(min({e}), {digits}) AS lo_{c}", f"round(max({e}), {digits}) AS hi_{c}"]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, min({c}) AS a_{c}, max({c}) AS z_{c}, max(abs({c})) AS x_{c}" for c in _COLUMNS)
    return f"WITH s AS (SELECT {stats} FROM {where}) SELECT " + ", ".join(parts) + " FROM lineitem, s"


@query(_norm_sql("({c} - m_{c}) / s_{c}"))
def norm_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return _summed(linear.normalized(rows, linear.norm_stats(rows, _COLUMNS)), _COLUMNS)


@query(_norm_sql("({c} - a_{c}) / (z_{c} - a_{c})"))
def norm_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return _summed(linear.normalized(rows, linear.norm_stats(rows, _COLUMNS, "normalize")), _COLUMNS)


@query(_norm_sql("{c} / x_{c}"))
def norm_maxabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return _summed(linear.normalized(rows, linear.norm_stats(rows, _COLUMNS, "scale")), _COLUMNS)


@query(_norm_sql("({c} - m_{c}) / s_{c}", where="lineitem WHERE l_returnflag = 'R'"))
def norm_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return _summed(linear.normalized(rows, linear.norm_stats(rows.filter("l_returnflag = 'R'"), _COLUMNS)), _COLUMNS)


@query(_norm_sql("{c}", 3))
def denorm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    stats = linear.norm_stats(rows, _COLUMNS)
    return _summed(linear.denormalized(linear.normalized(rows, stats), stats), _COLUMNS, 3)


@query("""WITH e AS (SELECT l_returnflag, l_extendedprice - 1500 * l_quantity AS e FROM lineitem), c AS (SELECT l_returnflag, e - avg(e) OVER (PARTITION BY l_returnflag) AS err FROM e)
SELECT l_returnflag, count(*) AS n, round(sqrt(avg(err * err)), 3) AS rms, round(max(err), 3) AS most FROM c GROUP BY 1""")
def err_segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.segment_error(_lines(spark, sf_dir), F.col("l_extendedprice"), 1500 * F.col("l_quantity"), ("l_returnflag",), "err")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("err") ** 2)), 3).alias("rms"), F.round(F.max("err"), 3).alias("most"))


@query("SELECT count(*) AS n, round(sum(l_quantity), 3) AS sum_x, round(sum(l_quantity * l_quantity) / count(*), 4) AS xx, round(sum(l_quantity * l_extendedprice) / count(*), 3) AS xy, round(sum(l_extendedprice) / count(*), 4) AS y FROM lineitem")
def linreg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linear.moments(load(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    row = (m.n, round(float(m.sum_x[0]), 3), round(float(m.xx[0, 0]) / m.n, 4), round(float(m.xy[0]) / m.n, 3), round(m.sum_y / m.n, 4))
    return spark.createDataFrame([row], "n long, sum_x double, xx double, xy double, y double")


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) + 0.5 AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) + 0.5 AS d, sum(l_quantity * l_extendedprice) AS u, sum(l_discount * l_extendedprice) AS v FROM lineitem)
SELECT round((d * u - b * v) / (a * d - b * b), 4) AS c1, round((a * v - b * u) / (a * d - b * b), 3) AS c2 FROM s""")
def linreg_solve2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = linear.ridge(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 0.5)
    return spark.createDataFrame([(round(float(c[0]), 4), round(float(c[1]), 3))], "c1 double, c2 double")


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round((f1 * 0.5 - f2 * 1.25 + f3 * 2 + 0.1) * 3 + 7, 6) AS y FROM vec")
def linear_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = linear.predict([F.col(c) for c in ("f1", "f2", "f3")], (0.5, -1.25, 2.0), 0.1, 7.0, 3.0)
    return rounded(vector(spark, sf_dir).select("vec_id", y.alias("y")))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope FROM lineitem GROUP BY 1 HAVING abs(corr(l_quantity, l_extendedprice)) > 0.0001")
def correlation_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.correlation(load(spark, sf_dir, "lineitem"), ("l_returnflag",), "l_quantity", "l_extendedprice", 0.0001).select("l_returnflag", F.round("corr", 6).alias("corr"), F.round("slope", 4).alias("slope"))


@query("""WITH e AS (SELECT unnest(['quantity', 'discount', 'tax']) AS feature, unnest([0.5 * (l_quantity - 25), 2 * (l_discount - 0.05), -3 * (l_tax - 0.04)]) AS effect FROM lineitem)
SELECT feature, round(avg(abs(effect)), 6) AS importance FROM e GROUP BY 1 ORDER BY 2 DESC""")
def feature_importance_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = {"quantity": (F.col("l_quantity"), 0.5, 25.0), "discount": (F.col("l_discount"), 2.0, 0.05), "tax": (F.col("l_tax"), -3.0, 0.04)}
    rows = load(spark, sf_dir, "lineitem").select(F.explode(F.create_map(*[x for n, (c, k, m) in means.items() for x in (F.lit(n), k * (c - m))])).alias("feature", "effect"))
    return rounded(features.importance(rows))


def _tl_sql(names: dict[str, str], total: str = "sqrt(vx * vx + vy * vy + vz * vz)") -> str:
    change = ", ".join(f"CASE WHEN n < 3 THEN 0 WHEN rn = 1 THEN lead({a}) OVER o - {a} WHEN rn = n THEN {a} - lag({a}) OVER o ELSE (lead({a}) OVER o - lag({a}) OVER o) / 2 END AS d{a[1]}" for a in ("vx", "vy", "vz"))
    cols = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in names.items())
    return f"WITH {VECTOR_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY line) AS n, {total} AS bt FROM vec), d AS (SELECT *, {change} FROM w WINDOW o AS (PARTITION BY line ORDER BY vec_id)) SELECT vec_id, {cols} FROM d"


_P = {f"p_{a}": f"v{a} / bt" for a in "xyz"}
_I = {f"i_{a}_{b}": f"v{a} / bt * v{b} / 50000" for k, a in enumerate("xyz") for b in "xyz"[k:]}
_E = {f"e_{a}_{b}": f"v{a} / bt * d{b} / 50000" for a in "xyz" for b in "xyz"}
_F3 = {f"f_{a}": f"d{a}" for a in "xyz"}


def _matrix(spark: SparkSession, sf_dir: str, terms: list[str]) -> DataFrame:
    return rounded(tolles_lawson.with_matrix(vector(spark, sf_dir), VECTOR, "bx", "by", "bz", terms).select("vec_id", *tolles_lawson.columns(terms)))


@query(_tl_sql(_P))
def tl_permanent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, ["permanent"])


@query(_tl_sql(_I))
def tl_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, ["induced"])


@query(_tl_sql(_E))
def tl_eddy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, ["eddy"])


@query(_tl_sql(_P | {k: v for k, v in _I.items() if k != "i_z_z"} | {k: v for k, v in _E.items() if k in ("e_x_x", "e_y_y", "e_z_z")} | _F3 | {"bias": "1.0"}))
def tl_full_with_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, ["b", "f", "e3", "i5", "p"])


_COEF = [round(0.5 * (-1) ** i + 0.1 * i, 3) for i in range(18)]


@query(_tl_sql({
    **{f"a_{a}": " + ".join([f"({_COEF[i]})"] + [f"({_COEF[3 + k] / (1 if p == q else 2)}) * v{'xyz'[q if p == i else p]} / 50000" for k, (p, q) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))) if i in (p, q)] + [f"({_COEF[9 + 3 * i + j]}) * d{'xyz'[j]} / 50000" for j in range(3)]) for i, a in enumerate("xyz")}
}))
def tl_apply_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["bx", "by", "bz"]
    rows = vector(spark, sf_dir)
    rows = rows.withColumns({f"d{c}": sequence.difference(F.col(c), VECTOR) for c in names})
    parts = tolles_lawson.to_matrices(_COEF, ["p", "i", "e"])
    out = tolles_lawson.aircraft_field([F.col(c) for c in names], [F.col(f"d{c}") for c in names], *parts)
    return rounded(rows.select("vec_id", *[v.alias(f"a_{a}") for v, a in zip(out, "xyz", strict=True)]))


@query()
def tl_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ["permanent", "induced", "eddy"]
    coef, variance = tolles_lawson.fit(vector(spark, sf_dir), VECTOR, "bx", "by", "bz", "mag", terms, ridge=0.025)
    return spark.createDataFrame([(n, float(c), variance) for n, c in zip(tolles_lawson.columns(terms), coef, strict=True)], "term string, coef double, residual_variance double")


@query(_tl_sql({"mag_uc": "mag - f1", "mag_uc_dot": "CASE WHEN n < 3 THEN 0 WHEN rn = 1 THEN lead(mag - f1) OVER (PARTITION BY line ORDER BY vec_id) - (mag - f1) WHEN rn = n THEN (mag - f1) - lag(mag - f1) OVER (PARTITION BY line ORDER BY vec_id) ELSE (lead(mag - f1) OVER (PARTITION BY line ORDER BY vec_id) - lag(mag - f1) OVER (PARTITION BY line ORDER BY vec_id)) / 2 END", "mag_uc_lag_1": "CASE WHEN rn = 1 THEN mag - f1 ELSE lag(mag - f1) OVER (PARTITION BY line ORDER BY vec_id) END", "crcy": "cos(f1) * cos(f3)", "srspsy": "sin(f1) * sin(f2) * sin(f3)", "dcm_2": "sin(f1) * sin(f2) * cos(f3) - cos(f1) * sin(f3)", "pitch_sin": "sin(f2)", "f1": "f1"} | _P))
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.Setup(scalars={"mag_uc": "mag"}, vectors={"flux": ("bx", "by", "bz")}, attitude=("f1", "f2", "f3"), subtract=("f1",), terms=("p",))
    out, names = features.matrix(vector(spark, sf_dir), VECTOR, ["mag_uc", "mag_uc_dot", "mag_uc_lag_1", "crcy", "srspsy", "dcm_2", "pitch_sin", "f1", "TL_A_flux"], s)
    renamed = {n: n.removeprefix("TL_A_flux_") for n in names if n.startswith("TL_A_flux_")}
    return rounded(out.select("vec_id", *names).withColumnsRenamed(renamed))


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round(mag - f1, 6) + 0.0 AS y FROM vec")
def target_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector(spark, sf_dir).select("vec_id", features.target("a", F.col("mag"), F.col("f1")).alias("y")))


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round(f1 - mag, 6) + 0.0 AS y FROM vec")
def target_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector(spark, sf_dir).select("vec_id", features.target("d", F.col("mag"), F.col("f1")).alias("y")))


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round(mag - f1 - f2 - f3, 6) + 0.0 AS y FROM vec")
def target_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = features.target("c", F.col("mag"), F.col("f1"), [F.col("f2"), F.col("f3")])
    return rounded(vector(spark, sf_dir).select("vec_id", y.alias("y")))


_LAT = "radians(l_discount * 400 + 20)"
_Q = f"sqrt(1 - pow(0.0818191908426 * sin({_LAT}), 2))"


@query(f"SELECT l_discount, round(sum(l_quantity * {_Q} / 6378137) * 1e4, 5) AS dlat, round(sum(l_quantity * {_Q} / 6378137 / cos({_LAT})) * 1e4, 5) AS dlon FROM lineitem GROUP BY 1")
def geo_dn2dlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, q = F.radians(F.col("l_discount") * 400 + 20), F.col("l_quantity")
    rows = load(spark, sf_dir, "lineitem").select("l_discount", geodesy.north_to_lat(q, lat).alias("dlat"), geodesy.east_to_lon(q, lat).alias("dlon"))
    return rows.groupBy("l_discount").agg(F.round(F.sum("dlat") * 1e4, 5).alias("dlat"), F.round(F.sum("dlon") * 1e4, 5).alias("dlon"))


@query("SELECT l_discount, count(*) AS n, round(sum(l_quantity), 4) AS north, round(sum(l_quantity), 4) AS east FROM lineitem GROUP BY 1")
def geo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, q = F.radians(F.col("l_discount") * 400 + 20), F.col("l_quantity")
    n, e = geodesy.lat_to_north(geodesy.north_to_lat(q, lat), lat), geodesy.lon_to_east(geodesy.east_to_lon(q, lat), lat)
    return load(spark, sf_dir, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n"), F.round(F.sum(n), 4).alias("north"), F.round(F.sum(e), 4).alias("east"))


_R, _T, _Y = "(l_discount * 10 - 0.5)", "(l_tax * 10 - 0.4)", "(l_quantity / 20 - 1.2)"
_DCM = {
    "c11": f"cos({_T}) * cos({_Y})", "c12": f"sin({_R}) * sin({_T}) * cos({_Y}) - cos({_R}) * sin({_Y})", "c13": f"sin({_R}) * sin({_Y}) + cos({_R}) * sin({_T}) * cos({_Y})",
    "c21": f"cos({_T}) * sin({_Y})", "c22": f"cos({_R}) * cos({_Y}) + sin({_R}) * sin({_T}) * sin({_Y})", "c23": f"cos({_R}) * sin({_T}) * sin({_Y}) - sin({_R}) * cos({_Y})",
    "c31": f"-sin({_T})", "c32": f"sin({_R}) * cos({_T})", "c33": f"cos({_R}) * cos({_T})",
}


@query("SELECT l_returnflag, " + ", ".join(f"round(avg({e}), 6) + 0.0 AS {n}" for n, e in _DCM.items()) + " FROM lineitem GROUP BY 1")
def euler_dcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geodesy.body_to_nav(F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 10 - 0.4, F.col("l_quantity") / 20 - 1.2)
    return rounded(load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c[i][j]).alias(f"c{i + 1}{j + 1}") for i in range(3) for j in range(3)]))


@query(f"SELECT l_returnflag, round(avg({_R}), 6) + 0.0 AS roll, round(avg({_T}), 6) + 0.0 AS pitch, round(avg({_Y}), 6) + 0.0 AS yaw FROM lineitem GROUP BY 1")
def dcm_euler_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = geodesy.euler_of(geodesy.body_to_nav(F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 10 - 0.4, F.col("l_quantity") / 20 - 1.2))
    return rounded(load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.avg(v).alias(n) for v, n in zip(back, ("roll", "pitch", "yaw"), strict=True)]))


@query(f"""WITH t AS (SELECT *, l_discount / 10 AS x, l_tax / 10 AS y, -l_discount / 5 AS z FROM lineitem WHERE l_discount + l_tax > 0), m AS (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM t)
SELECT l_returnflag, round(avg(({_DCM['c11']}) - sin(m) / m * (-z * ({_DCM['c21']}) + y * ({_DCM['c31']})) - (1 - cos(m)) / (m * m) * ((-z * z - y * y) * ({_DCM['c11']}) + x * y * ({_DCM['c21']}) + x * z * ({_DCM['c31']}))), 6) + 0.0 AS c11 FROM m GROUP BY 1""")
def dcm_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    c = geodesy.tilted(geodesy.body_to_nav(d * 10 - 0.5, t * 10 - 0.4, F.col("l_quantity") / 20 - 1.2), [d / 10, t / 10, -d / 5])
    return rounded(load(spark, sf_dir, "lineitem").filter(d + t > 0).groupBy("l_returnflag").agg(F.avg(c[0][0]).alias("c11")))


@query("SELECT o_orderkey, round(round_even(year(o_orderdate) * 1.0, 0) + dayofyear(o_orderdate) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366.0 ELSE 365.0 END, 6) AS decimal_year FROM orders")
def decimal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = geodesy.decimal_year(F.year("o_orderdate").cast("double"), F.dayofyear("o_orderdate"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(y, 6).alias("decimal_year"))


_NAV = [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]]


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round((0.8 * vx - 0.6 * vy) * 0.6 + (0.6 * vx + 0.8 * vy) * 0.8, 5) + 0.0 AS along, round((0.6 * vx + 0.8 * vy) * 0.6 - (0.8 * vx - 0.6 * vy) * 0.8, 5) + 0.0 AS across FROM vec")
def field_plane_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = [[F.lit(v) for v in r] for r in _NAV]
    a, b = geodesy.field_plane([F.col(c) for c in ("bx", "by", "bz")], [F.lit(3.0), F.lit(4.0), F.lit(5.0)], nav)
    return rounded(vector(spark, sf_dir).select("vec_id", a.alias("along"), b.alias("across")), 5)


@query()
def plsr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linear.moments(vector(spark, sf_dir), ["bx", "by", "bz", "f1", "f2", "f3"], "mag")
    fits = linear.partial_least_squares(m, 4)
    return spark.createDataFrame([(k + 1, [float(v) for v in c]) for k, c in enumerate(fits)], "components int, coef array<double>")


@query()
def elastic_net_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef, bias = linear.elastic_net(linear.moments(vector(spark, sf_dir), ["f1", "f2", "f3"], "mag"), 0.99, 0.001)
    return spark.createDataFrame([([float(c) for c in coef], bias)], "coef array<double>, intercept double")


@query()
def kernel_ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = linear.kernel_ridge_moments(linear.moments(vector(spark, sf_dir), ["f1", "f2", "f3"], "mag"), 0.5)
    return spark.createDataFrame([[float(v) for v in c]], "intercept double, c1 double, c2 double, c3 double")


@query()
def optimal_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = math.radians(30)
    turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    rows = vector(spark, sf_dir).withColumns({f"r_{c}": F.col(c) for c in ("bx", "by", "bz")})
    r = linear.best_rotation(linear.rotated(rows, ["r_bx", "r_by", "r_bz"], turn), ["bx", "by", "bz"], ["r_bx", "r_by", "r_bz"])
    return spark.createDataFrame([(i, j, round(float(r[i, j]), 9) + 0.0) for i in range(3) for j in range(3)], "i int, j int, r double")


@query(f"WITH {SIGNAL_SQL} SELECT line, round(regr_intercept(value, tt - 1704067200), 4) + 0.0 AS intercept, round(regr_slope(value, tt - 1704067200) * 1e6, 4) + 0.0 AS slope FROM sig GROUP BY 1")
def trend_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("tt") - 1704067200
    return signal(spark, sf_dir).groupBy("line").agg((F.round(F.regr_intercept(F.col("value"), x), 4) + F.lit(0.0)).alias("intercept"), (F.round(F.regr_slope(F.col("value"), x) * 1e6, 4) + F.lit(0.0)).alias("slope"))


assert SIGNAL.by == ("line",)
