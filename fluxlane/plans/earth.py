"""Queries on the Earth's main field. The model's terms up to degree 3 are sums over nations, and customers are places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.operators import field
from fluxlane.plans.catalog import query
from fluxlane.plans.tables import GRID_SQL, grid, load, rounded

_TERMS = field.terms(3)


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs with changes after the last one; a dipole of about 29,000 nT and what the nations' keys add."""
    key = F.col("n_nationkey")
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(m).alias("m")) for i, (n, m) in enumerate(_TERMS)])).alias("at")
    rows = load(spark, sf_dir, "nation").select("n_nationkey", place).filter(F.col("at.i") == key % len(_TERMS)).select("n_nationkey", "at.n", "at.m")
    rows = rows.withColumn("epoch", F.explode(F.array(F.lit(2015.0), F.lit(2020.0))))
    later = F.when(F.col("epoch") > 2015, 1.0).otherwise(0.0)
    g = (key * 7919 % 101 - 50) * 40.0 / (F.col("n") * F.col("n")) - F.when((F.col("n") == 1) & (F.col("m") == 0), 9800.0).otherwise(0.0) + later * (key % 7 - 3) * 5
    h = F.when(F.col("m") > 0, (key * 104729 % 97 - 48) * 30.0 / (F.col("n") * F.col("n")) + later * (key % 4 - 1) * 4).otherwise(0.0)
    return rows.select("epoch", "n", "m", g.alias("g"), h.alias("h"), ((key % 5 - 2) * 2.0).alias("g_dot"), F.when(F.col("m") > 0, (key % 3 - 1) * 1.5).otherwise(0.0).alias("h_dot"))


_MODEL_SQL = f"""term(i, n, m) AS (VALUES {", ".join(f"({i}, {n}, {m})" for i, (n, m) in enumerate(_TERMS))}),
own AS (SELECT n_nationkey AS k, n, m, (n_nationkey * 7919 % 101 - 50) * 40::DOUBLE / (n * n) - CASE WHEN i = 0 THEN 9800::DOUBLE ELSE 0 END AS g, CASE WHEN m > 0 THEN (n_nationkey * 104729 % 97 - 48) * 30::DOUBLE / (n * n) ELSE 0 END AS h FROM nation JOIN term ON i = n_nationkey % 9),
sums AS (SELECT n, m, sum(g) AS g0, sum(h) AS h0, sum((k % 7 - 3) * 5)::DOUBLE AS g5, sum(CASE WHEN m > 0 THEN (k % 4 - 1) * 4 ELSE 0 END)::DOUBLE AS h5, sum((k % 5 - 2) * 2)::DOUBLE AS g9, sum(CASE WHEN m > 0 THEN (k % 3 - 1) * 1.5::DOUBLE ELSE 0 END) AS h9 FROM own GROUP BY n, m)"""
#: Of places(id, date, lat, lon, alt): sums by Schmidt's functions in closed form, and the strength's slopes.
_FIELD_SQL = """spot AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - ecc * ecc * sin(lat) ** 2) AS big_n, 6378137.0::DOUBLE * (1 - ecc * ecc) / (1 - ecc * ecc * sin(lat) ** 2) ** 1.5 AS big_m FROM (SELECT *, 0.0818191908426::DOUBLE AS ecc FROM places)),
geo AS (SELECT *, sqrt(ax * ax + up * up) AS rad, up / sqrt(ax * ax + up * up) AS c, ax / sqrt(ax * ax + up * up) AS s FROM (SELECT *, (big_n + alt) * cos(lat) AS ax, (big_n * (1 - ecc * ecc) + alt) * sin(lat) AS up FROM spot)),
fun AS (SELECT geo.*, n, m, (6371200.0::DOUBLE / rad) ** (n + 2) AS q, g0 + CASE WHEN date < 2015 THEN 0 WHEN date < 2020 THEN g5 * (date - 2015) / 5 ELSE g5 + g9 * (date - 2020) END AS g, h0 + CASE WHEN date < 2015 THEN 0 WHEN date < 2020 THEN h5 * (date - 2015) / 5 ELSE h5 + h9 * (date - 2020) END AS h,
 CASE n * 10 + m WHEN 10 THEN c WHEN 11 THEN s WHEN 20 THEN (3 * c * c - 1) / 2 WHEN 21 THEN sqrt(3) * s * c WHEN 22 THEN sqrt(3) / 2 * s * s WHEN 30 THEN (5 * c ** 3 - 3 * c) / 2 WHEN 31 THEN sqrt(6) / 4 * s * (5 * c * c - 1) WHEN 32 THEN sqrt(15) / 2 * s * s * c ELSE sqrt(10) / 4 * s ** 3 END AS p,
 CASE n * 10 + m WHEN 10 THEN -s WHEN 11 THEN c WHEN 20 THEN -3 * c * s WHEN 21 THEN sqrt(3) * (c * c - s * s) WHEN 22 THEN sqrt(3) * s * c WHEN 30 THEN -(15 * c * c - 3) / 2 * s WHEN 31 THEN sqrt(6) / 4 * (c * (5 * c * c - 1) - 10 * c * s * s) WHEN 32 THEN sqrt(15) / 2 * (2 * s * c * c - s ** 3) ELSE sqrt(10) / 4 * 3 * s * s * c END AS d,
 CASE n * 10 + m WHEN 10 THEN -c WHEN 11 THEN -s WHEN 20 THEN -3 * (c * c - s * s) WHEN 21 THEN -4 * sqrt(3) * s * c WHEN 22 THEN sqrt(3) * (c * c - s * s) WHEN 30 THEN 15 * c * s * s - (15 * c ** 3 - 3 * c) / 2 WHEN 31 THEN sqrt(6) / 4 * (s - 35 * c * c * s + 10 * s ** 3) WHEN 32 THEN sqrt(15) / 2 * (2 * c ** 3 - 7 * s * s * c) ELSE sqrt(10) / 4 * (6 * s * c * c - 3 * s ** 3) END AS e,
 CASE n * 10 + m WHEN 11 THEN 1 WHEN 21 THEN sqrt(3) * c WHEN 22 THEN sqrt(3) / 2 * s WHEN 31 THEN sqrt(6) / 4 * (5 * c * c - 1) WHEN 32 THEN sqrt(15) / 2 * s * c WHEN 33 THEN sqrt(10) / 4 * s * s ELSE 0 END AS a,
 CASE n * 10 + m WHEN 21 THEN -sqrt(3) * s WHEN 22 THEN sqrt(3) / 2 * c WHEN 31 THEN -sqrt(6) / 4 * 10 * c * s WHEN 32 THEN sqrt(15) / 2 * (c * c - s * s) WHEN 33 THEN sqrt(10) / 2 * s * c ELSE 0 END AS b FROM geo, sums),
wave AS (SELECT *, g * cos(m * lon) + h * sin(m * lon) AS w, m * (h * cos(m * lon) - g * sin(m * lon)) AS t FROM fun),
total AS (SELECT id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(alt) AS alt, any_value(c) AS c, any_value(s) AS s, any_value(rad) AS rad, any_value(ax) AS ax, any_value(up) AS up, any_value(big_m) AS big_m,
 sum((n + 1) * q * w * p) AS r, -sum(q * w * d) AS th, -sum(q * t * a) AS ph, -sum((n + 1) * (n + 2) * q * w * p) / any_value(rad) AS rr, sum((n + 2) * q * w * d) / any_value(rad) AS thr, sum((n + 2) * q * t * a) / any_value(rad) AS phr,
 sum((n + 1) * q * w * d) AS rt, -sum(q * w * e) AS tht, -sum(q * t * b) AS pht, sum((n + 1) * q * t * p) AS rp, -sum(q * t * d) AS thp, sum(q * m * m * w * a) AS php FROM wave GROUP BY id),
turned AS (SELECT *, -th * (cos(lat) * s + sin(lat) * c) - r * (sin(lat) * s - cos(lat) * c) AS north, ph AS east, -r * (cos(lat) * s + sin(lat) * c) + th * (sin(lat) * s - cos(lat) * c) AS down, sqrt(r * r + th * th + ph * ph) AS f FROM total)"""
_PLACES_SQL = "places AS (SELECT c_custkey AS id, 2012 + (c_custkey % 140) / 10::DOUBLE AS date, radians(c_custkey * 7.3::DOUBLE % 178 - 89) AS lat, radians(c_custkey * 13.7::DOUBLE % 360 - 180) AS lon, (c_custkey % 50) * 200::DOUBLE AS alt FROM customer)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat, lon = F.radians(key * 7.3 % 178 - 89), F.radians(key * 13.7 % 360 - 180)
    return load(spark, sf_dir, "customer").select("c_custkey", (2012 + key % 140 / 10).alias("date"), lat.alias("lat"), lon.alias("lon"), (key % 50 * 200.0).alias("alt"))


_AT = ("date", "lat", "lon", "alt")


@query(f"WITH {_MODEL_SQL}, {_PLACES_SQL}, {_FIELD_SQL} SELECT id AS c_custkey, round(north, 4) + 0.0 AS north, round(east, 4) + 0.0 AS east, round(down, 4) + 0.0 AS down FROM turned")
def reference_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = field.field(_places(spark, sf_dir), model(spark, sf_dir), *map(F.col, _AT))
    return rounded(found.select("c_custkey", "north", "east", "down"), 4)


@query(f"""WITH {_MODEL_SQL}, {_PLACES_SQL}, {_FIELD_SQL}, slope AS (SELECT *, (r * rr + th * thr + ph * phr) / f AS fr, (r * rt + th * tht + ph * pht) / f AS ft, (r * rp + th * thp + ph * php) / f AS fp FROM turned)
SELECT id AS c_custkey, round(fr * (-ax * (big_m + alt) * sin(lat) + up * (big_m + alt) * cos(lat)) / rad - ft * (big_m + alt) * (up * sin(lat) + ax * cos(lat)) / (rad * rad), 4) + 0.0 AS by_lat, round(fp, 4) + 0.0 AS by_lon,
 round(fr * (ax * cos(lat) + up * sin(lat)) / rad + ft * (up * cos(lat) - ax * sin(lat)) / (rad * rad), 9) + 0.0 AS by_alt FROM slope""")
def reference_field_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = field.gradient(_places(spark, sf_dir), model(spark, sf_dir), *map(F.col, _AT))
    return rounded(found.select("c_custkey", F.round("by_lat", 4).alias("by_lat"), F.round("by_lon", 4).alias("by_lon"), "by_alt"), 9)


@query(f"""WITH {_MODEL_SQL}, flight AS (SELECT o_orderkey AS id, year(o_orderdate) + 23 AS year, dayofyear(o_orderdate) AS doy, (o_orderkey % 86400)::DOUBLE AS tt, radians(o_orderkey * 7.3::DOUBLE % 178 - 89) AS lat, radians(o_orderkey * 13.7::DOUBLE % 360 - 180) AS lon, (o_custkey % 50) * 200::DOUBLE AS alt,
 radians(o_orderkey % 41 - 20) AS roll, radians(o_orderkey % 31 - 15) AS pitch, radians(o_orderkey % 360) AS yaw FROM orders),
places AS (SELECT *, year + (doy - 1) / CASE WHEN year % 4 = 0 THEN 366::DOUBLE ELSE 365 END + tt / (86400 * CASE WHEN year % 4 = 0 THEN 366::DOUBLE ELSE 365 END) AS date FROM flight), {_FIELD_SQL},
body AS (SELECT id, north / f AS n, east / f AS e, down / f AS d FROM turned)
SELECT id AS o_orderkey, round(n * cos(pitch) * cos(yaw) + e * cos(pitch) * sin(yaw) - d * sin(pitch), 6) + 0.0 AS field_x,
 round(n * (sin(roll) * sin(pitch) * cos(yaw) - cos(roll) * sin(yaw)) + e * (cos(roll) * cos(yaw) + sin(roll) * sin(pitch) * sin(yaw)) + d * sin(roll) * cos(pitch), 6) + 0.0 AS field_y,
 round(n * (sin(roll) * sin(yaw) + cos(roll) * sin(pitch) * cos(yaw)) + e * (cos(roll) * sin(pitch) * sin(yaw) - sin(roll) * cos(yaw)) + d * cos(roll) * cos(pitch), 6) + 0.0 AS field_z FROM body JOIN flight USING (id)""")
def flight_reference_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the field in the body frame; orders are samples of flights, 23 years later."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    flight = load(spark, sf_dir, "orders").select(
        "o_orderkey", (F.year(day) + 23).alias("year"), F.dayofyear(day).alias("doy"), (key % 86400).cast("double").alias("tt"), F.radians(key * 7.3 % 178 - 89).alias("lat"), F.radians(key * 13.7 % 360 - 180).alias("lon"),
        (F.col("o_custkey") % 50 * 200.0).alias("alt"), F.radians(key % 41 - 20).alias("roll"), F.radians(key % 31 - 15).alias("pitch"), F.radians(key % 360).alias("yaw"),
    )
    return rounded(field.flight_field(flight, model(spark, sf_dir), "body", True).select("o_orderkey", "field_x", "field_y", "field_z"), 6)


@query(f"""WITH {GRID_SQL}, {_MODEL_SQL}, twice AS (SELECT iy * 1000 + ix AS id, CAST(unnest([2013.8, 2021.5]) AS DOUBLE) AS date, radians(yy) AS lat, radians(xx) AS lon, 300::DOUBLE AS alt FROM cells),
once AS (SELECT *, id * 2 + CASE WHEN date > 2014 THEN 1 ELSE 0 END AS id2 FROM twice), again AS (SELECT id2 AS id, date, lat, lon, alt FROM once), {_FIELD_SQL.replace("FROM places)", "FROM again)")}
SELECT iy, ix, round(CASE WHEN val = 0 THEN 0 ELSE val - x.f + y.f END, 4) + 0.0 AS val FROM cells JOIN turned x ON x.id = 2 * (iy * 1000 + ix) JOIN turned y ON y.id = 2 * (iy * 1000 + ix) + 1""")
def map_reference_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid in degrees, without altitudes, less the field of 2013.8 and plus that of 2021.5."""
    cells = grid(spark, sf_dir).withColumn("alt", F.lit(-1.0))
    return rounded(field.corrected_map(cells, model(spark, sf_dir), 2013.8, 2021.5, "deg").select("iy", "ix", "val"), 4)
