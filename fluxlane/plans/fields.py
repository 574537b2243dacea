"""Queries on map grids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators import grid as g
from fluxlane.operators import mapcache, spectral, spline
from fluxlane.plans.catalog import query
from fluxlane.plans.tables import GRID_SQL, grid, load, rounded
from fluxlane.sources.tables import scratch

_NEAR = "JOIN (SELECT unnest([-1, 0, 1]) AS a) p ON true JOIN (SELECT unnest([-1, 0, 1]) AS b) q ON NOT (a = 0 AND b = 0)"
_BILINEAR = """corner AS (SELECT ix, iy, val, CASE WHEN lead(ix) OVER a = ix + 1 THEN lead(val) OVER a END AS r10 FROM cells WINDOW a AS (PARTITION BY iy ORDER BY ix)),
raw AS (SELECT ix, iy, val, r10, CASE WHEN lead(iy) OVER u = iy + 1 THEN lead(val) OVER u END AS r01, CASE WHEN lead(iy) OVER u = iy + 1 THEN lead(r10) OVER u END AS r11 FROM corner WINDOW u AS (PARTITION BY ix ORDER BY iy)),
box AS (SELECT ix, iy, val AS v00, coalesce(r10, val) AS v10, coalesce(r01, val) AS v01, coalesce(r11, r10, r01, val) AS v11 FROM raw)"""


@query(f"WITH {GRID_SQL} SELECT iy, ix, round(yy, 4) AS yy, round(xx, 4) AS xx, round(val, 4) AS val FROM cells")
def grid_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid(spark, sf_dir).select("iy", "ix", "yy", "xx", F.round("val", 4).alias("val")))


@query(f"WITH {GRID_SQL} SELECT sum(CASE WHEN val = 0 THEN 0 ELSE 1 END)::BIGINT AS n_data, sum(CASE WHEN val = 0 THEN 1 ELSE 0 END)::BIGINT AS n_missing, (max(ix) - min(ix) + 1)::BIGINT AS nx, (max(iy) - min(iy) + 1)::BIGINT AS ny FROM cells")
def grid_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.params(grid(spark, sf_dir)).drop("map_name")


@query(f"""WITH {GRID_SQL}, e AS (SELECT min(ix) AS x1, max(ix) AS x2, min(iy) AS y1, max(iy) AS y2 FROM cells WHERE val <> 0 AND xx BETWEEN 1.1 AND 6.3 AND yy BETWEEN 4 AND 30)
SELECT iy, ix, round(val, 4) AS val FROM cells, e WHERE ix BETWEEN x1 - 1 AND x2 + 1 AND iy BETWEEN y1 - 1 AND y2 + 1""")
def grid_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.trim(grid(spark, sf_dir), 1, (1.1, 6.3), (4.0, 30.0)).select("iy", "ix", F.round("val", 4).alias("val")))


@query(f"""WITH {GRID_SQL}, n AS (SELECT ix + a AS ix, iy + b AS iy, count(*) AS n FROM (SELECT ix, iy FROM cells WHERE val <> 0) {_NEAR} GROUP BY 1, 2)
SELECT iy, ix FROM cells LEFT JOIN n USING (ix, iy) WHERE val <> 0 AND coalesce(n, 0) < 8""")
def grid_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.border(grid(spark, sf_dir)).select("iy", "ix")


@query(f"""WITH {GRID_SQL}, n AS (SELECT DISTINCT ix + a AS ix, iy + b AS iy FROM (SELECT ix, iy FROM cells WHERE val <> 0) {_NEAR})
SELECT iy, ix FROM cells JOIN n USING (ix, iy) WHERE val = 0""")
def grid_border_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.border(grid(spark, sf_dir), inner=False).select("iy", "ix")


@query(f"""WITH {GRID_SQL}, k AS (SELECT h.ix, h.iy, d.val, row_number() OVER (PARTITION BY h.ix, h.iy ORDER BY (h.xx - d.xx) ** 2 + (h.yy - d.yy) ** 2, d.iy, d.ix) AS r FROM cells h JOIN cells d ON h.val = 0 AND d.val <> 0),
f AS (SELECT ix, iy, avg(val) AS v FROM k WHERE r <= 3 GROUP BY 1, 2)
SELECT iy, ix, round(coalesce(v, val), 4) AS val FROM cells LEFT JOIN f USING (ix, iy)""")
def grid_fill_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.fill(grid(spark, sf_dir)).select("iy", "ix", F.round("val", 4).alias("val")))


_POINTS_SQL = "pts AS (SELECT c_custkey, c_custkey * 7.3::DOUBLE % 11 - 0.3::DOUBLE AS lon, c_custkey * 3.1::DOUBLE % 45 - 0.5::DOUBLE AS lat FROM customer)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", (key * 7.3 % 11 - 0.3).alias("lon"), (key * 3.1 % 45 - 0.5).alias("lat"))


_LOOKUP_SQL = """lim AS (SELECT min(ix) AS lx, min(iy) AS ly, max(ix) AS mx, max(iy) AS my FROM cells),
spot AS (SELECT *, lon / 0.25::DOUBLE AS fx, lat / 0.5::DOUBLE AS fy FROM pts),
hit AS (SELECT c_custkey, fx, fy, CASE WHEN fx >= lx AND fx <= mx AND fy >= ly AND fy <= my THEN least(floor(fx), mx - 1) END AS jx, CASE WHEN fx >= lx AND fx <= mx AND fy >= ly AND fy <= my THEN least(floor(fy), my - 1) END AS jy FROM spot, lim)"""


@query(f"""WITH {GRID_SQL}, {_POINTS_SQL}, {_BILINEAR}, {_LOOKUP_SQL}
SELECT c_custkey, round((1 - (fx - jx)) * (1 - (fy - jy)) * v00 + (fx - jx) * (1 - (fy - jy)) * v10 + (1 - (fx - jx)) * (fy - jy) * v01 + (fx - jx) * (fy - jy) * v11, 3) + 0.0 AS map_val
FROM hit LEFT JOIN box ON box.ix = jx AND box.iy = jy""")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return rounded(g.lookup(_points(spark, sf_dir), cells, g.axes(cells)).select("c_custkey", "map_val"), 3)


@query(f"""WITH {GRID_SQL}, pts AS (SELECT a.i * 30 + b.j AS c_custkey, 0.607::DOUBLE + b.j * 0.31::DOUBLE AS lon, 3.013::DOUBLE + a.i * 1.05::DOUBLE AS lat FROM range(20) a(i), range(30) b(j)), {_BILINEAR}, {_LOOKUP_SQL}
SELECT CAST(c_custkey // 30 AS INTEGER) AS iy, CAST(c_custkey % 30 AS INTEGER) AS ix,
 round(coalesce(CASE WHEN (v00 <> 0 OR (1 - fx + jx) * (1 - fy + jy) < 1e-9) AND (v10 <> 0 OR (fx - jx) * (1 - fy + jy) < 1e-9) AND (v01 <> 0 OR (1 - fx + jx) * (fy - jy) < 1e-9) AND (v11 <> 0 OR (fx - jx) * (fy - jy) < 1e-9)
 THEN (1 - (fx - jx)) * (1 - (fy - jy)) * v00 + (fx - jx) * (1 - (fy - jy)) * v10 + (1 - (fx - jx)) * (fy - jy) * v01 + (fx - jx) * (fy - jy) * v11 END, 0), 3) + 0.0 AS val
FROM hit LEFT JOIN box ON box.ix = jx AND box.iy = jy""")
def grid_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = g.Axes(0.607, 3.013, 0.31, 1.05, 30, 20)
    return rounded(g.resample(grid(spark, sf_dir), new).select("iy", "ix", "val"), 3)


@query(f"WITH {GRID_SQL} SELECT iy, ix, round(CASE WHEN val = 0 THEN coalesce(CASE WHEN iy % 2 = 0 THEN raw_other END, 0) ELSE val END, 4) + 0.0 AS val FROM (SELECT *, iy * 1000.0 + ix AS raw_other FROM cells)")
def grid_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    other = cells.filter("iy % 2 = 0").withColumn("val", F.col("iy") * 1000.0 + F.col("ix"))
    return rounded(g.combine(cells, other).select("iy", "ix", F.round("val", 4).alias("val")))


def _on_data_sql(cells: str) -> str:
    """Of points pts: on_data(c_custkey, on_): whether each lies strictly inside the cells, on corners that all have data."""
    masked = f"mask AS (SELECT iy, ix, CASE WHEN val = 0 THEN 0::DOUBLE ELSE 1 END AS val FROM {cells}), " + f"{_BILINEAR}, {_LOOKUP_SQL}".replace("FROM cells", "FROM mask")
    share = "(1 - (fx - jx)) * (1 - (fy - jy)) * v00 + (fx - jx) * (1 - (fy - jy)) * v10 + (1 - (fx - jx)) * (fy - jy) * v01 + (fx - jx) * (fy - jy) * v11"
    return f"{masked}, on_data AS (SELECT c_custkey, coalesce(fx > lx AND fx < mx AND fy > ly AND fy < my AND {share} > 1 - 1e-9, false) AS on_ FROM hit LEFT JOIN box ON box.ix = jx AND box.iy = jy, lim)"


@query(f"WITH {GRID_SQL}, {_POINTS_SQL}, {_on_data_sql('cells')} SELECT c_custkey, on_ AS on_data FROM on_data")
def grid_on_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return g.on_data(_points(spark, sf_dir), cells, g.axes(cells)).select("c_custkey", "on_data")


_CLEAR = "lon > 1 AND lon < 9 AND lat > 19 AND lat < 37 AND (CAST(floor(lat / 0.5) AS BIGINT) * 7 + CAST(floor(lon / 0.25) AS BIGINT) * 3) % 11 NOT IN (0, 1, 4, 8)"


@query(f"WITH {GRID_SQL}, {_POINTS_SQL}, {_on_data_sql('cells')} SELECT 'all' AS part, bool_and(on_) AS inside FROM on_data UNION ALL SELECT 'clear', coalesce(bool_and(on_), true) FROM on_data JOIN pts USING (c_custkey) WHERE {_CLEAR}")
def grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all points lie on the map, and whether those in cells without a missing corner do."""
    cells, points = grid(spark, sf_dir), _points(spark, sf_dir)
    found = [g.check(p, cells, g.axes(cells)).select(F.lit(part).alias("part"), "inside") for part, p in (("all", points), ("clear", points.filter(_CLEAR)))]
    return found[0].unionByName(found[1])


_CACHE_POINTS_SQL = _POINTS_SQL.replace("AS lat FROM", "AS lat, (c_custkey * 37 % 450) / 100::DOUBLE AS alt FROM")


def _cache(spark: SparkSession, sf_dir: str, folder: str) -> tuple[mapcache.MapCache, DataFrame]:
    """A filled map at 0 and a map of its left half, with holes, at 1.5; levels every 1."""
    columns = ["map_name", "iy", "ix", "yy", "xx", "alt", "val"]
    base = g.fill(grid(spark, sf_dir)).withColumns({"map_name": F.lit("base"), "alt": F.lit(0.0)})
    high = grid(spark, sf_dir).filter("ix <= 20").withColumns({"map_name": F.lit("high"), "alt": F.lit(1.5)})
    points = _points(spark, sf_dir).withColumn("alt", F.col("c_custkey") * 37 % 450 / 100)
    return mapcache.MapCache(base.select(columns).unionByName(high.select(columns)), "base", folder, 1.0), points


@query(f"""WITH {GRID_SQL}, {_CACHE_POINTS_SQL}, half AS (SELECT * FROM cells WHERE ix <= 20), {_on_data_sql("half")}
SELECT c_custkey, CASE WHEN on_ AND alt >= 1.5 THEN 'high' ELSE 'base' END AS map_name, CASE WHEN on_ AND alt >= 1.5 THEN greatest(floor(alt), 1.5::DOUBLE) ELSE floor(alt) END AS level FROM on_data JOIN pts USING (c_custkey)""")
def map_cache_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which map and level serves each point."""
    cache, points = _cache(spark, sf_dir, "")
    return cache.placed(points).select("c_custkey", "map_name", "level")


@query()
def map_cache_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels' values, from a store that the query fills."""
    cache, points = _cache(spark, sf_dir, f"{scratch(spark)}/levels-{uuid.uuid4().hex}")
    return cache.values(points).select("c_custkey", "map_name", "level", "map_val")


@query("SELECT o_orderkey, floor(o_totalprice / 5000) * 5000 AS bucket, CASE WHEN floor(o_totalprice / 5000) * 5000 >= 200000 THEN 'high' WHEN floor(o_totalprice / 5000) * 5000 >= 60000 THEN 'mid' WHEN floor(o_totalprice / 5000) * 5000 >= 1000 THEN 'low' END AS map_name FROM orders")
def altitude_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = spark.createDataFrame([("low", 1000.0), ("high", 200000.0), ("mid", 60000.0)], "map_name string, map_alt double")
    points = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("alt"))
    return g.pick_map(points, maps, 5000.0).select("o_orderkey", F.col("bucket").cast("double").alias("bucket"), "map_name")


@query(f"WITH {GRID_SQL}, q AS (SELECT quantile_cont(val, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM cells WHERE val <> 0) SELECT CAST(i AS INTEGER) AS colour, round(e[i + 1], 3) AS \"limit\" FROM q, range(6) r(i)")
def colour_limits_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.colour_limits(grid(spark, sf_dir), 5), 3)


@query(f"""WITH {GRID_SQL}, l AS (SELECT iy, ix, val, 100.0 AS alt FROM cells UNION ALL SELECT iy, ix, val * 2, 200.0 FROM cells UNION ALL SELECT iy, ix, val * 5, 400.0 FROM cells)
SELECT iy, ix, round(val * 2 + (260 - 200) / 200.0 * (val * 5 - val * 2), 4) + 0.0 AS val FROM cells""")
def grid_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    stack = None
    for alt, k in ((100.0, 1), (200.0, 2), (400.0, 5)):
        level = cells.withColumn("val", F.col("val") * k).withColumn("alt", F.lit(alt))
        stack = level if stack is None else stack.unionByName(level)
    return rounded(g.level_at(stack, 260.0).select("iy", "ix", "val"), 4)


@query(f"""WITH {GRID_SQL}, m AS (SELECT iy, ix, val, 100.0 AS alt FROM cells WHERE val <> 0 UNION ALL SELECT iy, ix, val * 2, 300.0 FROM cells WHERE val <> 0 AND ix % 2 = 0), l AS (SELECT unnest([50.0, 150.0, 350.0]) AS level),
r AS (SELECT level, iy, ix, val, alt, row_number() OVER (PARTITION BY level, iy, ix ORDER BY alt <= level DESC, CASE WHEN alt <= level THEN alt ELSE -alt END DESC) AS k FROM m, l)
SELECT CAST(level AS DOUBLE) AS level, iy, ix, round(val, 4) AS val, CAST(alt AS DOUBLE) AS from_alt FROM r WHERE k = 1""")
def grid_combine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    high = cells.filter("ix % 2 = 0").withColumn("val", F.col("val") * 2).withColumn("alt", F.lit(300.0))
    return rounded(g.combine_levels(cells.withColumn("alt", F.lit(100.0)).unionByName(high), [50.0, 150.0, 350.0]), 4)


_FILLED_SQL = """near AS (SELECT h.ix, h.iy, d.val, row_number() OVER (PARTITION BY h.ix, h.iy ORDER BY (h.xx - d.xx) ** 2 + (h.yy - d.yy) ** 2, d.iy, d.ix) AS r FROM cells h JOIN cells d ON h.val = 0 AND d.val <> 0),
holes AS (SELECT ix, iy, avg(val) AS v FROM near WHERE r <= 3 GROUP BY 1, 2), filled AS (SELECT iy, ix, yy, xx, coalesce(v, val) AS val FROM cells LEFT JOIN holes USING (ix, iy))"""
_SIDES_SQL = "g AS (SELECT min(ix) AS x0, max(ix) - min(ix) + 1 AS nx, min(iy) AS y0, max(iy) - min(iy) + 1 AS ny, (max(xx) - min(xx)) / (max(ix) - min(ix)) AS dx, (max(yy) - min(yy)) / (max(iy) - min(iy)) AS dy FROM cells)"


def _spline_sql(kind: str, value: str) -> str:
    """The spline's coefficients by the closed form of its equations' inverse, and its value at points by the distance of nodes."""
    middle, scale = {"quadratic": (6, 8), "cubic": (4, 6)}[kind]
    basis = {
        "quadratic": "CASE WHEN abs({t}) <= 0.5 THEN 0.75::DOUBLE - {t} * {t} WHEN abs({t}) <= 1.5 THEN (1.5::DOUBLE - abs({t})) ** 2 / 2 ELSE 0 END",
        "cubic": "CASE WHEN abs({t}) <= 1 THEN 2 / 3::DOUBLE - {t} * {t} + abs({t}) ** 3 / 2 WHEN abs({t}) <= 2 THEN (2 - abs({t})) ** 3 / 6 ELSE 0 END",
    }[kind]
    return f"""WITH {GRID_SQL}, {_FILLED_SQL}, {_SIDES_SQL}, {_POINTS_SQL},
side AS (SELECT 'x' AS axis, nx AS n FROM g UNION ALL SELECT 'y', ny FROM g),
inner_ AS (SELECT axis, n, acosh({middle / 2}::DOUBLE) AS a, unnest(range(1, n - 1)) AS i FROM side),
inverse AS (SELECT p.axis, p.n, p.i, q.i AS j, (CASE WHEN (p.i + q.i) % 2 = 0 THEN 1 ELSE -1 END) * sinh(least(p.i, q.i) * p.a) * sinh((p.n - 1 - greatest(p.i, q.i)) * p.a) / sinh(p.a) / sinh((p.n - 1) * p.a) AS t FROM inner_ p JOIN inner_ q ON p.axis = q.axis),
base AS (SELECT axis, 1 AS c, 1 AS y, 1::DOUBLE AS w, n FROM side UNION ALL SELECT axis, n, n, 1, n FROM side UNION ALL SELECT axis, i + 1, j + 1, {scale} * t, n FROM inverse
 UNION ALL SELECT axis, i + 1, 1, -t, n FROM inverse WHERE j = 1 UNION ALL SELECT axis, i + 1, n, -t, n FROM inverse WHERE j = n - 2),
whole AS (SELECT axis, c, y, w FROM base UNION ALL SELECT axis, 0, y, CASE WHEN c = 1 THEN 2 ELSE -1 END * w FROM base WHERE c IN (1, 2) UNION ALL SELECT axis, n + 1, y, CASE WHEN c = n THEN 2 ELSE -1 END * w FROM base WHERE c IN (n, n - 1)),
along AS (SELECT iy, c AS cx, sum(w * val) AS val FROM filled, g, whole WHERE axis = 'x' AND y = ix - x0 + 1 GROUP BY 1, 2),
coef AS (SELECT c AS cy, cx, sum(w * val) AS coef FROM along, g, whole WHERE axis = 'y' AND y = iy - y0 + 1 GROUP BY 1, 2),
spot AS (SELECT c_custkey, lon, lat, lon / dx - x0 AS fx, lat / dy - y0 AS fy, lon / dx >= x0 AND lon / dx <= x0 + nx - 1 AND lat / dy >= y0 AND lat / dy <= y0 + ny - 1 AS inside FROM pts, g),
found AS (SELECT c_custkey, sum(coef * {basis.format(t="(fx - cx + 1)")} * {basis.format(t="(fy - cy + 1)")}) AS v FROM spot JOIN coef ON inside AND cx BETWEEN floor(fx) - 1 AND floor(fx) + 4 AND cy BETWEEN floor(fy) - 1 AND floor(fy) + 4 GROUP BY 1)
{value}"""


_SPLINE_VALUE = "SELECT c_custkey, round(v, 3) + 0.0 AS map_val FROM spot LEFT JOIN found USING (c_custkey)"


def _splined(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    cells = g.fill(grid(spark, sf_dir))
    return rounded(spline.interpolated(_points(spark, sf_dir), cells, g.axes(grid(spark, sf_dir)), kind).select("c_custkey", "map_val"), 3)


@query(_spline_sql("cubic", _SPLINE_VALUE))
def spline_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splined(spark, sf_dir, "cubic")


@query(_spline_sql("quadratic", _SPLINE_VALUE))
def spline_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splined(spark, sf_dir, "quadratic")


_FORWARD_SQL = """kk AS (SELECT unnest(range(nx)) AS k FROM g), ll AS (SELECT unnest(range(ny)) AS l FROM g),
rowed AS (SELECT iy - y0 AS y, k, sum(val * cos(2 * pi() * k * (ix - x0) / nx)) AS re, -sum(val * sin(2 * pi() * k * (ix - x0) / nx)) AS im FROM cells, g, kk GROUP BY 1, 2),
f AS (SELECT l, k, sum(re * cos(2 * pi() * l * y / ny) + im * sin(2 * pi() * l * y / ny)) AS re, sum(im * cos(2 * pi() * l * y / ny) - re * sin(2 * pi() * l * y / ny)) AS im FROM rowed, g, ll GROUP BY 1, 2),
waves AS (SELECT l, k, re, im, 2 * pi() * CASE WHEN k < (nx + 1) // 2 THEN k ELSE k - nx END / (nx * dx) AS u, 2 * pi() * CASE WHEN l < (ny + 1) // 2 THEN l ELSE l - ny END / (ny * dy) AS v FROM f, g)"""


@query(f"""WITH {GRID_SQL}, {_FILLED_SQL}, {_SIDES_SQL}, smooth AS (SELECT DISTINCT CAST(2 ** a * 3 ** b * 5 ** c * 7 ** d AS BIGINT) AS n FROM range(13) p(a), range(8) q(b), range(6) r(c), range(5) s(d) WHERE 2 ** a * 3 ** b * 5 ** c * 7 ** d < 4096),
goal AS (SELECT z, CAST(ceil(10 * z / least(dx, dy)) AS BIGINT) AS pad FROM g, (SELECT unnest([0.5::DOUBLE, 2.0::DOUBLE]) AS z)),
side AS (SELECT z, axis, n, d, (SELECT min(m.n) FROM smooth m WHERE m.n >= o.n + 2 * pad) AS m FROM (SELECT z, pad, 'x' AS axis, nx AS n, dx AS d FROM goal, g UNION ALL SELECT z, pad, 'y', ny, dy FROM goal, g) o),
gap AS (SELECT *, (m - n) // 2 AS p, unnest(range(m - n)) AS i FROM side),
ramp AS (SELECT z, axis, m, n, CASE WHEN i >= m - n - p THEN i - (m - n - p) ELSE p + n + i END AS j, (i + 1) / (m - n + 1)::DOUBLE AS t FROM gap),
padded AS (SELECT z, axis, m, unnest(range(n)) AS x, unnest(range(n)) + (m - n) // 2 AS j, 1::DOUBLE AS w FROM side UNION ALL SELECT z, axis, m, n - 1, j, 1 - t FROM ramp UNION ALL SELECT z, axis, m, 0, j, t FROM ramp),
freq AS (SELECT z, axis, m, unnest(range(m)) AS k FROM side),
way AS (SELECT z, axis, k, x, sum(w * cos(2 * pi() * (k * j % m) / m)) AS c, -sum(w * sin(2 * pi() * (k * j % m) / m)) AS s FROM padded JOIN freq USING (z, axis, m) GROUP BY 1, 2, 3, 4),
r1 AS (SELECT z, iy - y0 AS y, k, sum(val * c) AS re, sum(val * s) AS im FROM filled, g, way WHERE axis = 'x' AND x = ix - x0 GROUP BY 1, 2, 3),
r2 AS (SELECT r1.z, way.k AS l, r1.k, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM r1 JOIN way ON way.axis = 'y' AND way.x = r1.y AND way.z = r1.z GROUP BY 1, 2, 3),
damped AS (SELECT r2.z, l, r2.k, re * h AS re, im * h AS im, a.m AS mx, (a.m - a.n) // 2 AS px, b.m AS my, (b.m - b.n) // 2 AS py FROM (SELECT r2.z, r2.l, r2.k, r2.re, r2.im,
 exp(-r2.z * sqrt((2 * pi() * CASE WHEN r2.k < (a.m + 1) // 2 THEN r2.k ELSE r2.k - a.m END / (a.m * a.d)) ** 2 + (2 * pi() * CASE WHEN r2.l < (b.m + 1) // 2 THEN r2.l ELSE r2.l - b.m END / (b.m * b.d)) ** 2)) AS h FROM r2 JOIN side a ON a.axis = 'x' AND a.z = r2.z JOIN side b ON b.axis = 'y' AND b.z = r2.z) r2
 JOIN side a ON a.axis = 'x' AND a.z = r2.z JOIN side b ON b.axis = 'y' AND b.z = r2.z),
r3 AS (SELECT z, k, y, mx, px, my, sum(re * cos(2 * pi() * (l * (y + py) % my) / my) - im * sin(2 * pi() * (l * (y + py) % my) / my)) AS re, sum(re * sin(2 * pi() * (l * (y + py) % my) / my) + im * cos(2 * pi() * (l * (y + py) % my) / my)) AS im FROM damped, (SELECT unnest(range(ny)) AS y FROM g) GROUP BY 1, 2, 3, 4, 5, 6),
r4 AS (SELECT z, y, x, sum(re * cos(2 * pi() * (k * (x + px) % mx) / mx) - im * sin(2 * pi() * (k * (x + px) % mx) / mx)) / any_value(mx) / any_value(my) AS val FROM r3, (SELECT unnest(range(nx)) AS x FROM g) GROUP BY 1, 2, 3)
SELECT 'orders' AS map_name, z AS alt, CAST(y + y0 AS INTEGER) AS iy, CAST(x + x0 AS INTEGER) AS ix, (y + y0) * 0.5::DOUBLE AS yy, (x + x0) * 0.25::DOUBLE AS xx, round(val, 3) + 0.0 AS val FROM r4, g UNION ALL
SELECT 'orders', 0, CAST(y + y0 AS INTEGER), CAST(x + x0 AS INTEGER), (y + y0) * 0.5::DOUBLE, (x + x0) * 0.25::DOUBLE, round(coalesce(val, 0), 3) + 0.0 FROM g, (SELECT unnest(range(ny)) AS y FROM g), (SELECT unnest(range(nx)) AS x FROM g) LEFT JOIN filled ON iy = y + y0 AND ix = x + x0""")
def fft_upward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.continue_map(g.fill(grid(spark, sf_dir)).withColumn("alt", F.lit(0.0)), [0.0, 0.5, 2.0]), 3)


@query(f"WITH {GRID_SQL}, {_SIDES_SQL}, {_FORWARD_SQL} SELECT 'orders' AS map_name, round(u, 6) + 0.0 AS kx, round(v, 6) + 0.0 AS ky, round(log10(re * re + im * im), 6) + 0.0 AS log_power FROM waves")
def fft_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power's logarithm, which engines can agree on over its whole range."""
    return rounded(spectral.spectrum_of_map(grid(spark, sf_dir)).select("map_name", "kx", "ky", F.log10("power").alias("log_power")))


@query(f"""WITH {GRID_SQL}, {_SIDES_SQL}, {_FORWARD_SQL},
below AS (SELECT *, sqrt(u * u + v * v) AS s, sin(1.1::DOUBLE) * sqrt(u * u + v * v) AS br, cos(1.1::DOUBLE) * (u * cos(0.2::DOUBLE) + v * sin(0.2::DOUBLE)) AS bi FROM waves),
part AS (SELECT *, unnest(['x', 'y', 'z']) AS way FROM below),
ratio AS (SELECT l, k, way, re, im, CASE WHEN s = 0 THEN 1 WHEN way = 'z' THEN s * br / (br * br + bi * bi) ELSE a * bi / (br * br + bi * bi) END AS hr, CASE WHEN s = 0 THEN 0 WHEN way = 'z' THEN -s * bi / (br * br + bi * bi) ELSE a * br / (br * br + bi * bi) END AS hi FROM (SELECT *, CASE way WHEN 'x' THEN u ELSE v END AS a FROM part)),
turned AS (SELECT l, k, way, re * hr - im * hi AS re, re * hi + im * hr AS im FROM ratio),
r3 AS (SELECT way, k, y.l AS y, sum(re * cos(2 * pi() * (t.l * y.l % ny) / ny) - im * sin(2 * pi() * (t.l * y.l % ny) / ny)) AS re, sum(re * sin(2 * pi() * (t.l * y.l % ny) / ny) + im * cos(2 * pi() * (t.l * y.l % ny) / ny)) AS im FROM turned t, ll y, g GROUP BY 1, 2, 3),
r4 AS (SELECT way, y, x.k AS x, sum(re * cos(2 * pi() * (r3.k * x.k % nx) / nx) - im * sin(2 * pi() * (r3.k * x.k % nx) / nx)) / any_value(nx) / any_value(ny) AS val FROM r3, kk x, g GROUP BY 1, 2, 3)
SELECT 'orders' AS map_name, CAST(y + y0 AS INTEGER) AS iy, CAST(x + x0 AS INTEGER) AS ix, round(max(CASE WHEN way = 'x' THEN val END), 3) + 0.0 AS val_x, round(max(CASE WHEN way = 'y' THEN val END), 3) + 0.0 AS val_y, round(max(CASE WHEN way = 'z' THEN val END), 3) + 0.0 AS val_z FROM r4, g GROUP BY 1, 2, 3""")
def fft_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.vectors_of_map(grid(spark, sf_dir), 0.2, 1.1), 3)


@query()
def drape_to_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    drape = g.fill(grid(spark, sf_dir)).withColumn("alt", 10.0 + F.col("ix") * 0.01)
    return spectral.level_drape(drape, 10.5, 1.0, 1.0, 0.1, 0.01)


@query(f"""WITH {GRID_SQL}, {_POINTS_SQL}, {_BILINEAR}, {_LOOKUP_SQL}
SELECT c_custkey, round(((1 - (fx - jx)) * (1 - (fy - jy)) * v00 + (fx - jx) * (1 - (fy - jy)) * v10 + (1 - (fx - jx)) * (fy - jy) * v01 + (fx - jx) * (fy - jy) * v11)
 * CASE WHEN z < 100 THEN 1 WHEN z < 200 THEN 1 + (z - 100) / 100 * 2 WHEN z < 400 THEN 3 + (z - 200) / 200 * 1 ELSE 4 END, 3) + 0.0 AS map_val
FROM (SELECT *, (c_custkey * 37 % 450)::DOUBLE AS z FROM hit) LEFT JOIN box ON box.ix = jx AND box.iy = jy""")
def grid_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stack of three levels whose values are 1, 3 and 4 times the grid's."""
    cells = grid(spark, sf_dir)
    level = F.explode(F.array(*[F.struct(F.lit(alt).alias("alt"), F.lit(k).alias("k")) for alt, k in ((100.0, 1.0), (200.0, 3.0), (400.0, 4.0))]))
    stack = cells.withColumn("level", level).withColumns({"alt": F.col("level.alt"), "val": F.col("val") * F.col("level.k")}).drop("level")
    points = _points(spark, sf_dir).withColumn("alt", (F.col("c_custkey") * 37 % 450).cast("double"))
    return rounded(g.lookup_levels(points, stack, g.axes(cells)).select("c_custkey", "map_val"), 3)


def _waves(coefficients: list[float], wave: str, x: str, swell: str, y: str) -> str:
    return " + ".join(f"{c!r}::DOUBLE * {wave}({2 * j} * {x}) * {swell}({2 * j} * {y})" for j, c in enumerate(coefficients, 1))


_R = f"({geodesy.UTM_SCALE!r}::DOUBLE * {geodesy._RECTIFIED!r}::DOUBLE)"
_E = f"{2 * geodesy._N**0.5 / (1 + geodesy._N)!r}::DOUBLE"


@query(f"""WITH p AS (SELECT c_custkey, radians(c_custkey * 7.3::DOUBLE % 160 - 80) AS lat, radians(c_custkey * 13.7::DOUBLE % 360 - 180) AS lon FROM customer),
q AS (SELECT *, CAST(floor((degrees(lon) + 180) / 6) AS INTEGER) % 60 + 1 AS zone, sinh(atanh(sin(lat)) - {_E} * atanh({_E} * sin(lat))) AS t FROM p),
r AS (SELECT *, atan2(t, cos(lon - radians(zone * 6 - 183))) AS xi, atanh(sin(lon - radians(zone * 6 - 183)) / sqrt(1 + t * t)) AS eta FROM q)
SELECT c_custkey, zone, round(500000 + {_R} * (eta + {_waves(geodesy.KRUEGER_TO, "cos", "xi", "sinh", "eta")}), 4) AS east,
 round({_R} * (xi + {_waves(geodesy.KRUEGER_TO, "sin", "xi", "cosh", "eta")}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 4) AS north, round(lat, 9) + 0.0 AS lat, round(lon, 9) + 0.0 AS lon FROM r""")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to their zone's metres, and back again: the SQL gives the places themselves."""
    key = F.col("c_custkey")
    points = load(spark, sf_dir, "customer").select("c_custkey", F.radians(key * 7.3 % 160 - 80).alias("lat"), F.radians(key * 13.7 % 360 - 180).alias("lon"))
    zoned = points.withColumn("zone", geodesy.utm_zone(F.col("lon")))
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    metres = zoned.withColumns({"east": east, "north": north})
    lat, lon = geodesy.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") >= 0)
    back = metres.select("c_custkey", "zone", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))
    return rounded(back, 9)
