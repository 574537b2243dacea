"""Queries on row selection and ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.operators import select, sequence
from fluxlane.plans.catalog import QUERIES, query
from fluxlane.plans.tables import ROWS_SQL, SIGNAL, SIGNAL_SQL, load, rounded, signal
from fluxlane.sources import flights as sources

_LOOKUP = [(i, line, start, end) for i, (line, start, end) in enumerate([(3, 0.0, 1.705e9), (3, 1.0e9, 1.72e9), (7, 1.704e9, 1.71e9), (11, 0.0, 4e9), (12, 5e9, 6e9), (999999, 0.0, 4e9)])]
_LOOKUP_SQL = "lk(i, line, t_start, t_end) AS (VALUES " + ", ".join(f"({i}, {n}, {a}::DOUBLE, {b}::DOUBLE)" for i, n, a, b in _LOOKUP) + ")"
_TYPES_SQL = "(SELECT *, CASE line % 3 WHEN 0 THEN 'Turn LEFT' WHEN 1 THEN 'flaps down' ELSE 'turn right' END AS event FROM sig)"


@query(f"""WITH {ROWS_SQL}, d AS (SELECT line, CASE WHEN n < 3 THEN 0 WHEN rn = 1 THEN lead(value) OVER o - value WHEN rn = n THEN value - lag(value) OVER o
  ELSE (lead(value) OVER o - lag(value) OVER o) / 2 END AS d FROM w WINDOW o AS (PARTITION BY line ORDER BY tt, event_id)),
 c AS (SELECT line, d - avg(d) OVER (PARTITION BY line) AS d FROM d)
SELECT line, count(*) AS n, round(sqrt(avg(d * d)), 6) + 0.0 AS rms FROM c GROUP BY line""")
def flagship_signal_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = signal(spark, sf_dir).select("line", sequence.difference(F.col("value"), SIGNAL).alias("d"))
    c = sequence.without_mean(d, F.col("d"), ("line",), "d")
    return rounded(c.groupBy("line").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms")))


@query(f"WITH {SIGNAL_SQL} SELECT event_id, line, value FROM sig WHERE line IN (1, 2, 3, 5, 8) AND tt BETWEEN 1704067200 AND 1710000000 AND value > 10")
def select_lines_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_rows(signal(spark, sf_dir), (1, 2, 3, 5, 8), (1704067200, 1710000000), F.col("value") > 10).select("event_id", "line", "value")


@query(f"WITH {SIGNAL_SQL} SELECT event_id, line, value FROM sig WHERE tt <= 1706000000")
def select_upper_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_rows(signal(spark, sf_dir), None, (1706000000,)).select("event_id", "line", "value")


@query(f"""WITH {SIGNAL_SQL}, {_LOOKUP_SQL}, b AS (SELECT line, arg_min(t_start, i) AS a, arg_max(t_end, i) AS z FROM lk GROUP BY line)
SELECT event_id, sig.line, value FROM sig JOIN b ON sig.line = b.line AND tt BETWEEN a AND z""")
def select_line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = spark.createDataFrame(_LOOKUP, "i int, line long, t_start double, t_end double")
    return select.select_by_lookup(signal(spark, sf_dir), lookup, (3, 7, 11, 12, 999999), "i").select("event_id", "line", "value")


@query(f"WITH {ROWS_SQL} SELECT event_id, CAST(CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) THEN 1 ELSE 2 END AS INTEGER) AS split FROM w")
def split2_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.split_rows(signal(spark, sf_dir), SIGNAL, (0.7, 0.3)).select("event_id", "split")


@query(f"WITH {ROWS_SQL} SELECT event_id, CAST(CASE WHEN rn <= round_even(n * 0.5::DOUBLE, 0) THEN 1 WHEN rn <= round_even(n * 0.75::DOUBLE, 0) THEN 2 ELSE 3 END AS INTEGER) AS split FROM w")
def split3_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.split_rows(signal(spark, sf_dir), SIGNAL, (0.5, 0.25, 0.25)).select("event_id", "split")


@query(f"WITH {ROWS_SQL} SELECT event_id, line FROM w WHERE rn <= n - n % 5")
def trim_tail_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.trim_tail(signal(spark, sf_dir), SIGNAL, 5).select("event_id", "line")


@query(f"""WITH {ROWS_SQL} SELECT event_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) - 3 THEN 'train' WHEN rn > floor(n * 0.8::DOUBLE) AND rn <= n - 3 THEN 'validation' END AS part FROM w""")
def split_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.train_parts(signal(spark, sf_dir), SIGNAL, 0.8, 4, "sliding").select("event_id", "part")


@query(f"""WITH {ROWS_SQL} SELECT event_id, CASE WHEN rn % 4 = 1 AND floor((rn - 1) / 4) < floor(n / 4) THEN CASE WHEN floor((rn - 1) / 4) < floor(floor(n / 4) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END END AS part FROM w""")
def split_contiguous_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.train_parts(signal(spark, sf_dir), SIGNAL, 0.8, 4, "contiguous").select("event_id", "part")


@query(f"WITH {SIGNAL_SQL} SELECT event_id, tt, event FROM {_TYPES_SQL} WHERE event_type = 'click' AND contains(lower(event), 'turn') AND tt BETWEEN 1704067200 AND 1706000000")
def filter_events_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("line") % 3 == 0, "Turn LEFT").when(F.col("line") % 3 == 1, "flaps down").otherwise("turn right")
    events = signal(spark, sf_dir).withColumn("event", text)
    return select.filter_events(events, "click", "turn", (1704067200, 1706000000), flight_column="event_type").select("event_id", "tt", "event")


@query(f"WITH {SIGNAL_SQL} SELECT min(tt) AS t_min, max(tt) AS t_max FROM sig WHERE line = 4")
def field_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.field_extrema(signal(spark, sf_dir), "line", 4)


@query(f"WITH {ROWS_SQL} SELECT event_id FROM w WHERE (rn - 1) % CAST(ceil(n / 20) AS BIGINT) = 0")
def downsample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.downsample(signal(spark, sf_dir), SIGNAL, 20).select("event_id")


@query("WITH s AS (SELECT avg(l_extendedprice - 1000 * l_quantity) AS m, stddev_samp(l_extendedprice - 1000 * l_quantity) AS s FROM lineitem) SELECT abs(l_extendedprice - 1000 * l_quantity - m) <= s AS easy, count(*) AS n FROM lineitem, s GROUP BY 1")
def curriculum_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("diff"))
    return select.within_sigma(rows, "diff").groupBy("easy").agg(F.count("*").alias("n"))


_LAG = "lag(value) OVER o"
_LEAD = "lead(value) OVER o"
_CASES = {
    "backward": f"CASE WHEN rn = 1 THEN {_LEAD} - value ELSE value - {_LAG} END",
    "forward": f"CASE WHEN rn = n THEN value - {_LAG} ELSE {_LEAD} - value END",
    "central": f"CASE WHEN rn = 1 THEN {_LEAD} - value WHEN rn = n THEN value - {_LAG} ELSE ({_LEAD} - {_LAG}) / 2 END",
    "backward2": f"CASE WHEN rn <= 2 THEN {_LEAD} - value ELSE (3 * value - 4 * {_LAG} + lag(value, 2) OVER o) / 2 END",
    "forward2": f"CASE WHEN rn >= n - 1 THEN value - {_LAG} ELSE (4 * {_LEAD} - lead(value, 2) OVER o - 3 * value) / 2 END",
    "fourth": f"CASE WHEN rn <= 2 OR rn >= n - 1 THEN 0 ELSE (lag(value, 2) OVER o - 4 * {_LAG} + 6 * value - 4 * {_LEAD} + lead(value, 2) OVER o) / 16 END",
}


def _difference(scheme: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(signal(spark, sf_dir).select("event_id", sequence.difference(F.col("value"), SIGNAL, scheme).alias("d")))

    return run


for _scheme, _least in sequence.SCHEMES.items():
    query(f"WITH {ROWS_SQL} SELECT event_id, round(CASE WHEN n < {_least} THEN 0 ELSE {_CASES[_scheme]} END, 6) + 0.0 AS d FROM w WINDOW o AS (PARTITION BY line ORDER BY tt, event_id)", f"fdm_{_scheme}")(_difference(_scheme))
assert "fdm_central" in QUERIES


@query(f"WITH {ROWS_SQL} SELECT event_id, " + ", ".join(f"CASE WHEN rn <= {k} THEN value ELSE lag(value, {k}) OVER o END AS lag_{k}" for k in (1, 2, 3)) + " FROM w WINDOW o AS (PARTITION BY line ORDER BY tt, event_id)")
def lag_1_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("event_id", *[sequence.lagged(F.col("value"), SIGNAL, k).alias(f"lag_{k}") for k in (1, 2, 3)])


@query(f"WITH {ROWS_SQL} SELECT line, CAST(floor((rn - 1) / 6) AS BIGINT) AS chunk, round(first(value ORDER BY rn), 6) AS head, round(last(value ORDER BY rn), 6) AS tail, round(sum(value), 4) AS total FROM w GROUP BY ALL HAVING count(*) = 6")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sequence.chunks(signal(spark, sf_dir), SIGNAL, ["value"], 6)
    total = F.round(F.aggregate("value", F.lit(0.0), lambda a, b: a + b), 4)
    return c.select("line", "chunk", F.element_at("value", 1).alias("head"), F.element_at("value", -1).alias("tail"), total.alias("total"))


@query(f"""WITH {ROWS_SQL} SELECT event_id, round(sum(value) OVER o + greatest(0, 5 - rn) * first_value(value) OVER (PARTITION BY line ORDER BY tt, event_id), 4) + 0.0 AS total, 5 AS size
FROM w WINDOW o AS (PARTITION BY line ORDER BY tt, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def temporal_window_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).select("event_id", sequence.trailing(F.col("value"), SIGNAL, 5).alias("held"))
    return rows.select("event_id", (F.round(F.aggregate("held", F.lit(0.0), lambda a, b: a + b), 4) + F.lit(0.0)).alias("total"), F.size("held").alias("size"))


@query(f"""WITH {ROWS_SQL}, c AS (SELECT event_id, rn, value + 1 AS wt, sum(value + 1) OVER (PARTITION BY line ORDER BY tt, event_id) AS up, sum(value + 1) OVER (PARTITION BY line) AS tot, n FROM w)
SELECT event_id, CAST(greatest(0, ceil(round(up / tot * n, 9) - 0.37)) - greatest(0, ceil(round((up - wt) / tot * n, 9) - 0.37)) AS BIGINT) AS copies FROM c""")
def cumulative_weight_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).withColumn("weight", F.col("value") + 1)
    return sequence.systematic_resample(rows, SIGNAL, "weight", 0.37).select("event_id", "copies")


@query(f"WITH {SIGNAL_SQL} SELECT event_id, round(value - avg(value) OVER (PARTITION BY line) + 3e-9, 6) + 0.0 AS d FROM sig")
def detrend_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.without_mean(signal(spark, sf_dir), F.col("value"), ("line",), "d").select("event_id", (F.col("d") + 3e-9).alias("d")))  # off the ties of rounding


@query(f"""WITH {ROWS_SQL}, f AS (SELECT line, coalesce(CASE WHEN var_pop(rn) > 0 THEN covar_pop(value, rn) / var_pop(rn) END, 0) AS b, avg(value) AS my, avg(rn) AS mx FROM w GROUP BY line)
SELECT event_id, round(value - my - b * (rn - mx), 5) + 0.0 AS d FROM w JOIN f USING (line)""")
def detrend_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.without_trend(signal(spark, sf_dir), SIGNAL, "value", "d").select("event_id", "d"), 5)


@query(f"""WITH {ROWS_SQL}, d AS (SELECT line, rn, n, value - avg(value) OVER (PARTITION BY line) AS d FROM w),
p AS (SELECT a.line, b.rn - a.rn AS lag, sum(a.d * b.d) AS c FROM d a JOIN d b ON a.line = b.line AND b.rn - a.rn BETWEEN 0 AND 8 GROUP BY 1, 2)
SELECT p.line, CAST(p.lag AS INTEGER) AS lag, round(CASE WHEN z.c <> 0 THEN p.c / z.c END, 6) + 0.0 AS acf FROM p JOIN p z ON p.line = z.line AND z.lag = 0""")
def autocorr_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.autocorrelation(signal(spark, sf_dir), SIGNAL, "value", 8))


@query(f"""WITH {ROWS_SQL}, o AS (SELECT line, max(CASE WHEN rn = 5 THEN 0.5 * value - value END) AS off FROM w GROUP BY line)
SELECT event_id, round(CASE WHEN rn <= 5 THEN 0.5 * value ELSE value + coalesce(off, 0) END, 6) + 0.0 AS lat, round(CASE WHEN rn <= 5 THEN 0.25 * value ELSE value + coalesce(off * 1.5, 0) END, 6) + 0.0 AS lon FROM w JOIN o USING (line)""")
def ins_zeroing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = signal(spark, sf_dir).select("line", "tt", "event_id", v.alias("lat"), v.alias("lon"), (0.5 * v).alias("t_lat"), (0.25 * v).alias("t_lon"))
    return rounded(sequence.pin_start(rows, SIGNAL, "lat", "lon", "t_lat", "t_lon", 5).select("event_id", "lat", "lon"))


@query()
def filtfilt_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bandpass(signal(spark, sf_dir).select("line", "tt", "event_id", "value"), SIGNAL, ["value"])


@query(f"""WITH {ROWS_SQL}, size AS (SELECT line, least(64, max(n)) AS m, max(n) AS n FROM w GROUP BY line),
starts AS (SELECT line, m, unnest(range(0, n - m + 1, greatest(1, m // 2))) AS s FROM size),
part AS (SELECT st.line, st.m, s, rn - 1 - s AS k, value * CASE WHEN st.m > 1 THEN 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (rn - 1 - s) / (st.m - 1)) ELSE 1 END AS x FROM starts st JOIN w ON w.line = st.line AND rn - 1 >= s AND rn - 1 < s + st.m),
bins AS (SELECT line, m, s, k, x, unnest(range(m // 2 + 1)) AS j FROM part),
spectrum AS (SELECT line, m, s, j, pow(sum(x * cos(2 * pi() * j * k / m)), 2) + pow(sum(x * sin(2 * pi() * j * k / m)), 2) AS p FROM bins GROUP BY ALL),
energy AS (SELECT m, sum(pow(CASE WHEN m > 1 THEN 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / (m - 1)) ELSE 1 END, 2)) AS e FROM (SELECT m, unnest(range(m)) AS k FROM (SELECT DISTINCT m FROM size)) GROUP BY m)
SELECT line, round(j * 10.0 / m, 6) AS frequency, round(avg(p) / (10.0 * any_value(e)) * CASE WHEN j >= 1 AND j < (m + 1) // 2 THEN 2 ELSE 1 END, 4) + 0.0 AS power
FROM spectrum JOIN energy USING (m) GROUP BY line, j, m""")
def power_spectral_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.power_spectrum(signal(spark, sf_dir), SIGNAL, "value", 10.0, 64)
    return rounded(found.select("line", F.round("frequency", 6).alias("frequency"), F.round("power", 4).alias("power")))


@query(f"""WITH RECURSIVE {ROWS_SQL}, g AS (SELECT line, rn, event_id, 3.0 * (value / 100 - 1) AS x FROM w WHERE rn = 1
 UNION ALL SELECT w.line, w.rn, w.event_id, exp(-0.1 / 60) * g.x + sqrt(2 * 9.0 / 60 * 0.1) * (w.value / 100 - 1) FROM g JOIN w ON w.line = g.line AND w.rn = g.rn + 1)
SELECT event_id, round(x, 6) + 0.0 AS fogm FROM g""")
def gauss_markov_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).select("line", "tt", "event_id", (F.col("value") / 100 - 1).alias("noise"))
    return rounded(sequence.gauss_markov(rows, SIGNAL, "noise", 3.0, 60.0, 0.1).select("event_id", "fogm"))


@query("""WITH f AS (SELECT n_regionkey AS flight, n_name AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT s_suppkey AS line, s_nationkey % 7 AS flight, file FROM supplier LEFT JOIN f ON f.flight = s_nationkey % 7 AND k = 1""")
def lines_with_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (suppliers) with the first file of their flight (nations of a region), if it has one."""
    lines = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line"), (F.col("s_nationkey") % 7).alias("flight"))
    flights = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("flight"), F.col("n_nationkey").alias("row"), F.col("n_name").alias("file"))
    return select.with_first_match(lines, flights, "flight", "row")


@query(f"""WITH {SIGNAL_SQL}, fast AS (SELECT line, value, row_number() OVER (PARTITION BY line ORDER BY tt, event_id) AS k FROM sig),
slow AS (SELECT line, event_id, row_number() OVER (PARTITION BY line ORDER BY tt, event_id) AS k FROM sig WHERE event_type = 'click')
SELECT s.line, event_id, f.value AS fast_value FROM slow s LEFT JOIN fast f ON f.line = s.line AND f.k = (s.k - 1) * 4 + 1""")
def overlay_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's clicks beside every fourth sample of all its events."""
    rows = signal(spark, sf_dir)
    fast = rows.withColumnRenamed("value", "fast_value")
    return select.overlay(rows.filter("event_type = 'click'").select("line", "tt", "event_id"), fast, SIGNAL, 4, ["fast_value"]).select("line", "event_id", "fast_value")


_RATE = "(CASE WHEN n < 3 THEN 0 WHEN rn = 1 THEN lead({0}) OVER o - {0} WHEN rn = n THEN {0} - lag({0}) OVER o ELSE (lead({0}) OVER o - lag({0}) OVER o) / 2 END / 0.5)"


@query(f"""WITH {ROWS_SQL}, m AS (SELECT line, event_id, rn, n, value % 50 AS vn, 70 + value % 7 AS ve, value % 3 - 1 AS vd, value * 3 AS fx, 200 + value AS fy, -300.0::DOUBLE AS fz FROM w),
d AS (SELECT *, {_RATE.format("vn")} AS dn, {_RATE.format("ve")} AS de, {_RATE.format("vd")} AS dd FROM m WINDOW o AS (PARTITION BY line ORDER BY rn)),
a AS (SELECT *, CASE WHEN line % 4 = 1 THEN 0 ELSE 0.1 END AS r, CASE WHEN line % 4 = 1 THEN radians(2) ELSE -0.2 END AS p, CASE WHEN line % 4 = 1 THEN atan2(ve, vn) ELSE 1.5 END AS y FROM d)
SELECT event_id, round((rn - 1) * 0.5, 6) + 0.0 AS tt, round(CASE WHEN line % 3 = 0 THEN dn ELSE 1 END, 6) + 0.0 AS fn, round(CASE WHEN line % 3 = 0 THEN de ELSE 0.5 END, 6) + 0.0 AS fe, round(CASE WHEN line % 3 = 0 THEN dd - 9.80665 ELSE -9.5 END, 6) + 0.0 AS fd,
 round(cos(p) * cos(y), 6) + 0.0 AS c11, round(cos(r) * cos(y) + sin(r) * sin(p) * sin(y), 6) + 0.0 AS c22, round(sin(r) * cos(p), 6) + 0.0 AS c32, round(CASE WHEN line % 2 = 0 THEN sqrt(fx * fx + fy * fy + fz * fz) ELSE 7 END, 6) + 0.0 AS total FROM a""")
def flight_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flights without times: forces lack a value in every third line, attitudes in every fourth, totals in every second."""
    rn = F.row_number().over(SIGNAL.window)
    rows = signal(spark, sf_dir).withColumn("rn", rn)
    gap = lambda when, value: F.when(when & (F.col("rn") == 1), None).otherwise(F.lit(value))
    third, fourth, second = F.col("line") % 3 == 0, F.col("line") % 4 == 1, F.col("line") % 2 == 0
    flights = rows.select(
        "line", "rn", "event_id", F.lit(0.1).alias("lat"), F.lit(0.2).alias("lon"), F.lit(300.0).alias("alt"), (F.col("value") % 50).alias("vn"), (70 + F.col("value") % 7).alias("ve"), (F.col("value") % 3 - 1).alias("vd"),
        gap(third, 1.0).alias("fn"), F.lit(0.5).alias("fe"), F.lit(-9.5).alias("fd"), gap(fourth, 0.1).alias("roll"), F.lit(-0.2).alias("pitch"), F.lit(1.5).alias("yaw"),
        (F.col("value") * 3).alias("fx"), (200 + F.col("value")).alias("fy"), F.lit(-300.0).alias("fz"), gap(second, 7.0).alias("total"),
    )
    order = select.Order(("line",), ("rn",))
    out = sources.with_total(sources.with_motion(flights, order, 0.5), order, "fx", "fy", "fz", "total")
    return rounded(out.select("event_id", "tt", "fn", "fe", "fd", F.col("cnb")[0].alias("c11"), F.col("cnb")[4].alias("c22"), F.col("cnb")[7].alias("c32"), "total"))
