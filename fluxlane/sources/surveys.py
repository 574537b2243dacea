"""Survey flights by name: which fields a flight has, where its file is, and what is derived from it.

Lookup tables (lines, flights, maps) are those of ``read_lookup_csv``; they have a
row a line, flight or map. Flights are read as Parquet or CSV with a header.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators import compensation, features, grid, select, spline
from fluxlane.operators.select import Order
from fluxlane.operators.sequence import difference
from fluxlane.sources import flights, tables

_FLUX = [f"flux_{s}_{k}" for s in "abcd" for k in "xyzt"]
_BEFORE = ["tt", "flight", "line", "year", "doy", "utm_x", "utm_y", "utm_z", "msl", "lat", "lon", "baro", "diurnal", "mag_1_c"]
_INS = ["ins_lat", "ins_lon", "ins_alt", "ins_vn", "ins_vw", "ins_vu", "ins_wander", "ins_roll", "ins_pitch", "ins_yaw", "ins_acc_x", "ins_acc_y", "ins_acc_z"]
#: The fields of the survey of 2020, of its 160 Hz record, and of the survey of 2021.
FIELDS_2020 = [
    *_BEFORE, "mag_1_lag", "mag_1_dc", "mag_1_igrf", *[f"mag_{n}_uc" for n in range(1, 7)], *_FLUX, "ogs_mag", "ogs_alt", *_INS, "roll_rate", "pitch_rate", "yaw_rate", "lgtl_acc", "ltrl_acc", "nrml_acc", "pitot_p", "static_p", "total_p",
    *[f"cur_{n}" for n in ("com_1", "ac_hi", "ac_lo", "tank", "flap", "strb", "srvo_o", "srvo_m", "srvo_i", "heat", "acpwr", "outpwr", "bat_1", "bat_2")],
    *[f"vol_{n}" for n in ("acpwr", "outpwr", "bat_1", "bat_2", "res_p", "res_n", "back_p", "back_n", "gyro_1", "gyro_2", "acc_p", "acc_n", "block", "back", "srvo", "cabt", "fan")],
]
FIELDS_160 = ["tt", *[f"mag_{n}_uc" for n in range(1, 7)], *_FLUX]
FIELDS_2021 = [*_BEFORE, "mag_1_dc", "mag_1_igrf", *[f"mag_{n}_uc" for n in range(1, 6)], *_FLUX, *_INS, *[f"cur_{n}" for n in ("com_1", "ac_hi", "ac_lo", "tank", "flap", "strb")], *[f"vol_{n}" for n in ("block", "back", "cabt", "fan")]]
#: Flights of each survey, and fields that some of them lack.
FLIGHTS_2020 = [f"Flt{n}" for n in (1001, 1002, 1003, 1004, 1005, 1006, 1007, 1008, 1009)] + ["Flt1004_1005"]
FLIGHTS_2021 = [f"Flt{n}" for n in (2001, 2002, 2004, 2005, 2006, 2007, 2008, 2015, 2016, 2017)] + ["Flt2001_2017"]
FLIGHTS_160 = ["Flt1001_160Hz", "Flt1002_160Hz"]
NO_FLUX_A = ("Flt1001", "Flt1002", *FLIGHTS_160)
WITH_MAG_6 = ("Flt1008", "Flt1009")
SETS = {"fields20": FIELDS_2020, "fields21": FIELDS_2021, "fields160": FIELDS_160}
#: Fields of flights that have a trajectory, an inertial record and sensors only.
_PLAIN = ["tt", "lat", "lon", "alt", "ins_lat", "ins_lon", "ins_alt", "flux_a_x", "flux_a_y", "flux_a_z", "flux_a_t", "flight", "line", "year", "doy", "diurnal", "igrf", "mag_1_c", "mag_1_uc"]
FIELDS_0 = _PLAIN
FIELDS_1 = [*_PLAIN, "mag_2_c", "mag_3_c", "mag_2_uc", "mag_3_uc", "flux_b_x", "flux_b_y", "flux_b_z", "flux_b_t", "aux_1", "aux_2", "aux_3"]
BY_FLIGHT = Order(("flight",), ("tt",))


def fields_of(flight: str) -> list[str]:
    """The fields of a flight, or of a set of fields."""
    if flight in SETS:
        return list(SETS[flight])
    if flight in FLIGHTS_2021:
        return list(FIELDS_2021)
    if flight not in FLIGHTS_2020 and flight not in FLIGHTS_160:
        raise ValueError(f"unknown flight {flight}")
    without = set() if flight in WITH_MAG_6 else {"mag_6_uc"}
    if flight in NO_FLUX_A:
        without |= {f for f in _FLUX if f.startswith("flux_a")}
    return [f for f in (FIELDS_160 if flight in FLIGHTS_160 else FIELDS_2020) if f not in without]


def derived(df: DataFrame, order: Order = BY_FLIGHT) -> DataFrame:
    """A flight of the surveys of 2020 or 2021 with what its raw fields give.

    Angles become radians; igrf is what was taken off the first sensor; velocities
    and forces are differences of the UTM place; the inertial record's velocities
    point north, east and down, and its forces are turned by the wander angle. alt
    is the ellipsoid's. The step is that between a sequence's first two samples.
    """
    angles = [c for c in ("lat", "lon", "ins_roll", "ins_pitch", "ins_yaw", "roll_rate", "pitch_rate", "yaw_rate") if c in df.columns]
    first = lambda n: F.max(F.when(F.col("_rn") == n, F.col("tt"))).over(order.whole)
    out = df.withColumns({c: F.radians(c) for c in angles}).withColumn("_rn", F.row_number().over(order.window))
    out = out.withColumn("_dt", F.coalesce(F.round(first(2) - first(1), 9), F.lit(0.1)))
    rate = lambda c: difference(F.col(c), order) / F.col("_dt")
    out = out.withColumns({"igrf": F.col("mag_1_dc") - F.col("mag_1_igrf"), "alt": F.col("utm_z"), "vn": rate("utm_y"), "ve": rate("utm_x"), "vd": -rate("utm_z")})
    out = out.withColumns({"fn": rate("vn"), "fe": rate("ve"), "fd": rate("vd") - geodesy.GRAVITY})
    cnb = geodesy.body_to_nav(F.col("ins_roll"), F.col("ins_pitch"), F.col("ins_yaw"))
    x, y, z, turn = F.col("ins_acc_x"), -F.col("ins_acc_y"), -F.col("ins_acc_z"), -F.col("ins_wander")
    ins = {"ins_ve": -F.col("ins_vw"), "ins_vd": -F.col("ins_vu"), "ins_fn": F.cos(turn) * x - F.sin(turn) * y, "ins_fe": F.sin(turn) * x + F.cos(turn) * y, "ins_fd": z}
    return out.withColumns(ins | {"ins_cnb": F.flatten(F.array(*[F.array(*row) for row in cnb]))}).drop("_rn", "_dt")


def _raw(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """A file's fields as numbers, but for the flight's name; absent ones are NaN."""
    raw = spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    cell = lambda f: F.lit(float("nan")) if f not in raw.columns else F.col(f).cast("string" if f == "flight" else "double")
    return raw.select(*[cell(f).alias(f) for f in fields])


def with_fast_record(slow: DataFrame, fast: DataFrame, order: Order = BY_FLIGHT, every: int = 1) -> DataFrame:
    """A flight whose uncompensated sensors come from its 160 Hz record, position by position."""
    columns = [c for c in FIELDS_160 if c not in order.along and c in fast.columns]
    return select.overlay(slow.drop(*columns), fast, order, every, columns)


def read_flight(spark: SparkSession, flight: str, lookup: DataFrame) -> DataFrame:
    """The flight that the lookup (flight, xyz_type, xyz_file and row, for its order) names, first match, with what is derived; column flight is its name."""
    found = lookup.filter(F.col("flight") == flight).orderBy("row").select("xyz_type", "xyz_file").first()
    if found is None:
        raise ValueError(f"the lookup has no flight {flight}")
    kind, path = found
    known = {"XYZ0": FIELDS_0, "XYZ1": FIELDS_1, "XYZ20": FIELDS_2020, "XYZ21": FIELDS_2021}
    if kind not in known:
        raise ValueError(f"unknown kind of flight {kind}")
    raw = _raw(spark, path, [*known[kind], *(["aux_1", "aux_2", "aux_3"] if kind in ("XYZ20", "XYZ21") else [])]).withColumn("flight", F.lit(flight))
    if kind in ("XYZ20", "XYZ21"):
        return derived(raw)
    angles = {c: F.radians(c) for c in ("lat", "lon", "ins_lat", "ins_lon")}
    out = flights.with_total(raw.withColumns(angles), BY_FLIGHT, "flux_a_x", "flux_a_y", "flux_a_z", "flux_a_t")
    if kind == "XYZ1":
        out = flights.with_total(out, BY_FLIGHT, "flux_b_x", "flux_b_y", "flux_b_z", "flux_b_t")
    return flights.with_motion(flights.with_motion(out, BY_FLIGHT), BY_FLIGHT, prefix="ins_")


def read_lines(spark: SparkSession, lines: Sequence[float], line_table: DataFrame, flight_table: DataFrame, map_table: DataFrame | None = None) -> DataFrame:
    """All samples of lines, each from its own flight and within its own times; with ``map_table``, map_val is the line's map there.

    ``line_table``: flight, line, t_start, t_end and, for maps, map_name;
    ``map_table``: map_name, map_file (Parquet). Flights must be of one xyz_set. A
    line twice in ``lines`` is an error; lines that the table lacks are skipped.
    """
    wanted = line_table.filter(F.col("line").isin(*lines))
    flown = wanted.select("flight").distinct().join(flight_table, "flight")
    sets = [r[0] for r in flown.select("xyz_set").distinct().collect()]  # a row a set
    if len(sets) > 1:
        raise ValueError(f"flights of several sets: {sorted(sets)}")
    names = sorted(r[0] for r in wanted.select("flight").distinct().collect())  # a row a flight
    out = None
    for name in names:
        rows = select.select_by_lookup(read_flight(spark, name, flight_table), wanted.filter(F.col("flight") == name), lines, "row")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the lines is in the table")
    if map_table is None:
        return out
    of = wanted.groupBy("line").agg(F.min_by("map_name", "row").alias("map_name"))
    maps = {r.map_name: r.map_file for r in map_table.join(of.select("map_name").distinct(), "map_name").select("map_name", "map_file").collect()}  # a row a map
    placed, valued = out.join(F.broadcast(of), "line", "left"), None  # a row a line asked for
    for name, path in sorted(maps.items()):
        cells = tables.read_grid(spark, path, name)
        part = spline.interpolated(placed.filter(F.col("map_name") == name), cells, grid.axes(cells))
        valued = part if valued is None else valued.unionByName(part)
    rest = placed.filter(F.col("map_name").isNull() | ~F.col("map_name").isin(*maps) if maps else F.lit(True)).withColumn("map_val", F.lit(None).cast("double"))
    return rest if valued is None else valued.unionByName(rest)


BY_LINE = Order(("line",), ("tt",))


def with_target(df: DataFrame, kind: str, sensor: str, diurnal: bool = False, igrf: bool = False, name: str = "y") -> DataFrame:
    """``df`` with the target of a kind (see ``features.target``): the truth is the map for b and c, else the clean sensor mag_1_c."""
    truth = F.col("map_val" if kind in ("b", "c") else "mag_1_c")
    taken = [F.col(c) for c, on in (("diurnal", diurnal), ("igrf", igrf)) if on]
    return df.withColumn(name, features.target(kind, F.col(sensor), truth, taken))


@dataclass(frozen=True)
class Lookups:
    """The tables that lines, flights and maps are found by."""

    lines: DataFrame
    flights: DataFrame
    maps: DataFrame | None = None

    def rows(self, spark: SparkSession, lines: Sequence[float], kind: str, sensor: str, p: compensation.Params, diurnal: bool = False, igrf: bool = False) -> DataFrame:
        """Samples of the lines with the target as column ``p.y``."""
        return with_target(read_lines(spark, lines, self.lines, self.flights, self.maps if kind in ("b", "c") or p.kind == "map_TL" else None), kind, sensor, diurnal, igrf, p.y)


def train_on_lines(spark: SparkSession, lines: Sequence[float], lookups: Lookups, kind: str, sensor: str, p: compensation.Params) -> dict:
    """A compensation model of the lines."""
    return compensation.train(lookups.rows(spark, lines, kind, sensor, p), BY_LINE, p)


def error_on_lines(spark: SparkSession, lines: Sequence[float], lookups: Lookups, kind: str, sensor: str, p: compensation.Params, model: dict) -> tuple[DataFrame, float]:
    """The lines' samples with y_hat, and the deviation of the errors less each line's mean."""
    predicted = compensation.predict(lookups.rows(spark, lines, kind, sensor, p), BY_LINE, p, model)
    return predicted, compensation.error(predicted, BY_LINE.by)


def train_and_test_on_lines(spark: SparkSession, train: Sequence[float], test: Sequence[float], lookups: Lookups, kind: str, sensor: str, p: compensation.Params) -> tuple[dict, float, float]:
    """A model of some lines, and its errors on them and on others."""
    model = train_on_lines(spark, train, lookups, kind, sensor, p)
    return model, error_on_lines(spark, train, lookups, kind, sensor, p, model)[1], error_on_lines(spark, test, lookups, kind, sensor, p, model)[1]
