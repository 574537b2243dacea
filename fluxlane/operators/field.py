"""The main field of the Earth from a table of spherical harmonic coefficients.

A model is a table (epoch, n, m, g, h), a row a term and epoch, degrees from 1 on,
in nT; a term that is absent is 0. Between epochs terms run linearly, after the
last one by ``g_dot`` and ``h_dot`` (nT a year) where the table has them, before
the first one they stand still. A model has as many rows as epochs times terms,
whatever the number of places, so it goes to every task.

The field is summed by Schmidt's quasi-normalised functions, degree by degree, from
the two degrees before, for all places of an Arrow batch at once; no row is moved.
(As column expressions, degree 13 outgrows what the JVM compiles.) Functions of
order 1 on are kept divided by the sine of the colatitude, so that the poles are
places like any other. ``gradient`` sums their derivatives beside them and is exact.

Angles are radians, altitudes metres above the ellipsoid; fields are in nT, north,
east and down of the geodetic frame. A null in a place's columns gives null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators.grid import is_missing

#: Fixed value: the sphere that coefficients refer to, in metres.
REFERENCE_RADIUS = 6_371_200.0
#: Altitude of maps that have none (negative throughout), in metres.
DEFAULT_ALTITUDE = 300.0


def terms(degree: int) -> list[tuple[int, int]]:
    """(n, m) of a model's terms, in order."""
    return [(n, m) for n in range(1, degree + 1) for m in range(n + 1)]


@dataclass(frozen=True)
class Terms:
    """A model's epochs, and by epoch and term the values of g and h and their changes a year until the next one."""

    degree: int
    epochs: np.ndarray
    values: np.ndarray
    rates: np.ndarray

    def at(self, date: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """g and h (terms x dates)."""
        epoch = np.clip(np.searchsorted(self.epochs, date, "right") - 1, 0, None)
        years = np.maximum(date - self.epochs[epoch], 0.0)
        g, h = self.values[:, epoch] + self.rates[:, epoch] * years[:, None]
        return g.T, h.T


def read_terms(model: DataFrame) -> Terms:
    """The whole model, a few thousand rows; rows of the same epoch and term add up."""
    kinds = dict(model.dtypes)
    value = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) if c in kinds else F.lit(0.0).alias(c)
    rows = model.groupBy("epoch", "n", "m").agg(*map(value, ("g", "h", "g_dot", "h_dot"))).toPandas()
    if rows.empty:
        raise ValueError("the model has no terms")
    epochs, degree = np.unique(rows["epoch"].to_numpy(float)), int(rows["n"].max())
    place = (rows["n"] * (rows["n"] + 1) // 2 - 1 + rows["m"]).to_numpy(int)
    values, rates = (np.zeros((2, len(epochs), degree * (degree + 3) // 2)) for _ in range(2))
    for k, c in enumerate("gh"):
        values[k, np.searchsorted(epochs, rows["epoch"]), place] = rows[c]
        rates[k, np.searchsorted(epochs, rows["epoch"]), place] = rows[f"{c}_dot"]
    if len(epochs) > 1:
        rates[:, :-1] = np.diff(values, axis=1) / np.diff(epochs)[:, None]
    return Terms(degree, epochs, values, rates)


@dataclass(frozen=True)
class Places:
    """Places in geodetic and geocentric terms."""

    lat: np.ndarray
    lon: np.ndarray
    alt: np.ndarray

    def __post_init__(self) -> None:
        e2 = geodesy.ECCENTRICITY**2
        w = 1 - e2 * np.sin(self.lat) ** 2
        across = geodesy.EARTH_RADIUS / np.sqrt(w)
        derived = {
            "meridian": geodesy.EARTH_RADIUS * (1 - e2) / (w * np.sqrt(w)),  # radius of curvature
            "axis": (across + self.alt) * np.cos(self.lat),  # distance from the axis
            "up": (across * (1 - e2) + self.alt) * np.sin(self.lat),  # and from the equator's plane
        }
        derived["radius"] = np.hypot(derived["axis"], derived["up"])
        for k, v in derived.items():
            object.__setattr__(self, k, v)


def sums(model: Terms, date: np.ndarray, at: Places, slopes: bool = False) -> dict[str, np.ndarray]:
    """The field up (r), south (t) and east (p) of the sphere; with ``slopes`` also their derivatives by radius (rr, tr, pr), colatitude and longitude."""
    g, h = model.at(date)
    c, s, q = at.up / at.radius, at.axis / at.radius, REFERENCE_RADIUS / at.radius
    out = {k: np.zeros(len(date)) for k in ("r", "t", "p", *((x + y for x in "rtp" for y in "rtp") if slopes else ()))}
    zero, one = np.zeros((1, len(date))), np.ones((1, len(date)))
    # functions a (of order 1 on over the sine), derivatives d of the functions themselves, e of d, b of a
    (a, d, e, b), (a0, d0, e0, b0) = (one, zero, zero, zero), (zero, zero, zero, zero)
    power = q * q
    for n in range(1, model.degree + 1):
        m = np.arange(n)[:, None]
        u, v = (2 * n - 1) / np.sqrt(n * n - m * m), np.sqrt(np.maximum((n - 1) ** 2 - m * m, 0)) / np.sqrt(n * n - m * m)
        before = lambda x, v=v, n=n: v * np.concatenate([x[:n], np.zeros((n - min(len(x), n), len(date)))])
        whole = np.where(m == 0, a, a * s)
        k = 1.0 if n == 1 else math.sqrt((2 * n - 1) / (2 * n))
        # the function of order n: k times the sine times that of order n - 1
        last, slope = whole[-1], d[-1]
        new_a = one[0] if n == 1 else k * s * a[-1]
        new_b = zero[0] if n == 1 else k * (c * a[-1] + s * b[-1])
        new = (
            np.vstack([u * c * a - before(a0), new_a]),
            np.vstack([u * (c * d - s * whole) - before(d0), k * (c * last + s * slope)]),
            np.vstack([u * (c * e - 2 * s * d - c * whole) - before(e0), k * (2 * c * slope - s * last + s * e[-1])]) if slopes else zero,
            np.vstack([u * (c * b - s * a) - before(b0), new_b]) if slopes else zero,
        )
        (a0, d0, e0, b0), (a, d, e, b) = (a, d, e, b), new
        power = power * q
        m = np.arange(n + 1)[:, None]
        first = n * (n + 1) // 2 - 1
        gn, hn, cos, sin = g[first : first + n + 1], h[first : first + n + 1], np.cos(m * at.lon), np.sin(m * at.lon)
        wave, turned, p = gn * cos + hn * sin, m * (hn * cos - gn * sin), np.where(m == 0, a, a * s)
        over = lambda x, y: power * np.einsum("ij,ij->j", x, y)  # noqa: E731, B023
        parts = {"r": (n + 1) * over(wave, p), "t": -over(wave, d), "p": -over(turned, a)}
        if slopes:
            parts |= {f"{x}r": parts[x] * -(n + 2) / at.radius for x in "rtp"}
            parts |= {"rt": (n + 1) * over(wave, d), "tt": -over(wave, e), "pt": -over(turned, b), "rp": (n + 1) * over(turned, p), "tp": -over(turned, d), "pp": over(m * m * wave, a)}
        for k, x in parts.items():
            out[k] += x
    return out


def vectors(model: Terms, date: np.ndarray, at: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """North, east and down."""
    f = sums(model, date, at)
    # from the geocentric frame to the geodetic one
    c, s = at.up / at.radius, at.axis / at.radius
    cd, sd = np.cos(at.lat) * s + np.sin(at.lat) * c, np.sin(at.lat) * s - np.cos(at.lat) * c
    return -f["t"] * cd - f["r"] * sd, f["p"], -f["r"] * cd + f["t"] * sd


def slopes_of_strength(model: Terms, date: np.ndarray, at: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the strength by latitude, longitude and altitude."""
    f = sums(model, date, at, True)
    strength = np.sqrt(f["r"] ** 2 + f["t"] ** 2 + f["p"] ** 2)
    by = {y: (f["r"] * f["r" + y] + f["t"] * f["t" + y] + f["p"] * f["p" + y]) / strength for y in "rtp"}
    # how radius and colatitude move with latitude and altitude
    bend = at.meridian + at.alt
    moves = (-bend * np.sin(at.lat), bend * np.cos(at.lat)), (np.cos(at.lat), np.sin(at.lat))
    lat, alt = (by["r"] * (at.axis * da + at.up * du) / at.radius + by["t"] * (at.up * da - at.axis * du) / at.radius**2 for da, du in moves)
    return lat, by["p"], alt


def _valued(places: DataFrame, model: DataFrame, of, date: Column, lat: Column, lon: Column, alt: Column, names: tuple[str, ...]) -> DataFrame:
    known = read_terms(model)

    @F.pandas_udf(", ".join(f"`{c}` double" for c in names))
    def run(date: pd.Series, lat: pd.Series, lon: pd.Series, alt: pd.Series) -> pd.DataFrame:
        # NaN, which null is here, comes out as NaN and is null again
        return pd.DataFrame(dict(zip(names, of(known, date.to_numpy(float), Places(*(x.to_numpy(float) for x in (lat, lon, alt)))), strict=True)))

    found = places.withColumn("_field", run(*(x.cast("double") for x in (date, lat, lon, alt))))
    return found.withColumns({c: F.col(f"_field.{c}") for c in names}).drop("_field")


def field(places: DataFrame, model: DataFrame, date: Column, lat: Column, lon: Column, alt: Column, names: tuple[str, str, str] = ("north", "east", "down")) -> DataFrame:
    """``places`` with the field's three components at a date (decimal year)."""
    return _valued(places, model, vectors, date, lat, lon, alt, names)


def intensity(places: DataFrame, model: DataFrame, date: Column, lat: Column, lon: Column, alt: Column, name: str = "intensity") -> DataFrame:
    """``places`` with the field's strength."""

    def strength(known: Terms, date: np.ndarray, at: Places) -> tuple[np.ndarray]:
        return (np.linalg.norm(vectors(known, date, at), axis=0),)

    return _valued(places, model, strength, date, lat, lon, alt, (name,))


def gradient(places: DataFrame, model: DataFrame, date: Column, lat: Column, lon: Column, alt: Column, names: tuple[str, str, str] = ("by_lat", "by_lon", "by_alt")) -> DataFrame:
    """``places`` with the slopes of the field's strength by latitude and longitude (nT a radian) and altitude (nT a metre)."""
    return _valued(places, model, slopes_of_strength, date, lat, lon, alt, names)


def flight_date(year: Column, day: Column, seconds: Column) -> Column:
    """Decimal year of a sample: its flight's year and day of the year, and seconds of that day."""
    start = geodesy.decimal_year(year, day - 1)
    return start + seconds / (86_400 * geodesy.days_in_year(start))


def flight_field(flight: DataFrame, model: DataFrame, frame: str = "body", unit: bool = False, names: tuple[str, str, str] = ("field_x", "field_y", "field_z")) -> DataFrame:
    """The field along a flight (year, doy, tt, lat, lon, alt): north, east, down, or in the body frame of roll, pitch and yaw; ``unit``: of length 1."""
    if frame not in ("body", "nav"):
        raise ValueError(f"frame {frame!r} is neither body nor nav")
    own = ("_north", "_east", "_down")
    at = field(flight, model, flight_date(F.col("year"), F.col("doy"), F.col("tt")), F.col("lat"), F.col("lon"), F.col("alt"), own)
    vector = [F.col(c) for c in own]
    if unit:
        size = F.sqrt(geodesy.dot(vector, vector))
        vector = [v / size for v in vector]
    if frame == "body":
        vector = geodesy.times(geodesy.nav_to_body(F.col("roll"), F.col("pitch"), F.col("yaw")), vector)
    return at.withColumns(dict(zip(names, vector, strict=True))).select(*flight.columns, *names)


def field_error(flight: DataFrame, model: DataFrame, known: str = "igrf") -> DataFrame:
    """One row: the RMS difference between the model's strength along a flight and its column ``known``."""
    at = intensity(flight, model, flight_date(F.col("year"), F.col("doy"), F.col("tt")), F.col("lat"), F.col("lon"), F.col("alt"), "_strength")
    return at.agg(F.sqrt(F.avg((F.col("_strength") - F.col(known)) ** 2)).alias("rms"))


def corrected_map(grid: DataFrame, model: DataFrame, subtract: float | None = None, add: float | None = None, units: str = "rad", zone: int = 18, north: bool = True) -> DataFrame:
    """A map less the field's strength at one date, plus that at another; cells without data stay as they are.

    ``units`` of xx and yy: rad, deg, or utm (metres of a zone). A map whose
    altitudes are all negative is taken to lie at ``DEFAULT_ALTITUDE``.
    """
    if subtract is None and add is None:
        return grid
    if units == "utm":
        lat, lon = geodesy.from_utm(F.col("xx"), F.col("yy"), F.lit(zone), F.lit(north))
    elif units in ("rad", "deg"):
        lat, lon = (F.radians(c) if units == "deg" else F.col(c) for c in ("yy", "xx"))
    else:
        raise ValueError(f"units {units!r} are neither rad, deg nor utm")
    high = grid.groupBy(F.col("map_name").alias("_map")).agg(F.max("alt").alias("_high"))
    at = grid.join(high, F.col("map_name").eqNullSafe(F.col("_map")))
    at = at.withColumns({"_own_lat": lat, "_own_lon": lon, "_own_alt": F.when(F.col("_high") < 0, DEFAULT_ALTITUDE).otherwise(F.col("alt"))})
    change = F.lit(0.0)
    for name, date, sign in (("_less", subtract, -1), ("_more", add, 1)):
        if date is not None:
            at = intensity(at, model, F.lit(float(date)), F.col("_own_lat"), F.col("_own_lon"), F.col("_own_alt"), name)
            change = change + sign * F.col(name)
    return at.withColumn("val", F.when(is_missing(F.col("val")), F.col("val")).otherwise(F.col("val") + change)).select(*grid.columns)
