"""The main field against an integral form of its functions, differences, and the definition of maps' correction."""

import math

import numpy as np
import pytest
from fluxlane.functions import geodesy
from fluxlane.operators import field
from pyspark.sql import functions as F

ECC = geodesy.ECCENTRICITY


def schmidt(n, m, theta):
    """Schmidt's quasi-normalised function from the sum of powers of the cosine."""
    x, s = math.cos(theta), math.sin(theta)
    total = 0.0
    for k in range((n - m) // 2 + 1):
        total += (-1) ** k * math.factorial(2 * n - 2 * k) / (math.factorial(k) * math.factorial(n - k) * math.factorial(n - m - 2 * k)) * x ** (n - m - 2 * k)
    return math.sqrt((2 if m else 1) * math.factorial(n - m) / math.factorial(n + m)) * s**m * total / 2**n


def potential(terms, r, theta, lon):
    a = field.REFERENCE_RADIUS
    return a * sum((a / r) ** (n + 1) * (g * math.cos(m * lon) + h * math.sin(m * lon)) * schmidt(n, m, theta) for (n, m), (g, h) in terms.items())


def by_hand(terms, lat, lon, alt):
    """North, east and down as slopes of the potential, by differences in the geodetic frame."""

    def at(north, east, down):
        big_n = geodesy.EARTH_RADIUS / math.sqrt(1 - ECC**2 * math.sin(lat) ** 2)
        p = np.array([(big_n + alt) * math.cos(lat) * math.cos(lon), (big_n + alt) * math.cos(lat) * math.sin(lon), (big_n * (1 - ECC**2) + alt) * math.sin(lat)])
        n = np.array([-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)])
        e = np.array([-math.sin(lon), math.cos(lon), 0.0])
        d = -np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
        x, y, z = p + north * n + east * e + down * d
        return potential(terms, math.sqrt(x * x + y * y + z * z), math.atan2(math.hypot(x, y), z), math.atan2(y, x))

    step = 20.0
    return [-(at(*(step * u for u in unit)) - at(*(-step * u for u in unit))) / (2 * step) for unit in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]


@pytest.fixture(scope="module")
def terms():
    rng = np.random.default_rng(13)
    found = {(n, m): (float(rng.normal() * 3000 / n**2), float(rng.normal() * 3000 / n**2) if m else 0.0) for n, m in field.terms(6)}
    return found | {(1, 0): (-29000.0, 0.0)}


def model(spark, terms, epoch=2020.0, rate=0.0):
    rows = [(epoch, n, m, g, h, rate * n, rate * m, "x") for (n, m), (g, h) in terms.items()]
    return spark.createDataFrame(rows, "epoch double, n int, m int, g double, h double, g_dot double, h_dot double, _a string")


PLACES = [(0, 0.7, -1.3, 300.0), (1, -1.2, 2.9, 0.0), (2, 0.0, 0.0, 10_000.0), (3, math.pi / 2, 0.4, 500.0), (4, -math.pi / 2, 0.0, 500.0), (5, 1.1, -3.1, -50.0)]


def places(spark):
    return spark.createDataFrame([(*p, "x") for p in PLACES], "id long, lat double, lon double, alt double, north string").drop("north")


def at():
    return F.lit(2020.0), F.col("lat"), F.col("lon"), F.col("alt")


def test_field_is_the_slope_of_the_potential(spark, terms):
    got = {r.id: (r.north, r.east, r.down) for r in field.field(places(spark), model(spark, terms), *at()).collect()}
    for key, lat, lon, alt in PLACES:
        assert np.allclose(got[key], by_hand(terms, lat, lon, alt), rtol=0, atol=0.01)
    strength = {r.id: r.intensity for r in field.intensity(places(spark), model(spark, terms), *at()).collect()}
    assert all(np.isclose(strength[k], np.linalg.norm(got[k])) for k in got)


def test_gradient_equals_differences(spark, terms):
    table = model(spark, terms)
    got = {r.id: (r.by_lat, r.by_lon, r.by_alt) for r in field.gradient(places(spark), table, *at()).collect()}
    rows = []
    for key, lat, lon, alt in PLACES:
        for k, (d1, d2, d3) in enumerate(((1e-5, 0, 0), (0, 1e-5, 0), (0, 0, 50.0))):
            rows += [(key, k, sign, lat + sign * d1, lon + sign * d2, alt + sign * d3) for sign in (-1, 1)]
    near = spark.createDataFrame(rows, "id long, k int, sign int, lat double, lon double, alt double")
    strength = {(r.id, r.k, r.sign): r.intensity for r in field.intensity(near, table, *at()).collect()}
    for key, _, _, _ in PLACES:
        expected = [(strength[key, k, 1] - strength[key, k, -1]) / (2 * d) for k, d in enumerate((1e-5, 1e-5, 50.0))]
        assert np.allclose(got[key][:2], expected[:2], rtol=1e-6, atol=0.5) and np.isclose(got[key][2], expected[2], rtol=1e-6, atol=1e-8)


def test_epochs_run_linearly_and_on_by_rates(spark, terms):
    later = {k: (g + 50, h + 10 * (k[1] > 0)) for k, (g, h) in terms.items()}
    table = model(spark, terms, 2015.0).unionByName(model(spark, later, 2020.0, 2.0))
    dates = spark.createDataFrame([(d,) for d in (2000.0, 2015.0, 2017.5, 2020.0, 2022.0, None)], "date double")
    got = {r.date: r.intensity for r in field.intensity(dates, table, F.col("date"), F.lit(0.7), F.lit(0.1), F.lit(0.0)).collect()}
    mixed = {k: tuple(a + share * (b - a) for a, b in zip(terms[k], later[k], strict=True)) for share in (0.5,) for k in terms}
    moved = {(n, m): (g + 4.0 * n, h + 4.0 * m) for (n, m), (g, h) in later.items()}
    for date, now in ((2000.0, terms), (2015.0, terms), (2017.5, mixed), (2020.0, later), (2022.0, moved)):
        assert np.isclose(got[date], np.linalg.norm(by_hand(now, 0.7, 0.1, 0.0)), atol=0.01)
    assert got[None] is None


def test_map_and_flight(spark, terms):
    table = model(spark, terms)
    cells = spark.createDataFrame([("m", 0, 0, 0.5, 0.1, -1.0, 100.0), ("m", 0, 1, 0.5, 0.2, -1.0, 0.0), (None, 0, 0, 0.5, 0.1, 400.0, 7.0)], "map_name string, iy int, ix int, yy double, xx double, alt double, val double")
    got = {(r.map_name, r.ix): r.val for r in field.corrected_map(cells, table, subtract=2020.0).collect()}
    assert np.isclose(got["m", 0], 100 - np.linalg.norm(by_hand(terms, 0.5, 0.1, 300.0)), atol=0.01) and got["m", 1] == 0
    assert np.isclose(got[None, 0], 7 - np.linalg.norm(by_hand(terms, 0.5, 0.1, 400.0)), atol=0.01)
    degrees = cells.withColumns({"yy": F.degrees("yy"), "xx": F.degrees("xx")})
    back = field.corrected_map(field.corrected_map(degrees, table, add=2020.0, units="deg"), table, subtract=2020.0, units="deg")
    assert np.allclose(sorted(r.val for r in back.collect()), [0, 7, 100])
    assert field.corrected_map(cells, table) is cells
    zone = F.lit(31)
    east, north = geodesy.to_utm(F.col("yy"), F.col("xx"), zone)
    metres = cells.withColumns({"_e": east, "_n": north}).withColumns({"xx": F.col("_e"), "yy": F.col("_n")}).drop("_e", "_n")
    utm = {(r.map_name, r.ix): r.val for r in field.corrected_map(metres, table, subtract=2020.0, units="utm", zone=31).collect()}
    assert np.isclose(utm["m", 0], got["m", 0], atol=0.01)
    flight = spark.createDataFrame([(2020, 1, 0.0, 0.5, 0.1, 300.0, 0.1, -0.2, 2.0, 0.0)], "year int, doy int, tt double, lat double, lon double, alt double, roll double, pitch double, yaw double, igrf double")
    nav, body = (field.flight_field(flight, table, f).first() for f in ("nav", "body"))
    assert np.allclose([nav.field_x, nav.field_y, nav.field_z], by_hand(terms, 0.5, 0.1, 300.0), atol=0.01)
    assert np.isclose(sum(body[c] ** 2 for c in ("field_x", "field_y", "field_z")), sum(nav[c] ** 2 for c in ("field_x", "field_y", "field_z"))) and abs(body.field_x - nav.field_x) > 100
    assert np.isclose(field.field_error(flight, table).first().rms, np.linalg.norm(by_hand(terms, 0.5, 0.1, 300.0)), atol=0.01)
    with pytest.raises(ValueError):
        field.flight_field(flight, table, "world")


def test_degree_thirteen(spark):
    """A whole model of the usual degree plans and runs."""
    rng = np.random.default_rng(1)
    terms = {(n, m): (float(rng.normal() * 3000 / n**2), float(rng.normal() * 3000 / n**2) if m else 0.0) for n, m in field.terms(13)}
    got = {r.id: (r.north, r.east, r.down) for r in field.field(places(spark), model(spark, terms), *at()).collect()}
    for key, lat, lon, alt in PLACES[:3]:
        assert np.allclose(got[key], by_hand(terms, lat, lon, alt), rtol=0, atol=0.05)


def test_empty_tables(spark, terms):
    assert field.field(places(spark).limit(0), model(spark, terms), *at()).count() == 0
    with pytest.raises(ValueError):
        field.field(places(spark), model(spark, {}), *at())
