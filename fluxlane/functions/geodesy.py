"""Geodesy and attitude as column expressions. Angles are radians, lengths metres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First eccentricity and equatorial radius of the Earth, standard gravity, rotation rate.
ECCENTRICITY = 0.0818191908426
EARTH_RADIUS = 6378137.0
GRAVITY = 9.80665
EARTH_RATE = 7.2921151467e-5


def _q(lat: Column) -> Column:
    return F.sqrt(1 - F.pow(ECCENTRICITY * F.sin(lat), F.lit(2)))


def north_to_lat(north: Column, lat: Column) -> Column:
    """Latitude difference of a northing."""
    return north * _q(lat) / EARTH_RADIUS


def east_to_lon(east: Column, lat: Column) -> Column:
    """Longitude difference of an easting."""
    return east * _q(lat) / EARTH_RADIUS / F.cos(lat)


def lat_to_north(dlat: Column, lat: Column) -> Column:
    return dlat / _q(lat) * EARTH_RADIUS


def lon_to_east(dlon: Column, lat: Column) -> Column:
    return dlon / _q(lat) * EARTH_RADIUS * F.cos(lat)


def body_to_nav(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rows of the direction cosine matrix from body to navigation frame."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cp * cy, sr * sp * cy - cr * sy, sr * sy + cr * sp * cy],
        [cp * sy, cr * cy + sr * sp * sy, cr * sp * sy - sr * cy],
        [-sp, sr * cp, cr * cp],
    ]


def transposed(m: list[list[Column]]) -> list[list[Column]]:
    return [list(r) for r in zip(*m, strict=True)]


def nav_to_body(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    return transposed(body_to_nav(roll, pitch, yaw))


def euler_of(body_nav: list[list[Column]]) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw) of a body-to-navigation matrix."""
    c = body_nav
    return F.atan2(c[2][1], c[2][2]), -F.asin(c[2][0]), F.atan2(c[1][0], c[0][0])


def times(m: list[list[Column]], v: list[Column]) -> list[Column]:
    return [sum((a * b for a, b in zip(r[1:], v[1:], strict=True)), r[0] * v[0]) for r in m]


def product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return transposed([times(a, c) for c in transposed(b)])


def tilted(matrix: list[list[Column]], tilt: list[Column]) -> list[list[Column]]:
    """The matrix after a small rotation by the tilt vector (Rodrigues); itself where the tilt is zero."""
    x, y, z = tilt
    m = F.sqrt(x * x + y * y + z * z)
    zero, safe = m == 0, F.when(m == 0, 1.0).otherwise(m)
    s = [[F.lit(0.0), -z, y], [z, F.lit(0.0), -x], [-y, x, F.lit(0.0)]]
    ss = product(s, s)
    a, b = F.sin(m) / safe, (1 - F.cos(m)) / (safe * safe)
    turn = [[F.lit(float(i == j)) - a * s[i][j] - b * ss[i][j] for j in range(3)] for i in range(3)]
    turned = product(turn, matrix)
    return [[F.when(zero, matrix[i][j]).otherwise(turned[i][j]) for j in range(3)] for i in range(3)]


def days_in_year(year: Column) -> Column:
    """366 in each fourth year, with no exception for centuries."""
    return F.when(F.floor(year) % 4 == 0, 366).otherwise(365)


def decimal_year(year: Column, day: Column) -> Column:
    return F.bround(year) + day / days_in_year(year)


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def on_plane(v: list[Column], x: list[Column], y: list[Column]) -> tuple[Column, Column]:
    """Coordinates of a vector along two unit vectors."""
    return dot(v, x), dot(v, y)


def field_plane(v_body: list[Column], field_nav: list[Column], body_nav: list[list[Column]]) -> tuple[Column, Column]:
    """(along, across) of a body vector in the horizontal plane, ``along`` towards the field's horizontal part."""
    nav = times(body_nav, v_body)
    h = F.sqrt(field_nav[0] ** 2 + field_nav[1] ** 2)
    n, e = field_nav[0] / h, field_nav[1] / h
    return nav[0] * n + nav[1] * e, nav[1] * n - nav[0] * e


def velocities(east: Column, north: Column, up: Column, dt: float) -> tuple[Column, Column, Column]:
    """(vn, ve, vd) of differences of position over one step."""
    return north / dt, east / dt, -up / dt


#: Fixed values of the Universal Transverse Mercator grid: flattening (WGS 84), scale on the central meridian, false easting and northing.
FLATTENING, UTM_SCALE, UTM_EAST, UTM_NORTH = 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RECTIFIED = EARTH_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Coefficients of a series in the third flattening: a row a harmonic, by rising power from its own order on."""
    return [sum(c * _N ** (k + j) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


#: Krueger's series to the fourth order, forward, inverse, and from conformal to geodetic latitude.
KRUEGER_TO = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
KRUEGER_FROM = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
GEODETIC = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _harmonics(coefficients: list[float], wave: Callable[[Column], Column], x: Column, swell: Callable[[Column], Column] | None = None, y: Column | None = None) -> Column:
    terms = [c * wave(2 * j * x) * (swell(2 * j * y) if swell else F.lit(1.0)) for j, c in enumerate(coefficients, 1)]
    return sum(terms[1:], terms[0])


def utm_zone(lon: Column) -> Column:
    """The zone of a longitude: 1 from 180 degrees west on, in steps of 6 degrees."""
    return (F.floor((F.degrees(lon) + 180) / 6) % 60 + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in a zone, by Krueger's series; south of the equator with the false northing."""
    e = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    d = lon - central_meridian(zone)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = UTM_EAST + UTM_SCALE * _RECTIFIED * (eta + _harmonics(KRUEGER_TO, F.cos, xi, F.sinh, eta))
    north = UTM_SCALE * _RECTIFIED * (xi + _harmonics(KRUEGER_TO, F.sin, xi, F.cosh, eta))
    return east, north + F.when(lat < 0, UTM_NORTH).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, is_north: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of a place in a zone of the northern or southern half."""
    xi, eta = (north - F.when(is_north, 0.0).otherwise(UTM_NORTH)) / (UTM_SCALE * _RECTIFIED), (east - UTM_EAST) / (UTM_SCALE * _RECTIFIED)
    x = xi - _harmonics(KRUEGER_FROM, F.sin, xi, F.cosh, eta)
    y = eta - _harmonics(KRUEGER_FROM, F.cos, xi, F.sinh, eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    return chi + _harmonics(GEODETIC, F.sin, chi), central_meridian(zone) + F.atan2(F.sinh(y), F.cos(x))
