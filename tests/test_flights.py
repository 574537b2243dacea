"""What flight files leave out."""

import numpy as np
import pytest
from fluxlane.operators.select import Order
from fluxlane.sources import flights
from pyspark.sql import functions as F

ORDER = Order(("line",), ("k",))


@pytest.fixture(scope="module")
def track(spark):
    # line 1 flies north at 40 m/s and east at 30 m/s, across the equator; line 2 has one row
    metre = 1 / 6378137.0
    rows = [(1, k, (k - 5) * 40 * 0.1 * metre, 0.05 + k * 30 * 0.1 * metre, 300.0 - k) for k in range(11)]
    return spark.createDataFrame([*rows, (2, 0, 0.7, 0.1, 5.0)], "line int, k int, lat double, lon double, alt double")


def test_motion_of_places_alone(track):
    out = flights.with_motion(track, ORDER, 0.1)
    rows = out.filter("line = 1").orderBy("k").collect()
    assert out.columns == [*track.columns, "vn", "ve", "vd", "fn", "fe", "fd", "tt", "cnb"]
    assert np.allclose([r.tt for r in rows], np.arange(11) * 0.1) and np.allclose([r.vd for r in rows], 10)
    assert np.allclose([r.vn for r in rows], 40, atol=0.5) and np.allclose([r.ve for r in rows], 30, atol=0.5)  # the earth's shape and the grid's scale
    assert np.allclose([r.fd for r in rows], -9.80665) and np.allclose([r.fn for r in rows], 0, atol=0.01)
    heading = np.arctan2(rows[3].ve, rows[3].vn)
    assert np.allclose(rows[3].cnb[0], np.cos(np.deg2rad(2)) * np.cos(heading)) and np.allclose(np.reshape(rows[3].cnb, (3, 3)) @ np.reshape(rows[3].cnb, (3, 3)).T, np.eye(3))
    single = out.filter("line = 2").first()
    assert (single.tt, single.vn, single.fn, single.fd) == (0.0, 0.0, 0.0, -9.80665)


def test_given_values_stay_unless_the_line_has_a_gap(track):
    given = track.withColumns({"tt": F.col("k") * 0.5, "vn": F.lit(1.0), "ve": F.lit(2.0), "vd": F.when(F.col("k") == 4, float("nan")).otherwise(3.0), "fn": F.lit(7.0), "fe": F.lit(8.0), "fd": F.lit(9.0)})
    rows = flights.with_motion(given, ORDER).collect()
    one, two = [r for r in rows if r.line == 1], [r for r in rows if r.line == 2][0]
    assert np.allclose([r.vd for r in one], 2) and np.allclose([r.vn for r in one], 8, atol=0.1)  # the step comes from the times
    assert (two.vn, two.ve, two.vd) == (1.0, 2.0, 3.0) and all((r.fn, r.fe, r.fd) == (7.0, 8.0, 9.0) for r in rows)


def test_attitude_of_a_matrix_and_of_another_prefix(track):
    unit = F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)])
    given = track.select("line", "k", *[F.col(c).alias(f"ins_{c}") for c in ("lat", "lon", "alt")], F.when((F.col("line") == 2), F.lit(None)).otherwise(unit).alias("ins_cnb"), F.lit(1).alias("vn"))
    out = flights.with_motion(given, ORDER, prefix="ins_")
    assert "ins_fd" in out.columns and out.filter("vn = 1").count() == 12
    assert all((r.ins_cnb == [1, 0, 0, 0, 1, 0, 0, 0, 1]) == (r.line == 1) for r in out.collect())


def test_totals_and_empty_tables(track):
    given = track.withColumns({"x": F.lit(3), "y": F.lit(4), "z": F.lit(0), "t": F.when(F.col("k") == 10, None).otherwise(1.0)})
    assert {(r.line, r.t) for r in flights.with_total(given, ORDER, "x", "y", "z", "t").collect()} == {(1, 5.0), (2, 1.0)}
    assert {r.s for r in flights.with_total(given, ORDER, "x", "y", "z", "s").collect()} == {5.0}
    assert flights.with_motion(track.filter("false"), ORDER).count() == 0
