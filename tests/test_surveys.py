"""Field lists of survey flights, what is derived from raw fields, and lines read by lookup tables."""

import numpy as np
import pytest
from fluxlane.operators.select import Order
from fluxlane.sources import surveys, tables
from pyspark.sql import functions as F


def test_fields_by_flight():
    first, third, last = (surveys.fields_of(f) for f in ("Flt1001", "Flt1003", "Flt1008"))
    assert "mag_6_uc" in last and "mag_6_uc" not in third and set(third) - set(first) == {"flux_a_x", "flux_a_y", "flux_a_z", "flux_a_t"}
    assert surveys.fields_of("Flt1004_1005") == third and len(set(last)) == len(last)
    assert surveys.fields_of("Flt2001_2017") == surveys.fields_of("fields21") == surveys.fields_of("Flt2017")
    assert set(surveys.fields_of("Flt1001_160Hz")) < set(surveys.fields_of("fields160"))
    with pytest.raises(ValueError):
        surveys.fields_of("Flt3001")


def flight(name, n=12, start=0.0, seed=1):
    """Raw rows of one flight, as a dict a row."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        row = {c: float(rng.normal()) for c in surveys.fields_of("fields20")} | {"tt": start + 0.1 * k, "line": float(100 * seed + k // 4), "lat": 45.0 + 0.001 * k, "lon": -75.0 + 0.002 * k, "flight": name}
        rows.append(row | {"utm_x": 10.0 * k + float(rng.normal()), "utm_y": 5.0 * k * k, "utm_z": 300.0 - k, "year": 2020.0, "doy": 185.0})
    return rows


def central(x):
    return np.concatenate([[x[1] - x[0]], (x[2:] - x[:-2]) / 2, [x[-1] - x[-2]]])


def test_what_raw_fields_give(spark):
    rows = flight("Flt1003") + flight("Flt1008", 7, 50.0, 2)
    got = surveys.derived(spark.createDataFrame(rows).repartition(3)).collect()
    for name in ("Flt1003", "Flt1008"):
        raw = [r for r in rows if r["flight"] == name]
        col = lambda c, raw=raw: np.array([r[c] for r in raw])
        out = sorted((r for r in got if r.flight == name), key=lambda r: r.tt)
        mine = lambda c, out=out: np.array([r[c] for r in out])
        vn, ve, vd = central(col("utm_y")) / 0.1, central(col("utm_x")) / 0.1, -central(col("utm_z")) / 0.1
        for c, expected in {"vn": vn, "ve": ve, "vd": vd, "fn": central(vn) / 0.1, "fe": central(ve) / 0.1, "fd": central(vd) / 0.1 - 9.80665, "igrf": col("mag_1_dc") - col("mag_1_igrf"), "lat": np.radians(col("lat")), "roll_rate": np.radians(col("roll_rate")), "alt": col("utm_z"), "ins_ve": -col("ins_vw"), "ins_vd": -col("ins_vu")}.items():
            assert np.allclose(mine(c), expected, rtol=1e-9, atol=1e-6), c
        turn, x, y = -col("ins_wander"), col("ins_acc_x"), -col("ins_acc_y")
        assert np.allclose(mine("ins_fn"), np.cos(turn) * x - np.sin(turn) * y) and np.allclose(mine("ins_fe"), np.sin(turn) * x + np.cos(turn) * y) and np.allclose(mine("ins_fd"), -col("ins_acc_z"))
        m = np.array(out[0].ins_cnb).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(m[2, 0], -np.sin(np.radians(raw[0]["ins_pitch"])))


def test_fast_record_stands_in(spark):
    slow = spark.createDataFrame(flight("Flt1002"))
    fast = spark.createDataFrame([{"flight": "Flt1002", "tt": k / 160, "mag_1_uc": float(k), "flux_d_t": -float(k)} for k in range(12 * 16)])
    got = sorted(surveys.with_fast_record(slow, fast, every=16).collect(), key=lambda r: r.tt)
    assert [r.mag_1_uc for r in got] == [16.0 * k for k in range(12)] and got[3].flux_d_t == -48 and len(got) == 12


@pytest.fixture
def survey(spark, tmp_path):
    """Two flights in files, the tables that name them, and a map."""
    for n, name in enumerate(("Flt1003", "Flt1008"), 1):
        spark.createDataFrame(flight(name, 12, 0.0, n)).write.parquet(str(tmp_path / name))
    flights = spark.createDataFrame([("Flt1003", "XYZ20", 1, str(tmp_path / "Flt1003"), 0), ("Flt1008", "XYZ20", 1, str(tmp_path / "Flt1008"), 1), ("Flt1003", "XYZ0", 1, "nowhere", 2), ("Flt9", "XYZ9", 2, "nowhere", 3)], "flight string, xyz_type string, xyz_set int, xyz_file string, row long")
    lines = spark.createDataFrame([("Flt1003", 100.0, 0.0, 0.35, "m", 0), ("Flt1003", 101.0, 0.45, 0.75, None, 1), ("Flt1008", 201.0, 0.35, 0.65, "m", 2), ("Flt9", 900.0, 0.0, 1.0, "m", 3)], "flight string, line double, t_start double, t_end double, map_name string, row long")
    cells = [("m", i, j, float(np.radians(44.99 + 0.005 * i)), float(np.radians(-75.01 + 0.005 * j)), 300.0, 50.0 + i + 2.0 * j) for i in range(10) for j in range(12)]
    grid = spark.createDataFrame(cells, "map_name string, iy int, ix int, yy double, xx double, alt double, val double")
    tables.write_grid(grid, str(tmp_path / "maps"))
    maps = spark.createDataFrame([("m", str(tmp_path / "maps"))], "map_name string, map_file string")
    return flights, lines, maps


def test_flights_and_lines_by_lookup(spark, survey):
    flights, lines, maps = survey
    whole = surveys.read_flight(spark, "Flt1003", flights)
    assert whole.count() == 12 and {"vn", "ins_fn", "igrf", "aux_1"} <= set(whole.columns)
    rows = surveys.read_lines(spark, [100.0, 101.0, 201.0, 555.0], lines, flights, maps).collect()
    assert sorted((r.line, round(r.tt, 1)) for r in rows) == [(100.0, 0.0), (100.0, 0.1), (100.0, 0.2), (100.0, 0.3), (101.0, 0.5), (101.0, 0.6), (101.0, 0.7), (201.0, 0.4), (201.0, 0.5), (201.0, 0.6)]
    for r in rows:
        k = round(r.tt / 0.1)
        # the map is a plane
        assert r.map_val is None if r.line == 101 else np.isclose(r.map_val, 50 + (0.01 + 0.001 * k) / 0.005 + 2 * (0.01 + 0.002 * k) / 0.005)
    assert surveys.read_lines(spark, [100.0], lines, flights).count() == 4
    for bad in (lambda: surveys.read_flight(spark, "Flt7", flights), lambda: surveys.read_flight(spark, "Flt9", flights), lambda: surveys.read_lines(spark, [100.0, 900.0], lines, flights), lambda: surveys.read_lines(spark, [555.0], lines, flights), lambda: surveys.read_lines(spark, [100.0, 100.0], lines, flights)):
        with pytest.raises(ValueError):
            bad()


def test_plain_flight_from_csv(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    with open(path, "w") as f:
        f.write("tt,lat,lon,alt,ins_lat,ins_lon,ins_alt,mag_1_c\n" + "".join(f"{0.1 * k:.1f},{45 + 0.001 * k},-75,300,{45 + 0.001 * k},-75,301,{50000 + k}\n" for k in range(6)))
    lookup = spark.createDataFrame([("A", "XYZ0", 1, path, 0)], "flight string, xyz_type string, xyz_set int, xyz_file string, row long")
    rows = sorted(surveys.read_flight(spark, "A", lookup).collect(), key=lambda r: r.tt)
    assert len(rows) == 6 and np.isclose(rows[2].lat, np.radians(45.002)) and rows[2].vn > 1000 and rows[2].ins_vn > 1000 and np.isnan(rows[0].diurnal) and rows[0].flight == "A"
    assert Order(("flight",), ("tt",)) == surveys.BY_FLIGHT


def test_models_of_lines(spark, survey):
    from fluxlane.operators import compensation

    flights, lines, maps = survey
    found = surveys.Lookups(lines, flights, maps)
    p = compensation.Params("TL", (), ("flux_b_x", "flux_b_y", "flux_b_z"), "y", ("permanent",))
    model, train, test = surveys.train_and_test_on_lines(spark, [100.0, 101.0], [201.0], found, "a", "mag_2_uc", p)
    assert len(model["coef"]) == 3 and train >= 0 and test > 0
    rows = found.rows(spark, [100.0], "c", "mag_2_uc", p, diurnal=True).collect()
    assert all(np.isclose(r.y, r.mag_2_uc - r.map_val - r.diurnal) for r in rows) and len(rows) == 4
    predicted, error = surveys.error_on_lines(spark, [201.0], found, "a", "mag_2_uc", p, model)
    miss = np.array([r.y_hat - (r.mag_2_uc - r.mag_1_c) for r in predicted.collect()])
    assert np.isclose(error, (miss - miss.mean()).std(ddof=1))
