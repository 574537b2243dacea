"""The store of map levels against continuing and interpolating each level by itself."""

import os

import numpy as np
from fluxlane.operators import grid as g
from fluxlane.operators import mapcache, spectral
from pyspark.sql import functions as F


def cells(spark, name, alt, values, x0=0.0):
    rows = [(name, i, j, i * 1.0, x0 + j * 1.0, alt, float(values[i, j])) for i in range(values.shape[0]) for j in range(values.shape[1])]
    return spark.createDataFrame(rows, "map_name string, iy int, ix int, yy double, xx double, alt double, val double")


def test_levels_are_chosen_stored_once_and_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    base, low, high = rng.normal(size=(12, 12)) + 50, rng.normal(size=(12, 8)) + 60, rng.normal(size=(6, 8)) + 70
    low[3, 3] = 0
    maps = cells(spark, "base", 0.0, base).unionByName(cells(spark, "low", 2.0, low)).unionByName(cells(spark, "high", 5.0, high))
    cache = mapcache.MapCache(maps, "base", str(tmp_path / "levels"), 2.0)
    spots = [(0, 1.5, 1.5, 1.0), (1, 1.5, 1.5, 3.9), (2, 1.5, 1.5, 7.5), (3, 3.5, 3.5, 4.5), (4, 1.5, 9.0, 4.5), (5, 1.5, 20.0, 4.5), (6, 3.2, 2.5, 5.2), (7, 1.5, 1.5, None), (8, 2.5, 3.5, 3.0)]
    points = spark.createDataFrame([(*p, "x") for p in spots], "id long, lon double, lat double, alt double, _on string").drop("_on")
    expected = {0: ("base", 0.0), 1: ("low", 2.0), 2: ("high", 6.0), 3: ("base", 4.0), 4: ("low", 4.0), 5: ("base", 4.0), 6: ("high", 5.0), 7: (None, None), 8: ("base", 2.0)}
    rows = {r.id: r for r in cache.values(points).collect()}
    assert {k: (r.map_name, r.level) for k, r in rows.items()} == expected
    own = {"base": (base, 0.0), "low": (low, 2.0), "high": (high, 5.0)}
    for k, lon, lat, _ in spots:
        name, level = expected[k]
        if name is None or lat > 11:
            assert rows[k].map_val is None
            continue
        values, alt = own[name]
        surface = g.Interpolant(spectral.continued(values, 1.0, 1.0, level - alt), g.Axes(0.0, 0.0, 1.0, 1.0, values.shape[1], values.shape[0]))
        assert np.isclose(rows[k].map_val, surface(lat, lon))
    assert cache.stored() == {v for v in expected.values() if v[0]}
    written = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs}
    assert cache.fill(cache.placed(points)) == []
    again = {r.id: r.map_val for r in cache.values(points).collect()}
    assert again == {k: r.map_val for k, r in rows.items()} and written == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs}
    assert cache.fill(cache.placed(points.withColumn("alt", F.lit(9.0)))) == [("base", 8.0), ("high", 8.0), ("low", 8.0)]
    # a level is read by its folder alone
    plan = spark.read.parquet(cache.folder).filter("map_name = 'low' AND level = 4.0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(map_name" in plan


def test_no_points(spark, tmp_path):
    cache = mapcache.MapCache(cells(spark, "base", 0.0, np.ones((4, 4))), "base", str(tmp_path / "none"))
    empty = spark.createDataFrame([], "id long, lon double, lat double, alt double")
    assert cache.fill(cache.placed(empty)) == [] and cache.stored() == set()
