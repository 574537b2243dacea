"""Windowed counts: late events, restarts and batches that run again."""

import datetime as dt

import pandas as pd
import pytest
from fluxlane.streaming import realtime, windows
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def put(spark, folder, n, rows):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, "a", v) for i, h, v in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/day.parquet")


def test_a_restart_goes_on_and_late_events_are_dropped(spark, tmp_path):
    folder = str(tmp_path)

    def counted():
        events = spark.readStream.schema(SCHEMA).parquet(f"{folder}/day.parquet")
        stream = windows.counts(events).select("event_type", F.unix_seconds("w.start").alias("start"), "n", "total")
        return {(r.start - 1704067200) // 3600: (r.n, r.total) for r in windows.upserted(stream, f"{folder}/kept", ["event_type", "start"]).collect()}

    put(spark, folder, 1, [(1, 0.5, 1.0), (2, 5.2, 2.0)])
    assert counted() == {0: (1, 1.0), 5: (1, 2.0)}
    put(spark, folder, 2, [(3, 5.9, 4.0), (4, 9.1, 1.0), (5, 0.6, 100.0)])  # the last one is hours late
    assert counted() == {0: (1, 1.0), 5: (2, 6.0), 9: (1, 1.0)}
    assert counted() == {0: (1, 1.0), 5: (2, 6.0), 9: (1, 1.0)}


def test_states_of_idle_lines_go():
    class State:
        exists, hasTimedOut, removed, kept, wait = False, False, False, None, None

        def remove(self):
            self.removed = True

        def update(self, v):
            self.exists, self.get, self.kept = True, v, v

        def setTimeoutDuration(self, ms):
            self.wait = ms

    held = {}

    class Samples:
        def groupBy(self, _):
            return self

        def applyInPandasWithState(self, run, *_args):
            held["run"], held["timeout"] = run, _args[-1]

    from fluxlane.plans import navigation

    realtime.filtered(Samples(), navigation.surface(), navigation.MODEL, idle_ms=1000)
    row = dict(zip(realtime.nav.MOTION, (navigation.LAT0, navigation.LON0, 300.0, 0.0, 70.0, 0.0, 0.0, 0.0, -9.81), strict=True)) | {"tt": 1.0, "z": 3.0, "cnb": [1.0, 0, 0, 0, 1, 0, 0, 0, 1]}
    s = State()
    assert len(next(held["run"]((1,), iter([pd.DataFrame([row])]), s))) == 1 and s.wait == 1000 and s.kept and held["timeout"] == "ProcessingTimeTimeout"
    s.hasTimedOut = True
    assert list(held["run"]((1,), iter([]), s)) == [] and s.removed


def test_no_local_folder_on_a_cluster():
    from fluxlane.sources import tables

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        tables.scratch(Cluster())


def test_neighbouring_lines_share_a_state(spark):
    """Lines of a call step together, go on in the next, rest in between, and equal lines that have a stream each."""
    import numpy as np

    from fluxlane.plans import navigation

    held = {}

    class State:
        exists = hasTimedOut = False

        def update(self, v):
            self.exists, self.get = True, v

    class Samples:
        def withColumn(self, *_):
            return self

        groupBy = withColumn

        def applyInPandasWithState(self, run, *_args):
            held["run"] = run

    realtime.filtered(Samples(), navigation.surface(), navigation.MODEL)
    motion = (navigation.LAT0, navigation.LON0, 300.0, 0.0, 70.0, 0.0, 0.0, 0.0, -9.81)
    row = lambda line, tt: dict(zip(realtime.nav.MOTION, motion, strict=True)) | {"line": line, "tt": tt, "z": 3.0 * line + tt, "cnb": [1.0, 0, 0, 0, 1, 0, 0, 0, 1]}
    calls = [[(5, 2.0), (3, 1.0), (5, 1.0), (3, 1.0)], [(5, 2.0), (5, 3.5)], [(3, 0.5), (3, 4.0), (9, 1.0), (5, 3.6)]]
    together = State()
    got = pd.concat([next(held["run"]((0,), iter([pd.DataFrame([row(*r) for r in c])]), together)) for c in calls])
    assert sorted(zip(got["line"], got["tt"], strict=True)) == [(3, 1.0), (3, 4.0), (5, 1.0), (5, 2.0), (5, 3.5), (5, 3.6), (9, 1.0)]
    for line in (3, 5, 9):
        alone, mine = None, got[got["line"] == line]
        for t, d_lat, residual in zip(mine["tt"], mine["d_lat"], mine["residual"], strict=True):
            alone, x, _, r = realtime.nav.step(alone, t, np.array(motion), np.eye(3), 3.0 * line + t, navigation.surface(), navigation.MODEL)
            assert np.isclose(d_lat, x[0], rtol=1e-9, atol=1e-16) and np.isclose(residual, r)
