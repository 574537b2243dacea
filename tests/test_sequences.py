import numpy as np
import pytest
from fluxlane.operators import select, sequence
from fluxlane.operators.select import Order
from pyspark.sql import functions as F

ORDER = Order(("line",), ("t",))


def frame(spark, *lines):
    return spark.createDataFrame([(k, t, float(v)) for k, values in enumerate(lines) for t, v in enumerate(values)], "line int, t int, x double")


def column(df, name, key=("line", "t")):
    return [r[name] for r in sorted(df.collect(), key=lambda r: [r[k] for k in key])]


@pytest.mark.parametrize(
    ("scheme", "want"),
    [
        ("central", [1, 2, 4, 6, 7]),
        ("backward", [1, 1, 3, 5, 7]),
        ("forward", [1, 3, 5, 7, 7]),
        ("backward2", [1, 3, 4, 6, 8]),
        ("forward2", [0, 2, 4, 5, 7]),
        ("fourth", [0, 0, 0, 0, 0]),
    ],
)
def test_difference_schemes(spark, scheme, want):
    df = frame(spark, [0, 1, 4, 9, 16], [5], [3, 4]).withColumn("d", sequence.difference(F.col("x"), ORDER, scheme))
    got = column(df, "d")
    assert got[:5] == want and got[5] == 0
    assert got[6:] == ([1, 1] if sequence.SCHEMES[scheme] <= 2 else [0, 0])


def test_fourth_difference(spark):
    df = frame(spark, [0, 0, 16, 0, 0]).withColumn("d", sequence.difference(F.col("x"), ORDER, "fourth"))
    assert column(df, "d") == [0, 0, 6, 0, 0]


def test_lags_keep_their_own_head(spark):
    df = frame(spark, [1, 2, 3, 4]).withColumn("d", sequence.lagged(F.col("x"), ORDER, 2))
    assert column(df, "d") == [1, 2, 1, 2]


def test_chunks_drop_the_rest(spark):
    got = sequence.chunks(frame(spark, [1, 2, 3, 4, 1, 2, 3], [9]), ORDER, ["x"], 2).orderBy("chunk").collect()
    assert [(r.line, r.x) for r in got] == [(0, [1, 2]), (0, [3, 4]), (0, [1, 2])]


def test_trailing_windows_are_padded(spark):
    df = frame(spark, [1, 2, 3]).withColumn("d", sequence.trailing(F.col("x"), ORDER, 3))
    assert column(df, "d") == [[1, 1, 1], [1, 1, 2], [1, 2, 3]]


def test_segments_without_a_jump_are_joined(spark):
    rows = [(0, t, s, a, b) for t, (s, a, b) in enumerate([(1, 0.0, 0.0), (1, 0.1, 0.1), (2, 0.2, 0.2), (3, 9.0, 0.0), (3, 9.1, 0.1)])]
    df = spark.createDataFrame(rows, "line int, t int, seg int, a double, b double")
    assert column(sequence.joined_segments(df, ORDER, "seg", ["a", "b"]), "group") == [0, 0, 0, 1, 1]


def test_trend_and_correlation_time(spark):
    assert np.allclose(column(sequence.without_trend(frame(spark, [3, 5, 7, 9], [4]), ORDER, "x", "d"), "d"), 0)
    acf = sequence.autocorrelation(frame(spark, [1, -1] * 10, [2, 2, 2]), ORDER, "x", 5)
    tau = {r.line: r.tau for r in sequence.correlation_time(acf, ("line",), 0.1).collect()}
    assert tau == {0: 0.1, 1: 300.0}


def test_filter_keeps_constants_and_takes_out_what_is_outside(spark):
    b, a = sequence.butterworth(0, 1.0, 10.0)
    t = np.arange(400) / 10
    assert np.allclose(sequence.zero_phase(np.full(50, 3.0), b, a), 3)
    b, a = sequence.butterworth(0.1, 0.9, 10.0)
    slow, mid = np.sin(2 * np.pi * 0.005 * t), np.sin(2 * np.pi * 0.4 * t)
    got = sequence.zero_phase(slow + mid, b, a)
    assert np.max(np.abs(got - mid)[100:300]) < 0.1
    assert np.allclose(sequence.zero_phase(2 * slow, b, a), 2 * sequence.zero_phase(slow, b, a))
    df = sequence.bandpass(frame(spark, [7] * 30, list(mid[:60])), ORDER, ["x"])
    got = column(df, "x")
    assert got[:30] == [7] * 30 and np.allclose(got[30:], sequence.zero_phase(mid[:60], b, a))
    with pytest.raises(ValueError):
        sequence.butterworth(0, 99, 10)


def test_gauss_markov_equals_a_loop(spark):
    w = np.random.default_rng(1).standard_normal(20)
    got = column(sequence.gauss_markov(frame(spark, w), ORDER, "x", 3.0, 60.0, 0.1), "fogm")
    x = [3.0 * w[0]]
    for v in w[1:]:
        x.append(np.exp(-0.1 / 60) * x[-1] + np.sqrt(2 * 9 / 60 * 0.1) * v)
    assert np.allclose(got, x)


def test_resampling_takes_as_many_as_there_are(spark):
    df = sequence.systematic_resample(frame(spark, [1, 0, 5, 2]), ORDER, "x", 0.3)
    assert sum(column(df, "copies")) == 4 and column(df, "copies")[1] == 0


def test_start_is_pinned_and_offset_carried(spark):
    df = frame(spark, [1, 2, 3, 4]).withColumns({"lat": F.col("x"), "lon": F.col("x"), "a": F.col("x") + 10, "b": F.col("x") * 2})
    got = sequence.pin_start(df, ORDER, "lat", "lon", "a", "b", 2)
    assert column(got, "lat") == [11, 12, 13, 14] and column(got, "lon") == [2, 4, 5, 6]


def test_expanded_axis():
    assert np.allclose(sequence.expanded_axis(0, 2, 1, -1.5, 2), [-2, -1, 0, 1, 2])
    assert np.allclose(sequence.expanded_axis(0, 1, 0.5, 0, 1, True), [-0.5, 0, 0.5, 1, 1.5])


def test_splits_round_half_even(spark):
    df = spark.range(50).select(F.lit(1).alias("line"), F.col("id").alias("t"))
    parts = select.split_rows(df, ORDER, (0.7, 0.2, 0.1)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {1: 35, 2: 10, 3: 5}
    five = df.limit(5)
    assert {r.split: r["count"] for r in select.split_rows(five, ORDER, (0.5, 0.5)).groupBy("split").count().collect()} == {1: 2, 2: 3}
    with pytest.raises(ValueError):
        select.split_rows(df, ORDER, (0.5, 0.4))


def test_lines_by_lookup(spark):
    df = frame(spark, range(10), range(10))
    lookup = spark.createDataFrame([(1, 0, 2.0, 3.0), (2, 0, 6.0, 7.0)], "n int, line int, t_start double, t_end double")
    got = select.select_by_lookup(df, lookup, (0, 5), "n", tt="t")
    assert sorted(r.t for r in got.collect()) == [2, 3, 4, 5, 6, 7]  # from the first start to the last end
    with pytest.raises(ValueError):
        select.select_by_lookup(df, lookup, (0, 0), "n", tt="t")
    with pytest.raises(ValueError):
        select.in_time(F.col("t"), (1, 2, 3))


def test_events_match_lower_case_keywords_only(spark):
    df = spark.createDataFrame([("f", 1.0, "Radio ON"), ("f", 2.0, "off"), ("g", 1.0, "radio")], "flight string, tt double, event string")
    assert [r.tt for r in select.filter_events(df, "f", "radio").collect()] == [1.0]
    assert select.filter_events(df, "f", "Radio").collect() == []
    assert [r.tt for r in select.filter_events(df, "f", "", (1.5,)).collect()] == [1.0]


def test_windows_for_training(spark):
    df = frame(spark, range(10))
    sliding = column(select.train_parts(df, ORDER, 0.5, 3, "sliding"), "part")
    assert sliding == ["train"] * 3 + [None] * 2 + ["validation"] * 3 + [None] * 2
    contiguous = column(select.train_parts(df, ORDER, 0.5, 3, "contiguous"), "part")
    assert contiguous == ["train", None, None, "validation", None, None, "validation", None, None, None]
    assert set(column(select.train_parts(df, ORDER, 0.5, 3, "none"), "part")) <= {"train", "validation"}


def test_segment_errors_hold_no_segment_whole(spark):
    rows = [("a", 5.0, 1.0), ("a", 9.0, 3.0), ("a", None, 3.0), (None, 7.0, 4.0), (None, 4.0, 3.0), ("b", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "seg string, y_hat double, y double")
    out = sequence.segment_error(df, F.col("y_hat"), F.col("y"), ("seg",), "err")
    assert out.columns == ["seg", "y_hat", "y", "err"] and "Window" not in out._jdf.queryExecution().toString()
    assert sorted((r.seg or "", r.y_hat or 0, r.err) for r in out.collect() if r.y_hat is not None) == [("", 4, -1), ("", 7, 1), ("a", 5, -1), ("a", 9, 1), ("b", 2, 0)]
    assert out.filter("y_hat is null").first().err is None and out.count() == 6
    assert sorted(r.d for r in sequence.without_mean(df, F.col("y"), (), "d").collect()) == [1 - 16 / 6, 2 - 16 / 6, 3 - 16 / 6, 3 - 16 / 6, 3 - 16 / 6, 4 - 16 / 6]
    from fluxlane.operators import compensation

    found = compensation.error(df.withColumnRenamed("y", "_y"), ("seg",))
    assert np.isclose(found, np.std([-1, 1, 1, -1, 0], ddof=1)) and compensation.error(df.withColumnRenamed("y", "_y").filter("seg = 'b'"), ("seg",)) == 0
