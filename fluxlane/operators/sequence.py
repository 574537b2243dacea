"""Operators on ordered rows: differences, lags, chunks, windows, trends and recursions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlane.operators.select import Order

#: Rows that each scheme needs; shorter sequences give zeros.
SCHEMES = {"backward": 2, "forward": 2, "central": 3, "backward2": 4, "forward2": 4, "fourth": 5}


def difference(x: Column, order: Order, scheme: str = "central") -> Column:
    """Finite difference with unit step. Ends take one-sided differences, of the fourth order zeros."""
    least = SCHEMES[scheme]
    w = order.window
    back, back2, next_, next2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w), F.lead(x, 1).over(w), F.lead(x, 2).over(w)
    rn, n = F.row_number().over(w), F.count(F.lit(1)).over(order.whole)
    first, last = next_ - x, x - back
    if scheme == "backward":
        out = F.when(rn == 1, first).otherwise(last)
    elif scheme == "forward":
        out = F.when(rn == n, last).otherwise(first)
    elif scheme == "central":
        out = F.when(rn == 1, first).when(rn == n, last).otherwise((next_ - back) / 2)
    elif scheme == "backward2":
        out = F.when(rn <= 2, first).otherwise((3 * x - 4 * back + back2) / 2)
    elif scheme == "forward2":
        out = F.when(rn >= n - 1, last).otherwise((-next2 + 4 * next_ - 3 * x) / 2)
    else:
        out = F.when((rn <= 2) | (rn >= n - 1), 0.0).otherwise((back2 - 4 * back + 6 * x - 4 * next_ + next2) / 16)
    return F.when(n < least, 0.0).otherwise(out)


def lagged(x: Column, order: Order, k: int) -> Column:
    """The value k rows before; the first k rows keep their own."""
    w = order.window
    return F.when(F.row_number().over(w) <= k, x).otherwise(F.lag(x, k).over(w))


def chunks(df: DataFrame, order: Order, columns: list[str], length: int) -> DataFrame:
    """Consecutive chunks of ``length`` rows as arrays, one a column; what is left over at the end is dropped."""
    numbered = df.withColumn("_rn", F.row_number().over(order.window)).withColumn("chunk", F.floor((F.col("_rn") - 1) / length))
    rows = numbered.groupBy(*order.by, "chunk").agg(F.array_sort(F.collect_list(F.struct("_rn", *columns))).alias("_rows"))
    return rows.filter(F.size("_rows") == length).select(*order.by, "chunk", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def trailing(x: Column, order: Order, length: int) -> Column:
    """The latest ``length`` values as an array, filled in front with the first of the sequence."""
    w = order.window
    held = F.collect_list(x).over(w.rowsBetween(-(length - 1), Window.currentRow))
    return F.concat(F.array_repeat(F.element_at(held, 1), length - F.size(held)), held)


def joined_segments(df: DataFrame, order: Order, segment: str, columns: list[str], jump: float = 0.25) -> DataFrame:
    """``group``: segments numbered together while the deviation, over columns, of the jump between them is below ``jump``.

    ``order`` runs over all segments, which follow one another in it.
    """
    w = order.window
    jumps = F.array(*[F.col(c) - F.lag(c).over(w) for c in columns])
    mean = F.aggregate("_jump", F.lit(0.0), lambda a, b: a + b) / len(columns)
    spread = F.sqrt(F.aggregate("_jump", F.lit(0.0), lambda a, b: a + (b - F.col("_mean")) ** 2) / max(len(columns) - 1, 1))
    marked = df.withColumn("_jump", jumps).withColumn("_new", F.coalesce(F.lag(segment).over(w) != F.col(segment), F.lit(False))).withColumn("_mean", mean)
    marked = marked.withColumn("_break", (F.col("_new") & (spread >= jump)).cast("int"))
    return marked.withColumn("group", F.sum("_break").over(order.until_now())).drop("_jump", "_new", "_mean", "_break")


def without_mean(df: DataFrame, x: Column, by: tuple[str, ...], out: str) -> DataFrame:
    """``out``: ``x`` less its mean in each segment.

    Means are one aggregate that the rows join, so that no task holds a segment
    whole. Rows with null keys are segments too.
    """
    held = df.withColumn(out, x)
    means = held.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.avg(out).alias("_mean"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    return held.join(means, same).withColumn(out, F.col(out) - F.col("_mean")).drop("_mean", *[f"_by{i}" for i in range(len(by))])


def without_trend(df: DataFrame, order: Order, column: str, out: str) -> DataFrame:
    """``out``: the column less its least-squares line over row numbers."""
    numbered = df.withColumn("_rn", F.row_number().over(order.window).cast("double"))
    w, rn, x = order.whole, F.col("_rn"), F.col(column)
    mx, my = F.avg(rn).over(w), F.avg(x).over(w)
    centred = numbered.withColumn("_u", rn - mx).withColumn("_v", x - my)
    slope = F.coalesce(F.try_divide(F.sum(F.col("_u") * F.col("_v")).over(w), F.sum(F.col("_u") * F.col("_u")).over(w)), F.lit(0.0))
    return centred.withColumn(out, F.col("_v") - slope * F.col("_u")).drop("_rn", "_u", "_v")


def segment_error(df: DataFrame, predicted: Column, observed: Column, by: tuple[str, ...], out: str) -> DataFrame:
    """``out``: the prediction's error less its mean in each segment."""
    return without_mean(df, predicted - observed, by, out)


def autocorrelation(df: DataFrame, order: Order, column: str, lags: int) -> DataFrame:
    """Autocorrelation of each sequence at lags 0 to ``lags``: by, lag and acf."""
    w = order.whole
    centred = df.withColumn("_rn", F.row_number().over(order.window)).withColumn("_d", F.col(column) - F.avg(column).over(w))
    held = centred.groupBy(*order.by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_d"))), lambda r: r["_d"]).alias("_x"))
    product = F.expr("aggregate(zip_with(slice(_x, 1, size(_x) - lag), slice(_x, lag + 1, size(_x) - lag), (a, b) -> a * b), 0D, (s, p) -> s + p)")
    long = held.select(*order.by, "_x", F.explode(F.sequence(F.lit(0), F.least(F.lit(lags), F.size("_x") - 1))).alias("lag")).withColumn("_c", product)
    zero = F.first("_c").over(Window.partitionBy(*order.by).orderBy("lag"))
    return long.withColumn("acf", F.try_divide(F.col("_c"), zero)).select(*order.by, "lag", "acf")


def correlation_time(acf: DataFrame, by: tuple[str, ...], dt: float, most: float = 300.0) -> DataFrame:
    """``tau``: the first lag, in seconds, at which autocorrelation falls below 1/e, else ``most``."""
    return acf.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("acf") < np.exp(-1), F.col("lag") * dt)), F.lit(float(most))).alias("tau"))


def systematic_resample(df: DataFrame, order: Order, weight: str, u: float) -> DataFrame:
    """``copies``: how often systematic resampling with offset ``u`` takes each row of a weighted set."""
    total, n = F.sum(weight).over(order.whole), F.count(F.lit(1)).over(order.whole)
    upto = F.sum(weight).over(order.until_now())
    taken = lambda c: F.greatest(F.lit(0), F.ceil(F.round(c / total * n, 9) - u))
    return df.withColumn("_hi", taken(upto)).withColumn("_lo", taken(upto - F.col(weight))).withColumn("copies", (F.col("_hi") - F.col("_lo")).cast("long")).drop("_hi", "_lo")


def pin_start(df: DataFrame, order: Order, lat: str, lon: str, true_lat: str, true_lon: str, rows: int) -> DataFrame:
    """Positions pinned to the truth in the first rows; the last offset there is carried on."""
    w = order.window
    numbered = df.withColumn("_rn", F.row_number().over(w))
    for c, t in ((lat, true_lat), (lon, true_lon)):
        off = F.max(F.when(F.col("_rn") == rows, F.col(t) - F.col(c))).over(order.whole)
        numbered = numbered.withColumn(c, F.when(F.col("_rn") <= rows, F.col(t)).otherwise(F.col(c) + F.coalesce(off, F.lit(0.0))))
    return numbered.drop("_rn")


def gauss_markov(df: DataFrame, order: Order, noise: str, sigma: float, tau: float, dt: float, out: str = "fogm") -> DataFrame:
    """First-order Gauss-Markov sequence of given unit noise: x1 = sigma w, then x = phi x + sqrt(q) w.

    A recursion along each sequence: one task a sequence, in time linear in its samples.
    """
    phi, q = float(np.exp(-dt / tau)), float(np.sqrt(2 * sigma**2 / tau * dt))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order.along), kind="stable")
        x, made = 0.0, []
        for k, w in enumerate(pdf[noise].tolist()):
            x = phi * x + q * w if k else sigma * w
            made.append(x)
        return pdf.assign(**{out: made})

    schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, (out, "double")])
    return df.groupBy(*order.by).applyInPandas(run, schema)


def butterworth(low: float, high: float, fs: float = 10.0, poles: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter by the bilinear map: low, high or band pass by which cut-offs lie in (0, fs / 2)."""
    has_low, has_high = 0 < low < fs / 2, 0 < high < fs / 2
    if not has_low and not has_high:
        raise ValueError("a filter that passes everything")
    k = np.arange(poles)
    p = np.exp(1j * np.pi * (2 * k + poles + 1) / (2 * poles))
    z, gain = np.zeros(0), 1.0
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if has_low and has_high:
        w1, w2 = warp(low), warp(high)
        bw, w0 = w2 - w1, np.sqrt(w1 * w2)
        half = p * bw / 2
        root = np.sqrt(half**2 - w0**2)
        z, p, gain = np.zeros(poles), np.concatenate([half + root, half - root]), bw**poles
    elif has_high:
        p, gain = p * warp(high), warp(high) ** poles
    else:
        z, p, gain = np.zeros(poles), warp(low) / p, 1.0
    zd, pd_ = (2 * fs + z) / (2 * fs - z), (2 * fs + p) / (2 * fs - p)
    gain = gain * np.real(np.prod(2 * fs - z) / np.prod(2 * fs - p))
    zd = np.append(zd, -np.ones(len(p) - len(z)))
    return gain * np.real(np.poly(zd)), np.real(np.poly(pd_))


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The recursion sample by sample, on plain numbers: blocks of it lose digits where poles lie near the unit circle."""
    b0, last_b, last_a, taps, out, z = float(b[0]), float(b[-1]), float(a[-1]), list(zip(b[1:-1].tolist(), a[1:-1].tolist(), strict=True)), [], state.tolist()
    for v in x.tolist():
        y = b0 * v + z[0]
        z = [bk * v + zk - ak * y for (bk, ak), zk in zip(taps, z[1:], strict=True)]
        z.append(last_b * v - last_a * y)
        out.append(y)
    return np.array(out)


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter forwards and backwards, ends extended by odd reflection, started in the steady state."""
    n = len(a) - 1
    pad = min(3 * (n + 1), len(x) - 1)
    if pad < 1:
        return x.copy()
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    companion = np.eye(n) - np.column_stack([-a[1:], np.eye(n)[:, : n - 1]])
    try:
        start = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    except np.linalg.LinAlgError:
        start = np.zeros(n)
    y = _filter(b, a, wide, start * wide[0])
    y = _filter(b, a, y[::-1], start * y[-1])[::-1]
    return y[pad : pad + len(x)]


def bandpass(df: DataFrame, order: Order, columns: list[str], low: float = 0.1, high: float = 0.9, fs: float = 10.0, poles: int = 4) -> DataFrame:
    """The columns filtered without phase shift along each sequence; columns that hardly change pass as they are.

    A recursive filter needs its sequence in order in one place: one task a sequence.
    """
    b, a = butterworth(low, high, fs, poles)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order.along), kind="stable")
        for c in columns:
            x = pdf[c].to_numpy(float)
            if len(x) > 1 and np.std(x) > np.finfo(float).eps:
                pdf[c] = zero_phase(x, b, a)
        return pdf

    typed = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return typed.groupBy(*order.by).applyInPandas(run, typed.schema)


def power_spectrum(df: DataFrame, order: Order, column: str, fs: float = 10.0, size: int = 256) -> DataFrame:
    """Welch's power spectral density of each sequence with Hamming windows that overlap by half: by, frequency and power."""
    fields = ", ".join(f"{n} {t}" for n, t in df.select(*order.by).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(order.along), kind="stable")[column].to_numpy(float)
        n = min(size, len(x))
        w = np.hamming(n) if n > 1 else np.ones(n)
        starts = range(0, len(x) - n + 1, max(1, n // 2))
        power = np.mean([np.abs(np.fft.rfft(x[s : s + n] * w)) ** 2 for s in starts], 0) / (fs * (w**2).sum())
        power[1 : (n + 1) // 2] *= 2
        out = pd.DataFrame({"frequency": np.fft.rfftfreq(n, 1 / fs), "power": power})
        for c in reversed(order.by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return df.groupBy(*order.by).applyInPandas(run, f"{fields}, frequency double, power double")


def expanded_axis(start: float, stop: float, step: float, low: float, high: float, extra: bool = False) -> list[float]:
    """The axis start, start + step ... stop, carried on by whole steps until it covers low to high."""
    before = max(0, int(np.ceil((start - low) / step - 1e-9))) + extra
    after = max(0, int(np.ceil((high - stop) / step - 1e-9))) + extra
    n = int(round((stop - start) / step))
    return [start + i * step for i in range(-before, n + after + 1)]


def runs(b: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, str, str]:
    """Where each run of equal keys begins in a batch, and its end; and the first and the last key, to be compared with those of other batches."""
    new = np.zeros(b.num_rows, bool)
    for c in by:
        code = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    key = lambda i: repr([b.column(c)[i].as_py() for c in by])
    return np.concatenate([[0], np.flatnonzero(new), [b.num_rows]]), key(0), key(b.num_rows - 1)


def batches_sorted(order: Order, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pdf.sort_values(list(order.along), kind="stable")
