"""Row selection: lines and times, lookups, splits, strides and events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """How rows follow one another: within ``by``, along ``along``, which must tell them apart."""

    by: tuple[str, ...]
    along: tuple[str, ...]

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(*self.along)

    @property
    def whole(self) -> Window:
        return Window.partitionBy(*self.by)

    def until_now(self) -> Window:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def in_time(tt: Column, limits: Sequence[float]) -> Column:
    """One limit is an upper bound; two bound both ends, both included."""
    if len(limits) == 0:
        return F.lit(True)
    if len(limits) == 1:
        return tt <= limits[0]
    if len(limits) == 2:
        return tt.between(*limits)
    raise ValueError("time limits are one or two numbers")


def select_rows(df: DataFrame, lines: Sequence | None = None, limits: Sequence[float] = (), mask: Column | None = None, line: str = "line", tt: str = "tt") -> DataFrame:
    """Rows of any of the lines, within the time limits, where the mask holds."""
    keep = in_time(F.col(tt), limits)
    if lines is not None:
        keep &= F.col(line).isin(*lines)
    return df.filter(keep if mask is None else keep & mask)


def line_bounds(lookup: DataFrame, number: str, key: str = "line") -> DataFrame:
    """One row a line: the first row's t_start and the last row's t_end, rows in order of ``number``."""
    return lookup.groupBy(key).agg(F.min_by("t_start", number).alias("t_start"), F.max_by("t_end", number).alias("t_end"))


def select_by_lookup(df: DataFrame, lookup: DataFrame, lines: Sequence, number: str, line: str = "line", tt: str = "tt") -> DataFrame:
    """Rows of the lines within the lookup's bounds. Lines that the lookup lacks are skipped; a line twice is an error."""
    if len(set(lines)) != len(lines):
        raise ValueError("lines must be unique")
    bounds = line_bounds(lookup.filter(F.col(line).isin(*lines)), number, line)
    return df.join(F.broadcast(bounds), line).filter(F.col(tt).between(F.col("t_start"), F.col("t_end"))).drop("t_start", "t_end")  # a row a line asked for


def with_first_match(df: DataFrame, lookup: DataFrame, key: str, number: str) -> DataFrame:
    """``df`` with the columns of the lookup's first row of its key (in order of ``number``), null where it has none."""
    rest = [c for c in lookup.columns if c not in (key, number)]
    first = lookup.groupBy(key).agg(F.min_by(F.struct(*rest), number).alias("_first"))
    return df.join(first, key, "left").select(*df.columns, *[F.col(f"_first.{c}").alias(c) for c in rest])


def overlay(slow: DataFrame, fast: DataFrame, order: Order, every: int, columns: Sequence[str]) -> DataFrame:
    """``slow`` with columns of a faster record of the same sequences, by position: row k takes row (k - 1) * every + 1, null beyond its end."""
    picked = fast.withColumn("_k", F.row_number().over(order.window)).filter((F.col("_k") - 1) % every == 0)
    picked = picked.select(*order.by, F.expr(f"(_k - 1) div {every} + 1").alias("_k"), *columns)
    numbered = slow.withColumn("_k", F.row_number().over(order.window).cast("long"))
    return numbered.join(picked, [*order.by, "_k"], "left").select(*slow.columns, *columns)


def trim_tail(df: DataFrame, order: Order, multiple: int) -> DataFrame:
    """Rows at the end of each sequence go until its length is a multiple."""
    n = F.count(F.lit(1)).over(order.whole)
    numbered = df.withColumn("_rn", F.row_number().over(order.window)).withColumn("_n", n)
    return numbered.filter(F.col("_rn") <= F.col("_n") - F.col("_n") % multiple).drop("_rn", "_n")


def split_rows(df: DataFrame, order: Order, fractions: Sequence[float]) -> DataFrame:
    """``split``: which of two or three consecutive parts a row is in; cuts are rounded half to even."""
    if not 2 <= len(fractions) <= 3 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("two or three fractions that sum to one are needed")
    n = F.count(F.lit(1)).over(order.whole)
    numbered = df.withColumn("_rn", F.row_number().over(order.window)).withColumn("_n", n)
    first = F.bround(F.col("_n") * float(fractions[0]), 0)
    part = F.when(F.col("_rn") <= first, 1)
    if len(fractions) == 3:
        part = part.when(F.col("_rn") <= F.bround(F.col("_n") * float(fractions[0] + fractions[1]), 0), 2)
    return numbered.withColumn("split", part.otherwise(len(fractions))).drop("_rn", "_n")


def train_parts(df: DataFrame, order: Order, fraction: float, window: int, kind: str, seed: int = 2) -> DataFrame:
    """``part``: train or validation of rows for windowed training, null where neither.

    ``none``: a hash decides; ``sliding``: windows start at any row, and those
    that reach over the cut fall out; ``contiguous``: windows don't overlap.
    """
    n = F.count(F.lit(1)).over(order.whole)
    numbered = df.withColumn("_rn", F.row_number().over(order.window)).withColumn("_n", n)
    if kind == "none":
        share = F.pmod(F.xxhash64(F.lit(seed), *order.by, *order.along), F.lit(1 << 20)) / float(1 << 20)
        part = F.when(share < fraction, "train").otherwise("validation")
    elif kind == "sliding":
        cut = F.floor(F.col("_n") * fraction)
        part = F.when(F.col("_rn") <= cut - window + 1, "train").when((F.col("_rn") > cut) & (F.col("_rn") <= F.col("_n") - window + 1), "validation")
    elif kind == "contiguous":
        windows = F.floor(F.col("_n") / window)
        at = F.floor((F.col("_rn") - 1) / window)
        part = F.when((F.col("_rn") % window == 1 % window) & (at < windows), F.when(at < F.floor(windows * fraction), "train").otherwise("validation"))
    else:
        raise ValueError(f"unknown window kind {kind}")
    return numbered.withColumn("part", part).drop("_rn", "_n")


def downsample(df: DataFrame, order: Order, most: int = 1000) -> DataFrame:
    """Every k-th row of each sequence, so that ``most`` or fewer stay."""
    n = F.count(F.lit(1)).over(order.whole)
    numbered = df.withColumn("_rn", F.row_number().over(order.window)).withColumn("_step", F.ceil(n / most))
    return numbered.filter((F.col("_rn") - 1) % F.col("_step") == 0).drop("_rn", "_step")


def filter_events(events: DataFrame, flight, keyword: str = "", limits: Sequence[float] | None = None, flight_column: str = "flight", tt: str = "tt", text: str = "event") -> DataFrame:
    """Events of a flight within times (all of the flight's by default) whose lower-cased text has the keyword as it is written."""
    keep = (F.col(flight_column) == flight) & F.contains(F.lower(F.col(text)), F.lit(keyword))
    return events.filter(keep & in_time(F.col(tt), limits or ()))


def field_extrema(df: DataFrame, field: str, value, tt: str = "tt") -> DataFrame:
    """Least and greatest time of rows with the value; no row at all gives nulls."""
    return df.filter(F.col(field) == value).agg(F.min(tt).alias("t_min"), F.max(tt).alias("t_max"))


def within_sigma(df: DataFrame, value: str, n_sigma: float = 1.0) -> DataFrame:
    """``easy``: whether a row's value is within n sample deviations of the mean of all."""
    stats = df.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))  # one row
    return df.crossJoin(F.broadcast(stats)).withColumn("easy", F.abs(F.col(value) - F.col("_mean")) <= n_sigma * F.col("_std")).drop("_mean", "_std")
