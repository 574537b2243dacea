"""Flights with what their files leave out: time, velocities, specific forces, attitude and field totals.

A field that is absent, or null or NaN in any row of a sequence, is derived for
the whole sequence, so that no line mixes measured with derived values. All
derivations share the sequence's order, hence one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators.select import Order
from fluxlane.operators.sequence import difference

#: Degrees that a level flight's nose is up, where a file has no attitude.
LEVEL_PITCH = 2.0


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") if n in df.columns else F.lit(None).cast("double") for n in names})


def _lacks(names: Sequence[str], order: Order) -> Column:
    """Whether any of the fields lacks a value in any row of the sequence."""
    gap = [F.col(n).isNull() | F.isnan(n) for n in names]
    return F.max(F.greatest(*gap) if len(gap) > 1 else gap[0]).over(order.whole)


def _derived(df: DataFrame, order: Order, values: dict[str, Column]) -> DataFrame:
    """``values`` in place of fields of which one has a gap."""
    names = list(values)
    flagged = df.withColumn("_gap", _lacks(names, order)).withColumns({f"_new_{n}": v for n, v in values.items()})
    return flagged.withColumns({n: F.when(F.col("_gap"), F.col(f"_new_{n}")).otherwise(F.col(n)) for n in names}).drop("_gap", *[f"_new_{n}" for n in names])


def with_motion(df: DataFrame, order: Order, dt: float = 0.1, prefix: str = "") -> DataFrame:
    """``df`` with tt, vn, ve, vd, fn, fe, fd and cnb of a trajectory with lat, lon (radians) and alt.

    Time: steps of ``dt`` from 0; a sequence with times has the step between its
    first two. Velocities: central differences of the place in the UTM zone of
    the sequence's mean. Forces: differences of velocities, less gravity
    downwards. cnb (rows of body-to-navigation): of roll, pitch and yaw, or else
    of a level flight that heads where it moves. ``prefix``: of all the fields
    (``ins_``). A sequence of fewer than three rows doesn't move.
    """
    name = lambda n: f"{prefix}{n}"
    motion = [name(n) for n in ("vn", "ve", "vd", "fn", "fe", "fd", "tt", "roll", "pitch", "yaw")]
    vn, ve, vd, fn, fe, fd, tt, roll, pitch, yaw = motion
    w, extra = order.window, [n for n in (roll, pitch, yaw) if n not in df.columns]
    out = _numbers(df, motion).withColumn("_rn", F.row_number().over(w))
    out = _derived(out, order, {tt: F.round((F.col("_rn") - 1) * dt, 9)})
    step = F.round(F.max(F.when(F.col("_rn") == 2, F.col(tt))).over(order.whole) - F.max(F.when(F.col("_rn") == 1, F.col(tt))).over(order.whole), 9)
    out = out.withColumns({"_dt": step, "_zone": geodesy.utm_zone(F.avg(name("lon")).over(order.whole))})
    east, north = geodesy.to_utm(F.col(name("lat")), F.col(name("lon")), F.col("_zone"))
    # one false northing or none for the whole sequence, also where it crosses the equator
    north = north - F.when(F.col(name("lat")) < 0, geodesy.UTM_NORTH).otherwise(0.0)
    out = out.withColumns({"_e": east, "_n": north, "_u": F.col(name("alt")).cast("double")})
    rate = lambda c: F.coalesce(F.try_divide(difference(F.col(c), order), F.col("_dt")), F.lit(0.0))
    out = _derived(out, order, {vn: rate("_n"), ve: rate("_e"), vd: -rate("_u")})
    out = _derived(out, order, {fn: rate(vn), fe: rate(ve), fd: rate(vd) - geodesy.GRAVITY})
    out = _derived(out, order, {roll: F.lit(0.0), pitch: F.lit(0.0) + F.radians(F.lit(LEVEL_PITCH)), yaw: F.atan2(ve, vn)})
    turned = F.flatten(F.array(*[F.array(*row) for row in geodesy.body_to_nav(F.col(roll), F.col(pitch), F.col(yaw))]))
    cnb = name("cnb")
    if cnb in df.columns:
        turned = F.when(F.max(F.col(cnb).isNull() | F.coalesce(F.exists(cnb, lambda v: v.isNull() | F.isnan(v)), F.lit(False))).over(order.whole), turned).otherwise(F.col(cnb))
    return out.withColumn(cnb, turned).drop("_rn", "_dt", "_zone", "_e", "_n", "_u", *extra)


def with_total(df: DataFrame, order: Order, x: str, y: str, z: str, total: str) -> DataFrame:
    """``df`` with a vector sensor's total: recomputed over a sequence in which one is missing."""
    out = _numbers(df, [x, y, z, total])
    return _derived(out, order, {total: F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + F.col(z) ** 2)})
