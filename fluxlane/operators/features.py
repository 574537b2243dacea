"""Feature matrices and targets, assembled as columns of one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.functions import geodesy
from fluxlane.operators import tolles_lawson
from fluxlane.operators.select import Order, select_by_lookup
from fluxlane.operators.sequence import bandpass, difference, lagged


@dataclass(frozen=True)
class Setup:
    """Which columns the features are made of.

    ``scalars`` and ``vectors``: feature name -> column(s); ``attitude``: roll,
    pitch, yaw; ``subtract``: corrections taken off the scalars; ``currents``
    are low-passed as lpf_<name>; ``bandpassed``: scalars are band-passed.
    """

    scalars: dict[str, str] = field(default_factory=dict)
    vectors: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    attitude: tuple[str, str, str] | None = None
    subtract: tuple[str, ...] = ()
    currents: tuple[str, ...] = ()
    terms: tuple[str, ...] = ("permanent", "induced", "eddy")
    scale: float = tolles_lawson.SCALE
    bandpassed: bool = False
    cutoff: float = 0.2


def attitude_features(roll: Column, pitch: Column, yaw: Column) -> dict[str, Column]:
    """Products of sines and cosines by name: c and s, then r, p or y, for two or three angles."""
    one = {f"{n}{a}": f(v) for a, v in (("r", roll), ("p", pitch), ("y", yaw)) for n, f in (("c", F.cos), ("s", F.sin))}
    out = {}
    for angles in (("r", "p"), ("r", "y"), ("p", "y"), ("r", "p", "y")):
        combos = [""]
        for a in angles:
            combos = [c + k + a for c in combos for k in "cs"]
        for name in combos:
            parts = [one[name[i : i + 2]] for i in range(0, len(name), 2)]
            value = parts[0]
            for p in parts[1:]:
                value = value * p
            out[name] = value
    return out


def registry(order: Order, s: Setup) -> dict[str, list[tuple[str, Column]]]:
    """What each feature name expands to, without Tolles-Lawson columns; nothing is computed here."""
    out: dict[str, list[tuple[str, Column]]] = {}
    corrected = {}
    for name, column in s.scalars.items():
        v = F.col(column)
        for c in s.subtract:
            v = v - F.col(c)
        corrected[name] = v
        out[name] = [(name, F.col(f"_bp_{name}") if s.bandpassed else v)]
        out[f"{name}_dot"] = [(f"{name}_dot", difference(v, order))]
        out[f"{name}_dot4"] = [(f"{name}_dot4", difference(v, order, "fourth"))]
        for k in (1, 2, 3):
            out[f"{name}_lag_{k}"] = [(f"{name}_lag_{k}", lagged(v, order, k))]
    for (i, a), (j, b) in combinations(enumerate(s.scalars, 1), 2):
        # differences of sensors need no correction
        out[f"mag_{i}_{j}"] = [(f"mag_{i}_{j}", F.col(s.scalars[a]) - F.col(s.scalars[b]))]
    if s.attitude:
        angles = [F.col(c) for c in s.attitude]
        nav = geodesy.nav_to_body(*angles)
        cells = [(f"dcm_{1 + i + 3 * j}", nav[i][j]) for j in range(3) for i in range(3)]
        out |= {"dcm": cells} | {n: [(n, c)] for n, c in cells} | {n: [(n, c)] for n, c in attitude_features(*angles).items()}
        for name, v in zip(("roll", "pitch", "yaw"), angles, strict=True):
            made = {"fdm": difference(v, order), "sin": F.sin(v), "cos": F.cos(v), "sin_fdm": difference(F.sin(v), order), "cos_fdm": difference(F.cos(v), order)}
            out |= {f"{name}_{k}": [(f"{name}_{k}", c)] for k, c in made.items()}
    out |= {f"lpf_{c}": [(f"lpf_{c}", F.col(f"_lp_{c}"))] for c in s.currents}
    return out


def matrix(df: DataFrame, order: Order, wanted: Sequence[str], s: Setup) -> tuple[DataFrame, list[str]]:
    """(``df`` with the wanted features beside its columns, their expanded names).

    Only wanted features are built. Columns of ``df`` count as features too;
    any other name is an error. Derivatives and lags stay within a sequence.
    """
    known = registry(order, s)
    lows = [n.removeprefix("lpf_") for n in wanted if n in known and n.startswith("lpf_")]
    if lows:
        df = bandpass(df.withColumns({f"_lp_{c}": F.col(c) for c in lows}), order, [f"_lp_{c}" for c in lows], -1, s.cutoff)
    if s.bandpassed and (bands := [n for n in wanted if n in s.scalars]):
        values = {}
        for n in bands:
            v = F.col(s.scalars[n])
            for c in s.subtract:
                v = v - F.col(c)
            values[f"_bp_{n}"] = v
        df = bandpass(df.withColumns(values), order, list(values))
    names: list[str] = []
    made: dict[str, Column] = {}
    for n in wanted:
        if n.startswith("TL_A_") and (vec := n.removeprefix("TL_A_")) in s.vectors:
            cols = tolles_lawson.columns(s.terms)
            df = tolles_lawson.with_matrix(df, order, *s.vectors[vec], s.terms, scale=s.scale).withColumnsRenamed({c: f"{n}_{c}" for c in cols})
            names += [f"{n}_{c}" for c in cols]
        elif n in known:
            made |= dict(known[n])
            names += [c for c, _ in known[n]]
        elif n in df.columns:
            names.append(n)
        else:
            raise ValueError(f"unknown feature {n}")
    return df.withColumns(made) if made else df, names


def assert_complete(df: DataFrame, names: Sequence[str]) -> None:
    """An error if any feature has NaN or null somewhere; one aggregate finds all."""
    bad = df.agg(*[F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(c) for c in names]).first()
    if wrong := [c for c in names if bad[c]]:
        raise ValueError(f"NaN in features {wrong}")


def target(kind: str, uncompensated: Column, truth: Column, subtract: Sequence[Column] = ()) -> Column:
    """a: sensor in the aircraft less the truth (a map or clean sensor), corrected; b: as a, for a map; c: sensor less map and corrections; d: truth less sensor; e: the sensor, to be band-passed."""
    total = uncompensated - truth
    for c in subtract:
        total = total - c
    if kind in ("a", "b", "c"):
        return total
    if kind == "d":
        return truth - uncompensated
    if kind == "e":
        return uncompensated
    raise ValueError(f"unknown target {kind}")


def assemble(flights: DataFrame, lookup: DataFrame, lines: Sequence, order: Order, wanted: Sequence[str], s: Setup, y: Column, number: str = "row") -> tuple[DataFrame, list[str]]:
    """Features, target ``y`` and segment lengths ``n_seg`` of the lines of a lookup table, in one plan."""
    rows = select_by_lookup(flights, lookup, lines, number)
    out, names = matrix(rows.withColumn("y", y), order, wanted, s)
    return out.withColumn("n_seg", F.count(F.lit(1)).over(order.whole)), names


def correlation(df: DataFrame, by: tuple[str, ...], x: str, y: str, least: float = 0.0) -> DataFrame:
    """corr and the slope through the origin of each group; groups of weaker correlation are left out."""
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(F.corr(a, b).alias("corr"), (F.sum(a * b) / F.sum(a * a)).alias("slope")).filter(F.abs("corr") > least)


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature_1, feature_2 and corr of all pairs, from one aggregate."""
    pairs = list(combinations(names, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.corr(a, b).alias("corr")) for a, b in pairs])
    return df.agg(cells.alias("_c")).select(F.inline("_c"))


def importance(effects: DataFrame) -> DataFrame:
    """Mean magnitude of the effect of each feature, greatest first."""
    return effects.groupBy("feature").agg(F.avg(F.abs("effect")).alias("importance")).orderBy(F.desc("importance"))
