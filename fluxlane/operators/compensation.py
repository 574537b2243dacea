"""Compensation models behind one train and one predict: linear ones, networks and both together.

Linear models: TL, mod_TL and map_TL (Tolles-Lawson, with the length of the
field from the vector sensor, a scalar sensor or a map), elasticnet, plsr. Networks: m1 (features
alone), m2a to m2d (with the Tolles-Lawson matrix). Models of the aircraft's
field as a vector, projected on the measured direction, whose coefficients are
trained on from their ridge fit: m3tl (no network), m3s and m3v (with a scalar or
a vector network), m3sc and m3vc (the same by a curriculum), m3w (m3s on windows
of the features), m3tf (a transformer on such windows). All are fitted on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.operators import linear, networks, tolles_lawson
from fluxlane.operators.attention import Transformer
from fluxlane.operators.networks import Phase
from fluxlane.operators.select import Order
from fluxlane.operators.sequence import trailing

LINEAR = ("TL", "mod_TL", "map_TL", "elasticnet", "plsr")
#: Head of each network, and whether coefficients are part of it.
NETWORKS = {"m1": ("plain", False), "m2a": ("dot", False), "m2b": ("plain", True), "m2c": ("plain", True), "m2d": ("dot", True)}
VECTOR_MODELS = ("m3tl", "m3s", "m3v", "m3sc", "m3vc", "m3w", "m3tf")
WINDOWED = ("m3w", "m3tf")
UNIT = ["_u0", "_u1", "_u2"]


@dataclass(frozen=True)
class Params:
    """What a compensation model is made of."""

    kind: str
    features: tuple[str, ...]
    vector: tuple[str, str, str]
    y: str
    terms: tuple[str, ...] = ("permanent", "induced", "eddy")
    total: str | None = None
    ridge: float = 0.025
    components: int = 18
    alpha: float = 0.99
    penalty: float = 0.001
    network: networks.Setup = field(default_factory=networks.Setup)
    #: Rows of a window of m3w and m3tf, attention heads of m3tf, and deviations within which the curriculum begins.
    window: int = 5
    heads: int = 2
    within: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in (*LINEAR, *NETWORKS, *VECTOR_MODELS):
            raise ValueError(f"unknown model {self.kind}")


def _columns(p: Params) -> list[str]:
    return tolles_lawson.columns(p.terms)


def _inputs(p: Params) -> list[str]:
    """Columns that the network reads."""
    return [f"_w{i}_{k}" for i in range(len(p.features)) for k in range(p.window)] if p.kind in WINDOWED else list(p.features)


def _given(p: Params) -> list[str]:
    """Columns that the network's head reads."""
    return [] if p.kind == "m1" else [*(UNIT if p.kind in ("m3v", "m3vc") else []), *_columns(p)]


def _prepared(df: DataFrame, order: Order, p: Params) -> DataFrame:
    total = F.col(p.total) if p.total and p.kind in ("mod_TL", "map_TL") else None
    wide = tolles_lawson.with_matrix(df, order, *p.vector, p.terms, total)
    if p.kind in ("m3v", "m3vc"):
        length = F.sqrt(sum((F.col(c) ** 2 for c in p.vector), F.lit(0.0)))
        wide = wide.withColumns({u: F.coalesce(F.try_divide(F.col(c).cast("double"), length), F.lit(0.0)) for u, c in zip(UNIT, p.vector, strict=True)})
    if p.kind in WINDOWED:
        wide = wide.withColumns({f"_w{i}": trailing(F.col(c).cast("double"), order, p.window) for i, c in enumerate(p.features)})
        wide = wide.withColumns({f"_w{i}_{k}": F.element_at(f"_w{i}", k + 1) for i in range(len(p.features)) for k in range(p.window)})
    return wide


def phases(p: Params) -> tuple[Phase, ...]:
    """What is trained when. A curriculum takes up kinds of coefficients one by one, on rows that they explain, then the network, then all."""
    kinds = [c[0] for c in _columns(p)]
    only = lambda some: tuple(k in some for k in kinds)
    if p.kind == "m2b":
        return (Phase(coef=only("")),)
    if p.kind == "m3tl":
        return (Phase(network=False, applied=False),)
    if p.kind in ("m3sc", "m3vc"):
        alone = [Phase(since, False, False, only(some), p.within) for since, some in ((0.0, "p"), (0.1, "pi"), (0.2, "pie"))]
        return (*alone, Phase(0.3, coef=only("")), Phase(0.6))
    return (Phase(),)


def train(df: DataFrame, order: Order, p: Params, kept: dict | None = None) -> dict:
    """A fitted model: what predict() needs, in numpy. Models that are trained one after the other on one ``df`` may share ``kept`` (``networks.fit``)."""
    wide, a = _prepared(df, order, p), _columns(p)
    if kept is not None and kept.setdefault("of", of := (p.features, p.vector, p.y, p.terms, p.window)) != of:
        raise ValueError("models that share rows must be of the same columns")
    if p.kind in ("TL", "mod_TL", "map_TL"):
        return {"coef": linear.ridge(wide, a, p.y, p.ridge), "bias": 0.0, "on": a}
    if p.kind in ("elasticnet", "plsr"):
        names = [*p.features, *a]
        m = linear.moments(wide, names, p.y)
        if p.kind == "elasticnet":
            coef, bias = linear.elastic_net(m, p.alpha, p.penalty)
        else:
            coef = linear.partial_least_squares(m, min(p.components, len(names)))[-1]
            bias = (m.sum_y - m.sum_x @ coef) / m.n
        return {"coef": coef, "bias": float(bias), "on": names}
    start = None
    if p.kind not in ("m1", "m2a"):
        key = ("ridge", tuple(a), p.vector, p.y, p.ridge)
        start = kept[key] if kept and key in kept else linear.ridge(wide, a, p.y, p.ridge)
        if kept is not None:
            kept[key] = start
    if p.kind in NETWORKS:
        return {"start": np.zeros(len(a)), "fitted": networks.fit(wide, _inputs(p), p.y, p.network, _given(p), NETWORKS[p.kind][0], start, phases(p), kept=kept)}
    # what is trained is a change of the ridge fit, on what that leaves
    left = F.col(p.y) - linear.predict([F.col(c) for c in a], start)
    kind = "dot" if p.kind in ("m3v", "m3vc") else "plain"
    create = partial(Transformer.create, window=p.window, heads=p.heads) if p.kind == "m3tf" else networks.Network.create
    return {"start": start, "fitted": networks.fit(wide, _inputs(p), left, p.network, _given(p), kind, np.zeros(len(a)), phases(p), create, kept)}


def _applied(df: DataFrame, order: Order, p: Params, model: dict, parts: bool) -> DataFrame:
    wide, a = _prepared(df, order, p), _columns(p)
    fitted, inputs, given, out = model["fitted"], _inputs(p), _given(p), [*([f"y_{k}" for k in PARTS.values()] + ["y_network"] if parts else []), "y_hat"]
    own = df.columns
    coef = model["start"] + (fitted.head.coef * fitted.y_scale if len(fitted.head.coef) else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            design, new = b[a].to_numpy(float), {}
            y = design @ model["start"] + fitted(b[inputs].to_numpy(float), b[given].to_numpy(float))
            if parts:
                new = {f"y_{k}": design @ (coef * [c[0] == kind for c in a]) for kind, k in PARTS.items()}
                new["y_network"] = y - sum(new.values())
            yield b[own].assign(**new, y_hat=y)

    wide = wide.select(*own, *[n for n in dict.fromkeys([*inputs, *given, *a]) if n not in own])
    return wide.mapInPandas(run, df.selectExpr("*", *[f"cast(0 as double) as {c}" for c in out]).schema)


#: Kinds of coefficients by their columns' first letter.
PARTS = {"p": "permanent", "i": "induced", "e": "eddy"}


def predict(df: DataFrame, order: Order, p: Params, model: dict) -> DataFrame:
    """``df`` with y_hat. Linear models stay column expressions; networks run on Arrow batches."""
    if "coef" in model:
        wide = _prepared(df, order, p)
        return wide.withColumn("y_hat", linear.predict([F.col(c) for c in model["on"]], model["coef"], model["bias"])).select(*df.columns, "y_hat", F.col(p.y).alias("_y"))
    return _applied(df, order, p, model, False).select(*df.columns, "y_hat", F.col(p.y).alias("_y"))


def explained(df: DataFrame, order: Order, p: Params, model: dict) -> DataFrame:
    """``df`` with y_hat of a model with a network, and its parts: y_permanent, y_induced, y_eddy and y_network, the rest."""
    if "coef" in model:
        raise ValueError(f"{p.kind} has no network")
    return _applied(df, order, p, model, True)


def error(predicted: DataFrame, by: tuple[str, ...]) -> float:
    """Deviation of the errors less their mean on each segment."""
    e = F.col("y_hat") - F.col("_y")
    parts = predicted.groupBy(*by).agg(F.count(e).alias("n"), F.var_pop(e).alias("v"))  # a row a segment; no task holds one whole
    return parts.agg(F.sqrt(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n") - 1))).first()[0] or 0.0


def permutation_importance(df: DataFrame, order: Order, p: Params, model: dict, seed: int = 2) -> list[tuple[str, float]]:
    """Error with each feature shuffled among rows (joined on shuffled row numbers within buckets), least harm first."""
    out = []
    for name in p.features:
        n = F.pmod(F.xxhash64(F.lit(seed), *order.by, *order.along), F.lit(1 << 20))
        # a shuffled copy of one column, matched by rank of two different hashes
        from pyspark.sql import Window

        bucket = F.pmod(F.xxhash64(F.lit(seed + 1), *order.by, *order.along), F.lit(64))
        left = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(n, *order.by, *order.along)))
        right = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 2), *order.by, *order.along)))).select("_b", "_r", F.col(name).alias("_v"))
        shuffled = left.join(right, ["_b", "_r"]).withColumn(name, F.col("_v")).drop("_b", "_r", "_v")
        out.append((name, error(predict(shuffled, order, p, model), order.by)))
    return sorted(out, key=lambda x: x[1])
