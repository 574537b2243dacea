"""The Kalman filter on a stream: state by line, one sample after the other."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.operators import navigation as nav
from fluxlane.operators.grid import Interpolant

OUT = "line long, tt double, d_lat double, d_lon double, bias double, residual double"


def filtered(samples: DataFrame, surface: Interpolant, m: nav.Model, idle_ms: int | None = None) -> DataFrame:
    """Filter outputs of a streaming frame with line, tt, MOTION's columns, cnb and z.

    The state of a line (x, P, time, latest residuals) is kept between batches.
    Samples of a batch are taken in order of time; one that isn't later than the
    line's last is skipped. Lines of 64 neighbouring numbers share one state of the
    stream and step together. With ``idle_ms``, each line has its own, which goes when
    the line has no samples for that long, and later samples of it begin anew.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        if idle_ms is not None:
            rows = rows.assign(line=key[0])
        rows = rows.sort_values(["line", "tt"], kind="stable")
        line, motion = rows["line"].to_numpy(), rows[list(nav.MOTION)].to_numpy(float)
        known, kept = pickle.loads(state.get[0]) if state.exists else (line[:0], None)
        # null lines are one line too
        starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) & ~(pd.isna(line[1:]) & pd.isna(line[:-1]))]))
        sizes, s = np.diff(np.append(starts, len(line))), nav.State.new(m, motion[starts, 0])
        old = pd.Index(known).get_indexer(line[starts])
        if (old >= 0).any():
            s.put(old >= 0, kept.rows(old[old >= 0]))
        taken, xs, _, rs = nav.filter_later(s, sizes, rows["tt"].to_numpy(float), motion, np.stack(rows["cnb"].to_numpy()).astype(float).reshape(-1, 3, 3), rows["z"].to_numpy(float), surface, m, full=False)
        idle = np.setdiff1d(np.arange(len(known)), old)
        if len(idle):
            s = s + kept.rows(idle)
        state.update((pickle.dumps((np.concatenate([line[starts], known[idle]]), s)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"line": line[taken], "tt": rows["tt"].to_numpy(float)[taken], "d_lat": xs[:, 0], "d_lon": xs[:, 1], "bias": xs[:, -1], "residual": rs})

    schema, mode = "state binary", "append"
    if idle_ms is not None:
        return samples.groupBy("line").applyInPandasWithState(run, OUT, schema, mode, "ProcessingTimeTimeout")
    return samples.withColumn("_lines", F.shiftright("line", 6)).groupBy("_lines").applyInPandasWithState(run, OUT, schema, mode, "NoTimeout")


def filter_stream(samples: DataFrame, surface: Interpolant, m: nav.Model) -> DataFrame:
    """A table run through the streaming filter: written to the shared folder, streamed from there to files beside it."""
    from fluxlane.sources.tables import scratch

    spark = samples.sparkSession
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    samples.write.parquet(f"{folder}/in")
    stream = filtered(spark.readStream.schema(samples.schema).parquet(f"{folder}/in"), surface, m)
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
