"""Windowed aggregates of event streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fluxlane.sources.tables import scratch


def counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their summed value by type and window; events later than ``late`` behind the newest are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upserted(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """A stream in update mode run over what there is, kept in ``folder``: the latest row of each key.

    Every batch is a folder of its own, so a batch that runs again replaces what
    it wrote; sources, state and progress are in the folder too, so another call
    goes on from there.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def hourly(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Counts of a table's events by hour, streamed to files in a folder of the shared one."""
    schema = spark.read.parquet(path).schema
    source, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source)
    stream = counts(events).select("event_type", F.unix_seconds("w.start").alias("start"), "n", "total")
    out = upserted(stream, folder or f"{scratch(spark)}/hourly-{uuid.uuid4().hex}", ["event_type", "start"])
    return out.select("event_type", "start", "n", F.round("total", 4).alias("total"))
