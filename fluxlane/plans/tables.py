"""The test tables as survey data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.operators.select import Order

#: How the signal's rows follow one another.
SIGNAL = Order(("line",), ("tt", "event_id"))
SIGNAL_SQL = "sig AS (SELECT user_id AS line, epoch_us(ts) / 1e6 AS tt, event_id, event_type, value FROM events)"
ROWS_SQL = SIGNAL_SQL + ", w AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY tt, event_id) AS rn, count(*) OVER (PARTITION BY line) AS n FROM sig)"
#: Vector sensor and features.
VECTOR = Order(("line",), ("vec_id",))
VECTOR_SQL = (
    "vec AS (SELECT label AS line, vec_id, CAST(embedding[1] AS DOUBLE) * 50000 AS vx, CAST(embedding[2] AS DOUBLE) * 50000 AS vy, CAST(embedding[3] AS DOUBLE) * 50000 AS vz, CAST(embedding[4] AS DOUBLE) AS mag,"
    " CAST(embedding[5] AS DOUBLE) AS f1, CAST(embedding[6] AS DOUBLE) AS f2, CAST(embedding[7] AS DOUBLE) AS f3 FROM embeddings)"
)
GRID_SQL = (
    "grid AS (SELECT CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INTEGER) AS iy, CAST(o_custkey % 40 AS INTEGER) AS ix, avg(o_totalprice) + 3e-8 AS raw FROM orders GROUP BY 1, 2),"
    " cells AS (SELECT iy, ix, iy * 0.5::DOUBLE AS yy, ix * 0.25::DOUBLE AS xx, CASE WHEN (iy * 7 + ix * 3) % 11 = 0 THEN 0.0 ELSE raw END AS val FROM grid)"
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tt = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("line"), tt.alias("tt"), "event_id", "event_type", "value")


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    return load(spark, sf_dir, "embeddings").select(
        F.col("label").alias("line"), "vec_id", (e(1) * 50000).alias("bx"), (e(2) * 50000).alias("by"), (e(3) * 50000).alias("bz"), e(4).alias("mag"), e(5).alias("f1"), e(6).alias("f2"), e(7).alias("f3")
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' mean price by month (rows) and customer (columns); every eleventh cell or so is missing.

    The small offset keeps means off the ties of later rounding.
    """
    day = F.col("o_orderdate")
    iy = ((F.year(day) - 1992) * 12 + F.month(day) - 1).cast("int")
    cells = load(spark, sf_dir, "orders").groupBy(iy.alias("iy"), (F.col("o_custkey") % 40).cast("int").alias("ix")).agg((F.avg("o_totalprice") + 3e-8).alias("raw"))
    val = F.when((F.col("iy") * 7 + F.col("ix") * 3) % 11 == 0, 0.0).otherwise(F.col("raw"))
    return cells.select(F.lit("orders").alias("map_name"), "iy", "ix", (F.col("iy") * 0.5).alias("yy"), (F.col("ix") * 0.25).alias("xx"), val.alias("val"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0 made 0, so that engines agree."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
