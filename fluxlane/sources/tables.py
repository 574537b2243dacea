"""Readers and writers of survey data."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANGLES = ("lat", "lon", "roll", "pitch", "yaw", "ins_lat", "ins_lon", "ins_roll", "ins_pitch", "ins_yaw")


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables of a job: spark.checkpoint.dir, or, on a local master only, one of our own."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="fluxlane-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_xyz_text(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Rows of a white-space separated text survey: lines with exactly the fields' number of tokens; ``*`` is NaN."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).select(tokens.alias("t")).filter(F.size("t") == len(fields))
    number = lambda i: F.when(F.col("t")[i] == "*", F.lit(float("nan"))).otherwise(F.expr(f"try_cast(t[{i}] as double)"))
    return rows.select(*[number(i).alias(n) for i, n in enumerate(fields)]).filter(F.col(fields[0]).isNotNull())


def keep_lines(df: DataFrame, lines: Sequence[tuple[float, float, float]], exclude: bool = False, line: str = "line", tt: str = "tt") -> DataFrame:
    """Rows of any (line, first, last time), or those of none."""
    keep = F.lit(False)
    for n, a, b in lines:
        keep |= (F.col(line) == n) & F.col(tt).between(a, b)
    return df.filter(~keep if exclude else keep)


def read_flight_csv(spark: SparkSession, path: str, fields: Sequence[str], degrees: Sequence[str] = ANGLES) -> DataFrame:
    """A flight from a CSV file with a header: absent fields become NaN, angles radians."""
    raw = spark.read.option("header", True).csv(path)
    cell = lambda n: F.col(n).cast("double") if n in raw.columns else F.lit(float("nan"))
    return raw.select(*[(F.radians(cell(n)) if n in degrees else cell(n)).alias(n) for n in fields])


def read_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table (lines, flights, maps, events) with a row number for its order.

    Such tables are small; a byte order mark in front of the header is taken off.
    """
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return clean.withColumn("row", F.monotonically_increasing_id())


def read_map_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A map of files map.csv, xx.csv, yy.csv and alt.csv (degrees, metres) as a long grid in radians."""
    axis = lambda f: [float(r[0]) for r in spark.read.csv(f"{folder}/{f}.csv").collect()]  # noqa: E731  one map's axes
    xx, yy, alt = axis("xx"), axis("yy"), axis("alt")
    rows = spark.read.text(f"{folder}/map.csv", wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\r\n ")), "\r?\n")).alias("iy", "row"))
    cells = rows.select("iy", F.posexplode(F.split("row", ",")).alias("ix", "val"))
    at = lambda values, i: F.radians(F.element_at(F.array(*[F.lit(v) for v in values]), F.col(i) + 1))
    return cells.select(F.lit(name).alias("map_name"), "iy", "ix", at(yy, "iy").alias("yy"), at(xx, "ix").alias("xx"), F.lit(alt[0]).alias("alt"), F.expr("coalesce(nanvl(try_cast(trim(val) as double), 0D), 0D)").alias("val"))


def write_grid(grid: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A map as Parquet, one folder a map, so that reads of one map leave out the others."""
    grid.write.mode(mode).partitionBy("map_name").parquet(path)


def read_grid(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    grid = spark.read.parquet(path)
    return grid if name is None else grid.filter(F.col("map_name") == name)


def with_fields(df: DataFrame, fields: Sequence[str], default: float | str = float("nan")) -> DataFrame:
    """``df`` with absent fields filled with a default."""
    return df.withColumns({f: F.lit(default) for f in fields if f not in df.columns})


def has_fields(df: DataFrame, fields: dict[str, str]) -> None:
    """An error if a field is absent or of another type."""
    types = dict(df.dtypes)
    if wrong := [f"{n} {t}" for n, t in fields.items() if types.get(n) != t]:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")


def compare_fields(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """field and difference: summed magnitude of what differs between two tables, in each number field; a row that only one has counts as infinite."""
    names = [n for n, t in a.dtypes if n not in keys and n in b.columns and t in ("double", "float", "int", "bigint")]
    both = a.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names], F.lit(1).alias("_b")), list(keys), "full")
    gap = lambda n: F.sum(F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")).cast("double"), F.lit(0.0))))
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"d_{n}").alias("difference")) for n in names])
    return both.agg(*[gap(n).alias(f"d_{n}") for n in names]).select(F.inline(cells))


def without_extension(name: str, extension: str) -> str:
    return re.sub(re.escape(extension) + "$", "", name, flags=re.I)


def with_extension(name: str, extension: str) -> str:
    return without_extension(name, extension) + extension


def save_model(spark: SparkSession, params: dict, path: str) -> None:
    """Model parameters as JSON text, by Spark's writer, so any store that Spark knows will do."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True, default=lambda v: v.tolist()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """Parameters saved by save_model; those that are absent take their defaults."""
    return (defaults or {}) | json.loads(spark.read.text(path).first()[0])


def path_kml(path: DataFrame, along: Sequence[str], name: str = "path", most: int = 30_000) -> str:
    """A KML document of a path in radians and metres; rows are strided to ``most`` or fewer before they leave the cluster."""
    from fluxlane.operators.select import Order, downsample

    one = path.withColumn("_path", F.lit(1))
    rows = downsample(one, Order(("_path",), tuple(along)), most).orderBy(*along).select(F.degrees("lon"), F.degrees("lat"), "alt").collect()
    points = " ".join(f"{a:.7f},{b:.7f},{c:.2f}" for a, b, c in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>{name}</name><LineString><altitudeMode>absolute</altitudeMode><coordinates>{points}</coordinates></LineString></Placemark></Document></kml>\n'
