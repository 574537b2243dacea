"""A store of map levels, continued once and read by partition.

A point takes the highest map that lies at its altitude or below and has data around
the point, else the fallback; and of that map the level at its altitude rounded
down to a multiple of ``dz`` (never below the map itself). Levels that points ask
for and the store lacks are continued from their map, turned into spline coefficients
and written, a folder a map and level. Points then read just the folders of the
levels they ask for. Maps are few; each has axes of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.operators import grid as g
from fluxlane.operators import spectral, spline


@dataclass(frozen=True)
class MapCache:
    """Maps (map_name, alt, one altitude each, and cells), the name of the fallback among them, and where levels are stored."""

    maps: DataFrame
    fallback: str
    folder: str
    dz: float = 100.0

    def heights(self) -> list[tuple[float, str]]:
        """Altitude and name of each map, by altitude."""
        return sorted((r.alt, r.map_name) for r in self.maps.select("alt", "map_name").distinct().collect())  # a row a map

    def _map(self, name: str) -> DataFrame:
        return self.maps.filter(F.col("map_name") == name)

    def placed(self, points: DataFrame, x: str = "lon", y: str = "lat", z: str = "alt") -> DataFrame:
        """``points`` with map_name and level."""
        level = lambda alt: F.greatest(F.floor(F.col(z) / self.dz) * self.dz, F.lit(float(alt)))
        heights = self.heights()
        base = next(alt for alt, name in heights if name == self.fallback)
        out = points.withColumns({"map_name": F.lit(self.fallback), "level": level(base)})
        for alt, name in heights:
            if name == self.fallback:
                continue
            cells = self._map(name)
            out = g.on_data(out, cells, g.axes(cells), x, y, "_on")
            serves = F.col("_on") & (F.col(z) >= alt)
            out = out.withColumns({"map_name": F.when(serves, name).otherwise(F.col("map_name")), "level": F.when(serves, level(alt)).otherwise(F.col("level"))}).drop("_on")
        # a point without an altitude has no level
        known = F.col(z).isNotNull()
        return out.withColumns({"map_name": F.when(known, F.col("map_name")), "level": F.when(known, F.col("level"))})

    def stored(self) -> set[tuple[str, float]]:
        """Map and level of each folder of the store."""
        spark = self.maps.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return set()
        rows = spark.read.schema("iy int, ix int, coef double, map_name string, level double").parquet(self.folder)
        return {(r.map_name, r.level) for r in rows.select("map_name", "level").distinct().collect()}  # a row a folder

    def fill(self, placed: DataFrame) -> list[tuple[str, float]]:
        """Continue and store the levels that ``placed`` asks for and the store lacks; which they were."""
        asked = {(r.map_name, r.level) for r in placed.select("map_name", "level").distinct().collect() if r.map_name is not None}  # a row a level
        new = sorted(asked - self.stored())
        for name in sorted({n for n, _ in new}):
            levels = [level for n, level in new if n == name]
            stack = spectral.continue_map(self._map(name), levels).withColumnRenamed("alt", "level")
            table = spline.coefficient_table(stack, "cubic", ["map_name", "level"])
            # a folder appears whole or not at all
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("map_name", "level").parquet(self.folder)
        return new

    def values(self, points: DataFrame, x: str = "lon", y: str = "lat", z: str = "alt", out: str = "map_val") -> DataFrame:
        """``points`` with map_name, level and the level's value there, null off the map; fills the store first."""
        placed = self.placed(points, x, y, z)
        self.fill(placed)
        rows = placed.sparkSession.read.schema("iy int, ix int, coef double, map_name string, level double").parquet(self.folder)
        parts = [placed.filter(F.col("map_name").isNull()).withColumn(out, F.lit(None).cast("double"))]
        asked = [r[0] for r in placed.select("map_name").distinct().collect() if r[0] is not None]  # a row a map
        for name in sorted(asked):
            mine: Column = F.col("map_name") == name
            parts.append(spline.lookup(placed.filter(mine), rows.filter(mine).drop("map_name"), g.axes(self._map(name)), "cubic", x, y, out, ["level"]))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole
