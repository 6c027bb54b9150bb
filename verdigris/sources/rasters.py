"""Which raster files belong to which tiles: by name, however written, and by the patterns of flood and soil sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tile_key

#: Soil variables, in the order of their parts, and the return periods of flood rasters in years (fixed values).
SOIL_VARIABLES = ("clay", "silt", "sand", "cfvo")
RETURN_PERIODS = (10, 20, 50, 75, 100, 200, 500)


def find_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file_name, path) of each wanted file, among ``files`` (path, file_name): of those of one name, whatever its
    case, else of one tile, however written, the first path. A file that isn't there has a null path."""
    exact = files.groupBy(F.lower("file_name").alias("k")).agg(F.min("path").alias("exact"))
    alike = files.groupBy(tile_key(F.col("file_name")).alias("t")).agg(F.min("path").alias("alike"))
    keyed = wanted.select("file_name").distinct().withColumns({"k": F.lower("file_name"), "t": tile_key(F.col("file_name"))})
    return keyed.join(exact, "k", "left").join(alike, "t", "left").select("file_name", F.coalesce("exact", "alike").alias("path"))


def flood_files(tiles: DataFrame, files: DataFrame, periods: tuple[int, ...] = RETURN_PERIODS) -> DataFrame:
    """(id, period, path): for each tile (id) and return period the first of its rasters; tiles without one are left out."""
    label = F.regexp_extract("path", r"/ID(\d+)_[^/]*_RP(\d+)_depth\.tif$", 2)
    found = files.withColumns({"id": F.regexp_extract("path", r"/ID(\d+)_[^/]*_RP(\d+)_depth\.tif$", 1).try_cast("long"), "period": label.try_cast("int")})
    found = found.filter(F.col("period").isin(*periods)).groupBy("id", "period").agg(F.min("path").alias("path"))
    return tiles.select("id").distinct().join(found, "id")


def soil_files(tiles: DataFrame, files: DataFrame, depth: str) -> DataFrame:
    """(tile_name, variable, path) of the four variables of each tile at a depth; one that is missing raises when read."""
    pattern = rf"([^/]+)/(\w+)/(\w+)_{depth}_mean\.tif$"
    found = files.select(F.regexp_extract("path", pattern, 1).alias("tile_name"), F.regexp_extract("path", pattern, 2).alias("variable"), "path")
    every = tiles.select("tile_name").distinct().withColumn("variable", F.explode(F.array(*map(F.lit, SOIL_VARIABLES))))
    missing = F.raise_error(F.concat(F.lit("no soil raster: "), F.col("tile_name"), F.lit(" "), F.col("variable")))
    first = found.groupBy("tile_name", "variable").agg(F.min("path").alias("path"))
    return every.join(first, ["tile_name", "variable"], "left").withColumn("path", F.coalesce("path", missing))


def soil_pixels(files: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_name, row, col, x, y, x_min, y_max, size_x, size_y, clay, silt, sand, cfvo) from the files of ``soil_files`` and the decoded ``tiles``
    (path, height, width and values) behind them; rasters of one tile that differ in shape raise when read."""
    of = files.join(tiles, "path")
    shapes = of.groupBy("tile_name").agg(F.countDistinct("height", "width").alias("shapes"))
    unequal = F.raise_error(F.concat(F.lit("rasters of different shape: "), F.col("tile_name")))
    fits = F.when(F.col("shapes") == 1, True).otherwise(unequal.cast("boolean"))
    cells = of.join(shapes, "tile_name").filter(fits).select("tile_name", "variable", "x_min", "y_max", "size_x", "size_y", "width", F.posexplode("values").alias("pos", "value"))
    row, col = F.call_function("div", F.col("pos"), F.col("width")).cast("int"), (F.col("pos") % F.col("width")).cast("int")
    cells = cells.withColumns({"row": row, "col": col})
    values = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in SOIL_VARIABLES]
    place = [F.first(F.col("x_min") + F.col("col") * F.col("size_x")).alias("x"), F.first(F.col("y_max") - F.col("row") * F.col("size_y")).alias("y")]
    place += [F.first(c).alias(c) for c in ("x_min", "y_max", "size_x", "size_y")]
    return cells.groupBy("tile_name", "row", "col").agg(*place, *values)


def tile_ids(tiles: DataFrame, name: str = "id") -> DataFrame:
    """The distinct ids of tiles, rising; null ids are none."""
    return tiles.select(name).dropna().distinct().orderBy(name)
