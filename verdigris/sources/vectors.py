"""The cache of vector tiles (Parquet by layer, step and tile), and stitching tiles for a zone; GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import box_join

LAYERS = ("height_isolines", "height_polygons", "slope_polygons", "aspect_polygons")


def write_layer(df: DataFrame, folder: str, layer: str, step: float) -> None:
    """Add a layer's tiles (column tile_name) to the cache; other tiles, layers and steps stay."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer: {layer}")
    out = df.withColumns({"layer": F.lit(layer), "step": F.lit(float(step))})
    out.write.mode("append").partitionBy("layer", "step", "tile_name").parquet(folder)


def read_layer(spark: SparkSession, folder: str, layer: str, step: float) -> DataFrame:
    """A layer at a step; the filters are on partition columns, so only its files are listed and read."""
    return spark.read.parquet(folder).filter((F.col("layer") == layer) & (F.col("step") == float(step)))


def tiles_for_zone(tiles: DataFrame, zone: DataFrame, cell: float) -> DataFrame:
    """Tiles (tile_name, x0 .. y1) that touch a zone (bx0 .. by1)."""
    return box_join(tiles, zone.select("bx0", "by0", "bx1", "by1"), cell, "left_semi", left_id="tile_name")


def stitch(spark: SparkSession, folder: str, layer: str, step: float, tiles: DataFrame, zone: DataFrame, cell: float) -> DataFrame:
    """Boxes of a cached layer (x0 .. y1) in the tiles that touch the zone, cut to it. A join on the partition column
    prunes the tiles; a tile that is missing from the cache raises when rows are read."""
    wanted = tiles_for_zone(tiles, zone, cell).select("tile_name")
    cached = read_layer(spark, folder, layer, step)
    have = cached.select("tile_name").distinct().withColumn("there", F.lit(True))
    checked = wanted.join(have, "tile_name", "left").filter(F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("not in the cache: "), F.col("tile_name")))).otherwise(True).cast("boolean"))
    parts = box_join(cached.join(checked.select("tile_name"), "tile_name"), zone.select("bx0", "by0", "bx1", "by1"), cell, predicate="overlaps")
    cut = parts.withColumns({"x0": F.greatest("x0", "bx0"), "y0": F.greatest("y0", "by0"), "x1": F.least("x1", "bx1"), "y1": F.least("y1", "by1")})
    return cut.drop("bx0", "by0", "bx1", "by1")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, type, coordinates as JSON) of the features of GeoJSON files."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")


#: How deep the positions of each type of geometry lie.
_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def positions(kind: Column, coordinates: Column) -> Column:
    """All positions of a geometry, array<array<double>>, from its type and its coordinates as JSON; null for another."""
    out = None
    for name, depth in _DEPTH.items():
        found = F.from_json(coordinates, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        for _ in range(depth - 1):
            found = F.flatten(found)
        found = F.array(found) if depth == 0 else found
        out = F.when(kind == name, found) if out is None else out.when(kind == name, found)
    return out


def geojson_boxes(features: DataFrame) -> DataFrame:
    """(properties, type, n_positions, x0 .. y1) of ``read_geojson``'s features; geometries without a position, and
    collections, have no bounds."""
    known = features.withColumn("_p", F.filter(positions(F.col("type"), F.col("coordinates")), lambda p: p.isNotNull() & (F.size(p) >= 2)))
    x, y = (F.transform("_p", f) for f in (lambda p: p[0], lambda p: p[1]))
    return known.select("properties", "type", F.coalesce(F.when(F.col("_p").isNotNull(), F.size("_p")), F.lit(0)).alias("n_positions"), F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def read_tile_index(spark: SparkSession, path: str, name: str = "file_name") -> DataFrame:
    """(tile_name, x0 .. y1) of a tile index in GeoJSON; ``name`` is the property with a tile's file. Features without
    a name or bounds are no tiles; a tile of several features has the bounds of all."""
    found = geojson_boxes(read_geojson(spark, path)).select(F.col("properties")[name].alias("tile_name"), "x0", "y0", "x1", "y1").dropna()
    return found.groupBy("tile_name").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
