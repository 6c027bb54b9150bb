"""From raster tiles to classed polygons: heights, slopes, aspects, soil and flood depth."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..geometry import contours, wkb
from ..tables import shared_table
from .raster import gradient, smooth_array, smooth_directions
from .regions import pixel_regions, zone_regions

SCHEMA = "tile string, value double, geom binary, error string, elapsed_sec double"


def _grid(row) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in row["values"]], float).reshape(int(row["height"]), int(row["width"]))


def _placed(row, xy: np.ndarray) -> np.ndarray:
    return np.stack([row["x_min"] + xy[:, 0] * row["size_x"], row["y_max"] - xy[:, 1] * row["size_y"]], 1)


def _vectorise(tiles: DataFrame, kernel: Callable[[np.ndarray, dict], list[tuple[float, bytes]]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                began = time.time()
                try:
                    if row["error"]:
                        raise ValueError(row["error"])
                    out = [(row["tile"], v, g, None) for v, g in kernel(_grid(row), row)]
                except Exception as e:  # one tile's failure is a row of the result, not the end of the job
                    out = [(row["tile"], None, None, "".join(traceback.format_exception(e)))]
                took = round(time.time() - began, 3)
                yield pd.DataFrame([(*r, took) for r in out], columns=["tile", "value", "geom", "error", "elapsed_sec"])

    return tiles.mapInPandas(run, SCHEMA)


def _bands(values: np.ndarray, row: dict, levels: list[float]) -> list[tuple[float, bytes]]:
    by_value: dict[float, list] = {}
    for value, face in contours.bands(values, levels):
        if np.isfinite(value):
            by_value.setdefault(value, []).append(face)
    return [(v, wkb.from_polygons([[_placed(row, r) for r in f] for f in faces])) for v, faces in sorted(by_value.items())]


def _steps(values: np.ndarray, step: float) -> list[float]:
    lo, hi = np.floor(np.nanmin(values) / step), np.ceil(np.nanmax(values) / step)
    return [float(k * step) for k in np.arange(lo, hi + 1)]


def height_polygons(tiles: DataFrame, step: float = 1.0, sigma: float = 0.0) -> DataFrame:
    """(tile, value, geom, error): the area of each height class; one row for each class of a tile."""
    def kernel(values, row):
        q = np.rint(smooth_array(values, sigma) / step) * step
        return _bands(np.where(np.isfinite(q), q, -9999.0), row, _steps(q, step)) if np.isfinite(q).any() else []

    return _vectorise(tiles, kernel).filter("value IS NULL OR value > -9999")


def height_isolines(tiles: DataFrame, step: float = 1.0, sigma: float = 0.0) -> DataFrame:
    """The level lines of each whole step, as lines."""
    def kernel(values, row):
        v = smooth_array(values, sigma)
        if not np.isfinite(v).any():
            return []
        return [(k, wkb.dumps(wkb.LINE, [_placed(row, line)])) for k in _steps(v, step) for line in contours.lines(contours.level_segments(v, k + 1e-9))]

    return _vectorise(tiles, kernel)


def _gradient(values: np.ndarray, row: dict, metres: bool) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = row["size_x"], row["size_y"]
    if not metres:  # degrees: the size of a pixel at the tile's middle
        from ..geometry.projection import to_utm, utm_srid

        lon, lat = row["x_min"] + dx * row["width"] / 2, row["y_max"] - dy * row["height"] / 2
        m = to_utm(np.array([[lon, lat], [lon + dx, lat], [lon, lat + dy]]), utm_srid(lon, lat))
        dx, dy = float(np.hypot(*(m[1] - m[0]))), float(np.hypot(*(m[2] - m[0])))
    gy, gx = np.gradient(values, dy, dx)
    return gx, gy


def slope_polygons(tiles: DataFrame, step: float = 1.0, sigma: float = 1.0, metres: bool = False) -> DataFrame:
    """Areas of each slope class of at least one step, in degrees."""
    def kernel(values, row):
        gx, gy = _gradient(values, row, metres)
        q = np.rint(smooth_array(np.degrees(np.arctan(np.hypot(gx, gy))), sigma) / step) * step
        q = np.where(q < step, np.nan, q)
        if not np.isfinite(q).any():
            return []
        low = np.where(np.isfinite(q), q, np.nanmin(q) - 9999)
        return [(v, g) for v, g in _bands(low, row, _steps(q, step)) if v >= step]

    return _vectorise(tiles, kernel)


def aspect_polygons(tiles: DataFrame, step: float = 90.0, sigma: float = 0.0, metres: bool = False, labels: bool = True) -> DataFrame:
    """Areas of each direction class, with its wind name."""
    def kernel(values, row):
        gx, gy = _gradient(values, row, metres)
        a = np.mod(np.degrees(np.arctan2(-gx, gy)) + 360, 360)
        a[~(np.hypot(gx, gy) >= 1e-9)] = np.nan
        q = np.rint((smooth_directions(a, sigma) if sigma > 0 else a) / step) * step
        if not np.isfinite(q).any():
            return []
        return _bands(q, row, [float(k) for k in np.arange(step, 360 + step / 2, step) - step / 2])

    out = _vectorise(tiles, kernel)
    return out.withColumn("label", S.aspect_label(F.col("value"), step)) if labels else out


def flood_classes(pixels: DataFrame, step: float = 0.1) -> DataFrame:
    """Pixels with water, with their depth class; the class has the decimals of the step."""
    digits = max(1, len(f"{step:g}".partition(".")[2]))
    return pixels.filter("value > 0").withColumn("depth_m", S.rint(S.quantise(F.col("value"), step), digits))


def soil_classes(pixels: DataFrame, step: float = 5.0, russian: bool = False) -> DataFrame:
    """Soil pixels (clay, silt, sand, cfvo) with parts in steps of 100, texture and coarse fragments."""
    parts = S.soil_bins(F.col("clay"), F.col("silt"), F.col("sand"), step)
    out = pixels.filter("clay + silt + sand > 0").withColumns({"clay_pct": parts[0], "silt_pct": parts[1], "sand_pct": parts[2]})
    texture = S.soil_texture(F.col("clay_pct"), F.col("silt_pct"), F.col("sand_pct"))
    out = out.withColumn("usda_texture", texture)
    return out.withColumn("usda_texture", S.lookup(F.col("usda_texture"), S.TEXTURE_RU).cast("string")) if russian else out


def soil_areas(classes: DataFrame, *keys: str) -> DataFrame:
    """Soil classes with their number of pixels and mean coarse fragments, in whole per mille; by ``keys``, too."""
    by = [*keys, "clay_pct", "silt_pct", "sand_pct", "usda_texture"]
    return classes.groupBy(*by).agg(F.rint(F.avg("cfvo")).cast("int").alias("coarse"), F.count(F.lit(1)).alias("n"))


SOIL_CLASS = ["clay_pct", "silt_pct", "sand_pct", "usda_texture"]


def soil_polygons(pixels: DataFrame, zones: DataFrame | None = None, step: float = 5.0, russian: bool = False, cell: float = 1000.0) -> DataFrame:
    """Soil classes as boxes: (zone_id, clay_pct, silt_pct, sand_pct, usda_texture, coarse, x0 .. y1).

    ``pixels`` (row, col, clay, silt, sand, cfvo, x_min, y_max, size_x, size_y) may be of several rasters. A class has the
    mean of all its pixels' coarse fragments; its pixels merge to rectangles, which are cut to ``zones`` (zone_id, bx0 ..
    by1) if they are given. Pixels without soil, or with a missing part, are left out.
    """
    classes = shared_table(soil_classes(pixels, step, russian), "classes")
    coarse = soil_areas(classes).drop("n")
    boxes = pixel_regions(classes, SOIL_CLASS)
    boxes = boxes if zones is None else zone_regions(boxes, zones, cell, SOIL_CLASS)
    equal = [boxes[c].eqNullSafe(coarse[c]) for c in SOIL_CLASS]
    kept = [boxes[c] for c in boxes.columns]
    return boxes.join(coarse, reduce(Column.__and__, equal)).select(*kept, "coarse")


def flood_polygons(pixels: DataFrame, zones: DataFrame | None = None, step: float = 0.1, cell: float = 1000.0, keys: list[str] | None = None) -> DataFrame:
    """Depth classes of floods as boxes: (zone_id, keys, depth_m, x0 .. y1).

    ``pixels`` (row, col, value, x_min, y_max, size_x, size_y) may be of several rasters; ``keys`` (return periods, say)
    stay apart. Dry and missing pixels are left out; zones are as in ``soil_polygons``.
    """
    by = [*(keys or []), "depth_m"]
    boxes = pixel_regions(flood_classes(pixels, step), by)
    return boxes if zones is None else zone_regions(boxes, zones, cell, by)


def terrain_regions(pixels: DataFrame, layer: str, step: float, pixel_metres: tuple[float, float] = (30.0, 30.0), zones: DataFrame | None = None, cell: float = 1000.0) -> DataFrame:
    """Classes of height, slope or aspect as boxes of whole pixels: (zone_id, tile, value, label, x0 .. y1).

    ``pixels`` (tile, row, col, value, x_min, y_max, size_x, size_y) may be of many tiles; neighbours of a pixel are
    those of its own tile. A class is the nearest multiple of ``step``: of heights in their unit, of slopes in degrees
    (from one step up), of aspects in degrees below 360, with the wind's name as label (null for the others). Pixels
    without a value, or without the neighbours that a slope needs, are left out, and so are flat ones from aspects.
    """
    if layer not in ("height", "slope", "aspect"):
        raise ValueError(f"unknown layer: {layer}")
    place = ["x_min", "y_max", "size_x", "size_y"]
    known = pixels.select("tile", "row", "col", "value", *place)
    label = F.lit(None).cast("string")
    if layer == "height":
        classes = known.withColumn("class", S.quantise(F.col("value"), step))
    else:
        slopes = gradient(known.drop(*place), *pixel_metres)
        degrees = (S.slope if layer == "slope" else S.aspect)(F.col("gx"), F.col("gy"))
        found = slopes.select("tile", "row", "col", S.quantise(degrees, step).alias("class"))
        classes = known.join(found, ["tile", "row", "col"])
        if layer == "slope":
            classes = classes.filter(F.col("class") >= step)
        else:
            classes = classes.withColumn("class", F.col("class") % 360.0)
            label = S.aspect_label(F.col("value"), step)
    boxes = pixel_regions(classes.drop("value").withColumnRenamed("class", "value").dropna(subset=["value"]), ["tile", "value"], tuple(place))
    boxes = boxes if zones is None else zone_regions(boxes, zones, cell, ["tile", "value"])
    return boxes.withColumn("label", label)


def zone_terrain(spark: SparkSession, folder: str, zone: tuple[float, float, float, float], layer: str, step: float, pixel_metres: tuple[float, float] = (30.0, 30.0), pattern: str = "*.tif") -> DataFrame:
    """(tile, value, label, x0 .. y1): a layer of ``terrain_regions`` in a zone, from the rasters below a folder.

    Only the blocks around the zone are read, with two pixels beyond it, which slopes need; the result is cut to it.
    """
    from ..sources.windows import read_window

    x0, y0, x1, y1 = map(float, zone)
    halo = 2 * max(pixel_metres)
    pixels = read_window(spark, folder, (x0 - halo, y0 - halo, x1 + halo, y1 + halo), pattern).withColumnRenamed("path", "tile")
    one = spark.range(1).select(F.lit(0).alias("zone_id"), *[F.lit(v).alias(f"b{c}") for v, c in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])
    return terrain_regions(pixels, layer, step, pixel_metres, one, max(x1 - x0, y1 - y0, 1.0)).drop("zone_id")
