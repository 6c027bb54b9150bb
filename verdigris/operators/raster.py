"""Pixel-wise raster work on (tile, row, col, value): windows, levels, terrain, zones, soil and flood classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantise
from .spatial import box_join


def pixel_place(row: Column, col: Column, x_min: float, y_max: float, size: float) -> tuple[Column, Column]:
    """Map coordinates of a pixel; rows go down."""
    return x_min + col * size, y_max - row * size


def window(pixels: DataFrame, bounds: tuple[float, float, float, float], x_min: float, y_max: float, size: float) -> DataFrame:
    """The pixels of the window of whole rows and columns that holds the bounds (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = bounds
    lo_c, hi_c = int((x0 - x_min) // size), int(-(-(x1 - x_min) // size)) - 1
    lo_r, hi_r = int((y_max - y1) // size), int(-(-(y_max - y0) // size)) - 1
    return pixels.filter(F.col("row").between(lo_r, hi_r) & F.col("col").between(lo_c, hi_c))


def levels(pixels: DataFrame, step: float) -> DataFrame:
    """(tile, level, n): contour levels from the lowest to the highest value in whole steps, and the pixels of each."""
    spans = pixels.groupBy("tile").agg(F.floor(F.min("value") / step).alias("lo"), F.ceil(F.max("value") / step).alias("hi"))
    grid = spans.dropna().select("tile", F.explode(F.sequence("lo", "hi")).alias("k")).select("tile", (F.col("k") * step).alias("level"))
    counts = pixels.filter("value IS NOT NULL").groupBy("tile", quantise(F.col("value"), step).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["tile", "level"], "left").select("tile", "level", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def gradient(pixels: DataFrame, dx: float, dy: float) -> DataFrame:
    """Pixels with central differences gx (along a row) and gy (down the rows); one-sided at the tile's edges.

    Missing cells are filled in first, so a neighbour without data gives null and is not skipped.
    """
    span = pixels.groupBy("tile").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    grid = span.withColumn("row", F.explode(F.sequence("lo_row", "hi_row"))).withColumn("col", F.explode(F.sequence("lo_col", "hi_col")))
    full = grid.join(pixels, ["tile", "row", "col"], "left")

    def along(axis: str, other: str, size: float) -> Column:
        w = Window.partitionBy("tile", other).orderBy(axis)
        v, before, after = F.col("value"), F.lag("value").over(w), F.lead("value").over(w)
        low, high = F.col(axis) == F.col(f"lo_{axis}"), F.col(axis) == F.col(f"hi_{axis}")
        return F.when(low, (after - v) / size).when(high, (v - before) / size).otherwise((after - before) / (2 * size))

    return full.withColumn("gx", along("col", "row", dx)).withColumn("gy", along("row", "col", dy)).select("tile", "row", "col", "value", "gx", "gy")


def zonal_mode(pixels: DataFrame, zones: DataFrame, cell: float, size: float | None = None) -> DataFrame:
    """(tile, zone_id, value, n): the most frequent pixel value in each zone, the least of equals.

    Pixels need x and y; zones bx0 .. by1. Counts are made per value before the choice, so a large zone is no single
    task's list. With ``size``, the side of a pixel, every zone has a row for each tile whose extent it meets, widened by half a
    pixel's diagonal: one without a pixel in it counts those of the widened zone, one that has none even then takes the
    pixel that its middle lies in (x and y are a pixel's upper left corner), and one that is void there has nulls and no
    pixels. A zone that meets no tile has one row, without a tile.
    """
    at = pixels.filter("value IS NOT NULL").withColumns({"px0": F.col("x"), "py0": F.col("y"), "px1": F.col("x"), "py1": F.col("y")})

    def mode(zones: DataFrame, step: int) -> DataFrame:
        inside = box_join(at, zones, cell, predicate="within", left_box=("px0", "py0", "px1", "py1"))
        counts = inside.groupBy("tile", "zone_id", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("tile", "zone_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("m"))
        return best.select("tile", "zone_id", F.lit(step).alias("step"), F.col("m.value").alias("value"), (-F.col("m.less")).alias("n"))

    if size is None:
        return mode(zones, 0).drop("step")
    grow = size * 2**0.5 / 2
    wide = zones.withColumns({c: F.col(c) + s * grow for c, s in (("bx0", -1), ("by0", -1), ("bx1", 1), ("by1", 1))})
    x, y = (F.col("bx0") + F.col("bx1")) / 2, (F.col("by0") + F.col("by1")) / 2
    middle = zones.withColumns({"bx0": x - size, "by0": y, "bx1": x, "by1": y + size})
    found = mode(zones, 0).union(mode(wide, 1)).union(mode(middle, 2))
    best = found.groupBy("tile", "zone_id").agg(F.min_by(F.struct("value", "n"), "step").alias("m"))
    # A zone gets rows of the tiles whose extent it meets, and one without a tile if it meets none.
    extent = pixels.groupBy("tile").agg(F.min("x").alias("ex0"), (F.min("y") - size).alias("ey0"), (F.max("x") + size).alias("ex1"), F.max("y").alias("ey1"))
    met = box_join(extent, wide, max(cell, 50 * size), left_box=("ex0", "ey0", "ex1", "ey1")).select("tile", "zone_id").union(best.select("tile", "zone_id")).distinct()
    off = zones.select("zone_id").join(met.select("zone_id"), "zone_id", "left_anti").select(F.lit(None).cast(pixels.schema["tile"].dataType).alias("tile"), "zone_id")
    out = met.union(off).join(best, ["tile", "zone_id"], "left")
    return out.select("tile", "zone_id", F.col("m.value").alias("value"), F.coalesce("m.n", F.lit(0).cast("long")).alias("n"))


def gaussian_kernel(sigma: float, truncate: float = 4.0):
    import numpy as np

    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def smooth_array(values, sigma: float):
    """Separable Gaussian with the edge repeated; a missing value spreads as far as the kernel reaches."""
    import numpy as np

    if sigma <= 0:
        return values
    w = gaussian_kernel(sigma)
    radius = len(w) // 2
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(values, pad, mode="edge")
        values = sum(k * np.take(wide, range(i, i + values.shape[axis]), axis=axis) for i, k in enumerate(w))
    return values


def smooth_directions(degrees, sigma: float):
    """Circular Gaussian mean of directions; missing ones have no weight, and without weight nothing is known."""
    import numpy as np

    known = np.isfinite(degrees)
    rad = np.deg2rad(np.where(known, degrees, 0.0))
    c, s, w = (smooth_array(x, sigma) for x in (np.cos(rad) * known, np.sin(rad) * known, known.astype(float)))
    out = np.mod(np.rad2deg(np.arctan2(s, c)), 360.0)
    return np.where(w < 1e-12, np.nan, out)


def _per_tile(pixels: DataFrame, kernel) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r, c = group["row"].to_numpy(), group["col"].to_numpy()
        grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        grid[r - r.min(), c - c.min()] = group["value"]
        out = kernel(grid)
        rows, cols = np.indices(grid.shape)
        return pd.DataFrame({"tile": group["tile"].iloc[0], "row": rows.ravel() + r.min(), "col": cols.ravel() + c.min(), "value": out.ravel()})

    kind = pixels.schema["tile"].dataType.simpleString()
    out = pixels.select("tile", "row", "col", "value").groupBy("tile").applyInPandas(run, f"tile {kind}, row int, col int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def smoothed(pixels: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing tile by tile (a tile is what one task holds)."""
    return _per_tile(pixels, lambda grid: smooth_array(grid, sigma))


def smoothed_directions(pixels: DataFrame, sigma: float) -> DataFrame:
    return _per_tile(pixels, lambda grid: smooth_directions(grid, sigma))
