"""Regions of boxes: merged runs, differences by strips, union with closing, and dissolving by value.

Boxes (x0 .. y1) of one tile are cut into strips by the edges that they have in y; over a strip, sums that change at
the boxes' ends say what covers what. So neither pairs of boxes nor all cells of a tile are ever made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared_table
from .components import components
from .overlay import clipped
from .spatial import in_cells

BOX = ("x0", "y0", "x1", "y1")


def grown(boxes: DataFrame, by: float) -> DataFrame:
    return boxes.withColumns({c: F.col(c) + s * float(by) for c, s in zip(BOX, (-1, -1, 1, 1))})


def runs(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Intervals lo .. hi of each key, merged where they touch or overlap: (keys, lo, hi)."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    furthest = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(furthest.isNull() | (F.col(lo) > furthest), 1).otherwise(0)
    run = F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = df.select(*keys, lo, hi).withColumn("_begins", begins).withColumn("_run", run)
    return out.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_run")


def rectangles(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes without overlaps merged to wide ones, and these to high ones, where they have equal ``keys``."""
    wide = runs(boxes, [*keys, "y0", "y1"], "x0", "x1")
    return runs(wide, [*keys, "x0", "x1"], "y0", "y1").select(*keys, *BOX)


def swept(boxes: DataFrame, keys: list[str], counters: list[str], keep: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """(keys, x0 .. y1): where the sums of the boxes' ``counters`` meet a condition, as boxes that don't overlap."""
    edges = boxes.select(*keys, F.explode(F.array("y0", "y1")).alias("s0")).distinct()
    strips = edges.withColumn("s1", F.lead("s0").over(Window.partitionBy(*keys).orderBy("s0"))).dropna(subset=["s1"])
    over = boxes.join(strips, keys).filter((F.col("s0") >= F.col("y0")) & (F.col("s1") <= F.col("y1")))
    ends = F.array(*[F.struct(F.col(c).alias("x"), *[(s * F.col(n)).alias(n) for n in counters]) for c, s in (("x0", 1), ("x1", -1))])
    where = [*keys, "s0", "s1"]
    steps = over.select(*where, F.explode(ends).alias("e")).groupBy(*where, F.col("e.x").alias("x0")).agg(*[F.sum(f"e.{n}").alias(n) for n in counters])
    order = Window.partitionBy(*where).orderBy("x0")
    sums = {n: F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in counters}
    steps = steps.withColumns({"x1": F.lead("x0").over(order)} | {f"_{n}": s for n, s in sums.items()})
    kept = steps.filter(F.col("x1").isNotNull() & keep({n: F.col(f"_{n}") for n in counters}))
    return rectangles(kept.select(*keys, "x0", F.col("s0").alias("y0"), "x1", F.col("s1").alias("y1")), keys)


def closed(boxes: DataFrame, buffer: float, tile: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, cx, cy, x0 .. y1): the boxes of each key, united and closed: widened by ``buffer``, then narrowed by it.

    Gaps narrower than twice the buffer close. Each tile is worked out apart, with all that lies within the buffer
    around it, so tile borders leave no trace; the result is cut at them. Corners stay square. A buffer of 0 unites.
    Boxes with a null coordinate are left out; an empty table gives no rows.
    """
    keys = keys or []
    wide = grown(boxes.select(*keys, *BOX).dropna(subset=list(BOX)), buffer)
    # A tile takes what meets it when widened once more; the halo is cut off at the end.
    halo = {f"w{c}": F.col(c) + s * float(buffer) for c, s in zip(BOX, (-1, -1, 1, 1))}
    cells = in_cells(wide.withColumns(halo), tile, tuple(halo)).drop(*halo)
    where = [*keys, "cx", "cy"]
    x, y, b, side = F.col("cx") * tile, F.col("cy") * tile, float(buffer), float(tile)
    dealt = clipped(cells, x - b, y - b, x + side + b, y + side + b)
    windows = dealt.select(*where).distinct().select(*where, (x - b).alias("x0"), (y - b).alias("y0"), (x + side + b).alias("x1"), (y + side + b).alias("y1"))

    def counted(df: DataFrame, **values: int) -> DataFrame:
        return df.select(*where, *BOX, *[F.lit(v).alias(n) for n, v in values.items()])

    gaps = swept(counted(dealt, full=1, window=0).unionByName(counted(windows, full=0, window=1)), where, ["full", "window"], lambda n: (n["window"] > 0) & (n["full"] == 0))
    both = counted(dealt, full=1, gap=0).unionByName(counted(grown(gaps, b), full=0, gap=1))
    return swept(clipped(both, x, y, x + side, y + side), where, ["full", "gap"], lambda n: (n["full"] > 0) & (n["gap"] == 0))


def dissolved_regions(boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, region, x0 .. y1): boxes without overlaps, merged, with the region of equal keys that each is in.

    Boxes that share a stretch of an edge are in one region; a corner doesn't join them. Null keys are equal to each
    other. Edges meet in an equi-join on their line and a cell along it. A region's number is the least of its boxes'.
    """
    merged = shared_table(rectangles(boxes, keys).withColumn("id", F.monotonically_increasing_id()), "rectangles")

    def sides(names: tuple[str, str], suffix: str) -> DataFrame:
        both = []
        for axis, line, lo, hi in (("v", names[0], "y0", "y1"), ("h", names[1], "x0", "x1")):
            along = F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
            both.append(merged.select(*[F.col(k).alias(f"{k}_{suffix}") for k in keys], F.lit(axis).alias(f"axis_{suffix}"), F.col(line).alias(f"line_{suffix}"), F.col(lo).alias(f"lo_{suffix}"), F.col(hi).alias(f"hi_{suffix}"), F.col("id").alias(f"id_{suffix}"), along.alias(f"cell_{suffix}")))
        return reduce(DataFrame.unionByName, both)

    ends, begins = sides(("x1", "y1"), "a"), sides(("x0", "y0"), "b")
    equal = [F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in (*keys, "axis", "line", "cell")]
    met = reduce(Column.__and__, equal) & (F.col("lo_a") < F.col("hi_b")) & (F.col("lo_b") < F.col("hi_a"))
    linked = components(ends.join(begins, met).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    out = merged.join(linked.withColumnRenamed("node", "id"), "id", "left")
    return out.select(*keys, F.coalesce("component", "id").alias("region"), *BOX)


def region_facts(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region, area, x0 .. y1): each region's area and bounds."""
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return regions.groupBy(*keys, "region").agg(area.alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def pixel_regions(pixels: DataFrame, keys: list[str], place: tuple[str, str, str, str] = ("x_min", "y_max", "size_x", "size_y")) -> DataFrame:
    """(keys, x0 .. y1): pixels (row, col) of equal ``keys`` as few rectangles.

    Pixels of a row merge to maximal runs, and equal runs of following rows to rectangles; this is done in whole
    numbers, so it doesn't depend on rounding. ``place`` names columns of the raster's left and upper edge and the size
    of its pixels. Repeated pixels count once; those with a null row or column go.
    """
    col, row = F.col("col").cast("long"), F.col("row").cast("long")
    at = pixels.dropna(subset=["row", "col"]).select(*keys, *[F.col(c).alias(f"_{i}") for i, c in enumerate(place)], col.alias("x0"), (-row - 1).alias("y0"), (col + 1).alias("x1"), (-row).alias("y1"))
    merged = rectangles(at, [*keys, "_0", "_1", "_2", "_3"])
    return merged.select(*keys, *[(F.col(f"_{c[0] == 'y':d}") + F.col(c) * F.col(f"_{2 + (c[0] == 'y')}")).alias(c) for c in BOX])


def zone_regions(regions: DataFrame, zones: DataFrame, cell: float, keys: list[str], zone_id: str = "zone_id") -> DataFrame:
    """(zone_id, keys, x0 .. y1): boxes cut to each zone (bx0 .. by1) that they share an area with."""
    from .spatial import box_join

    pairs = box_join(regions, zones.select(zone_id, "bx0", "by0", "bx1", "by1"), cell, predicate="overlaps")
    cut = clipped(pairs, F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"))
    return cut.select(zone_id, *keys, *BOX)
