"""Planar overlay of boxes: faces by coordinate compression in tiles, with an impact for each face.

The plane is cut into tiles. In a tile the edges of its boxes cut it into elementary rectangles; each that a box
covers becomes a face, and its impact combines those of all boxes over it. Results are sums over faces by value, so
tile borders leave no trace. A tile's work depends on what lies in it: either choose the tile size for the density, or
have tiles that hold too many different boxes cut to quarters until they don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import combined_impact
from ..tables import shared_table
from .spatial import in_cells


def clipped(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Boxes cut to a window; those that share no area with it go."""
    cut = df.withColumns({"x0": F.greatest("x0", x0), "y0": F.greatest("y0", y0), "x1": F.least("x1", x1), "y1": F.least("y1", y1)})
    return cut.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


#: Cuts of a tile to quarters, after which it is taken as it is: where so many edges cross at one place.
MOST_CUTS = 12


def dealt_to_tiles(boxes: DataFrame, keys: list[str], tile: float, most: int | None = None) -> DataFrame:
    """Boxes cut to the tiles that they share an area with, which (lvl, cx, cy) name.

    With ``most``, a tile in which more different boxes of a key end is cut to quarters, and these again; boxes that
    cover a whole tile cost it no face, so they don't count. A round handles the boxes of hot tiles only.
    """
    def cut(df: DataFrame, size: float, level: int) -> DataFrame:
        x, y = F.col("cx") * size, F.col("cy") * size
        return clipped(in_cells(df, size), x, y, x + size, y + size).withColumn("lvl", F.lit(level))

    found = cut(boxes, tile, 0)
    if most is None:
        return found
    where, done = [*keys, "cx", "cy"], None
    for level in range(MOST_CUTS + 1):
        size = tile / 2**level
        found = shared_table(found, "tiles")
        x, y = F.col("cx") * size, F.col("cy") * size
        ends = (F.col("x0") > x) | (F.col("y0") > y) | (F.col("x1") < x + size) | (F.col("y1") < y + size)
        counts = found.filter(ends).groupBy(*where).agg(F.count_distinct("x0", "y0", "x1", "y1").alias("n"))
        hot = shared_table(counts.filter(F.col("n") > most).select(*where), "hot")
        last = level == MOST_CUTS or not hot.limit(1).count()
        cold = found if last else found.join(hot, where, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        if last:
            return done
        found = cut(found.join(hot, where, "left_semi").drop("cx", "cy", "lvl"), size / 2, level + 1)


#: Parts for each core, so that none has many dense tiles.
PARTS = 4


def _by_tile(dealt: DataFrame, where: list[str]) -> DataFrame:
    """Boxes by tile, in a fixed number of parts: a tile makes far more faces than it has boxes, so parts that adaptive
    execution joined by their size before would be too large."""
    spark = dealt.sparkSession
    return dealt.repartition(max(PARTS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *where)


def faces(boxes: DataFrame, keys: list[str], tile: float, most: int | None = None, counted: bool = False) -> DataFrame:
    """Pairs (face, box over it): keys, lvl, cx, cy, fx0, fy0, fx1, fy1 and the columns of the box.

    Boxes with different keys don't see each other. ``most`` is as in ``dealt_to_tiles``. If ``counted``, rows that are
    equal in a tile are one, with their number in ``copies``.
    """
    dealt = dealt_to_tiles(boxes, keys, tile, most)
    where = [*keys, "lvl", "cx", "cy"]
    if counted:
        dealt = shared_table(dealt.groupBy(*dealt.columns).agg(F.count(F.lit(1)).alias("copies")), "dealt")
    parted = _by_tile(dealt, where)

    def steps(axis: str) -> DataFrame:
        edges = dealt.select(*where, F.explode(F.array(f"{axis}0", f"{axis}1")).alias(f"f{axis}0")).distinct()
        after = F.lead(f"f{axis}0").over(Window.partitionBy(*where).orderBy(f"f{axis}0"))
        return edges.withColumn(f"f{axis}1", after).dropna(subset=[f"f{axis}1"])

    # A box covers a run of steps on each axis; only these are joined, never all steps of a tile with each other.
    # Merged, as the parts hold only if no side is broadcast.
    across = parted.join(steps("x").hint("merge"), where).filter((F.col("fx0") >= F.col("x0")) & (F.col("fx1") <= F.col("x1")))
    return across.join(steps("y").hint("merge"), where).filter((F.col("fy0") >= F.col("y0")) & (F.col("fy1") <= F.col("y1")))


#: Rows of a batch of faces.
FACES_OF_BATCH = 500_000


def _painted(keys: list[str], source: str) -> Callable:
    """A function of a tile's boxes: for each face and ``source`` over it, the impact and is_source of its least level.

    The boxes of a source are painted on the tile's grid from the greatest level to the least, so what is seen at last
    counts, and pairs of faces and boxes are never made.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        at = {c: rows.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")}
        xs, ys = (np.unique(np.concatenate([at[f"{a}0"], at[f"{a}1"]])) for a in "xy")
        i0, i1, j0, j1 = (np.searchsorted(edges, at[c]) for edges, c in ((xs, "x0"), (xs, "x1"), (ys, "y0"), (ys, "y1")))
        of = rows.column(source).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((-rows.column("level").to_numpy(), of))
        firsts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        found, n = [], 0
        for group in np.split(order, firsts[1:]):
            left, low = i0[group].min(), j0[group].min()
            seen = np.full((j1[group].max() - low, i1[group].max() - left), -1, np.int64)
            for r in group:
                seen[j0[r] - low : j1[r] - low, i0[r] - left : i1[r] - left] = r
            j, i = np.nonzero(seen >= 0)
            found.append((seen[j, i], i + left, j + low))
            n += len(i)
            if n >= FACES_OF_BATCH:
                yield placed(rows, xs, ys, found)
                found, n = [], 0
        if n:
            yield placed(rows, xs, ys, found)

    def placed(rows: pa.Table, xs: np.ndarray, ys: np.ndarray, found: list) -> pa.RecordBatch:
        r, i, j = (np.concatenate(c) for c in zip(*found))
        kept = rows.select([*keys, "impact", "is_source"]).combine_chunks().take(pa.array(r))
        face = {"fx0": xs[i], "fy0": ys[j], "fx1": xs[i + 1], "fy1": ys[j + 1]}
        columns = {**{k: kept.column(k) for k in keys}, **{c: pa.array(v) for c, v in face.items()}, "impact": kept.column("impact"), "is_source": kept.column("is_source")}
        return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0]

    return run


def seen_faces(boxes: DataFrame, keys: list[str], tile: float, source: str, most: int | None = None) -> DataFrame:
    """(keys, fx0 .. fy1, impact, is_source): a row for each face and ``source`` over it, of its box of least ``level``.

    Copies don't count, so each different box is dealt once."""
    boxes = boxes.select(*dict.fromkeys([*keys, source, "level", "impact", "is_source"]), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct()
    dealt = dealt_to_tiles(boxes, keys, tile, most)
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} double" for c in ("fx0", "fy0", "fx1", "fy1")], *[f"{c} {kinds[c]}" for c in ("impact", "is_source")]])
    where = [*keys, "lvl", "cx", "cy"]
    return _by_tile(dealt, where).groupBy(*where).applyInArrow(_painted(keys, source), schema)


def overlay(boxes: DataFrame, keys: list[str], tile: float, caps: DataFrame | None = None, combine: Callable[[Column], Column] | None = None, source: str | None = None, most: int | None = None, once: bool = False) -> DataFrame:
    """Faces with their combined impact: keys, fx0 .. fy1, layer_impact, is_source.

    ``boxes`` has x0 .. y1, impact and is_source. ``caps`` is one row (most, least); without it the extremes of
    ``boxes`` are taken. ``combine`` may be an aggregate of its own over the impacts. ``source`` names a column that
    boxes of one object share; over a face, only its box of least ``level`` counts then. ``most`` is as in
    ``dealt_to_tiles``. Boxes that are equal in a tile, as all that cover it, are one row there with their number; a
    ``combine`` of one's own sees each, unless ``once`` says that equal impacts don't change it.
    """
    if caps is None:
        caps = boxes.agg(F.max("impact").alias("most"), F.min("impact").alias("least"))
    face = [*keys, "fx0", "fy0", "fx1", "fy1"]
    if source is not None:
        covered = seen_faces(boxes, keys, tile, source, most).withColumn("copies", F.lit(1))
    else:
        boxes = boxes.select(*dict.fromkeys([*keys, "x0", "y0", "x1", "y1", "impact", "is_source"]))
        covered = faces(boxes, keys, tile, most, combine is None or once)
        face += ["lvl", "cx", "cy"]  # so the faces of a tile are summed where they are made
    covered = covered.crossJoin(F.broadcast(caps))  # one row
    value = combine(F.col("impact")) if combine else combined_impact(F.col("impact"), F.first("most"), F.first("least"), F.col("copies"))
    return covered.groupBy(*face).agg(value.alias("layer_impact"), F.bool_or("is_source").alias("is_source")).drop("lvl", "cx", "cy")


def dissolved(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Area and number of faces by key."""
    area = (F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0"))
    return frame.groupBy(*keys).agg(F.sum(area).alias("area"))


def custom_smallest_negative(impact: Column) -> Column:
    """A combiner of one's own: the negative impact of least size, else the largest positive one."""
    return F.coalesce(F.max(F.when(impact < 0, impact)), F.max(impact))


def rings(sources: DataFrame, layers: str = "layers_count", radius: str = "total_impact_radius", impact: str = "impact", fading: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Concentric rings of boxes: one row for each level, with outer box x0 .. y1, the inner one ix0 .. iy1, impact
    and is_source. Level 0 is the source, each further level a width further out, with a faded impact: a function of
    impact, number of layers and level, which may be one's own."""
    from ..functions.scalars import ring_impact, ring_width

    fading = fading or ring_impact

    out = sources.withColumn("level", F.explode(F.sequence(F.lit(0), F.col(layers) - 1)))
    width = ring_width(F.col(radius), F.col(layers))
    grow = F.coalesce(width, F.lit(0.0)) * F.col("level")
    inner = F.coalesce(width, F.lit(0.0)) * (F.col("level") - 1)
    has_inner = F.col("level") > 0
    signs = {"x0": -1, "y0": -1, "x1": 1, "y1": 1}
    out = out.withColumns({f"i{c}": F.when(has_inner, F.col(c) + s * inner) for c, s in signs.items()} | {c: F.col(c) + s * grow for c, s in signs.items()})
    return out.withColumns({"impact": fading(F.col(impact).cast("double"), F.col(layers).cast("double"), F.col("level").cast("double")), "is_source": F.col("level") == 0})
