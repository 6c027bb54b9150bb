"""Functions on WKB columns, as Arrow-batched pandas functions over the numpy kernels, and a dissolve."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..geometry import plane, projection, wkb


def _each(kind: str, work: Callable):
    """A pandas function of geometry columns that gives null where any of them is null."""
    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        out = [None if any(v is None for v in row) else work(*row) for row in zip(*columns)]
        return pd.Series(out, dtype=object if kind in ("binary", "string", "array<binary>") else None)

    return run


def _xy(x: float, y: float) -> bytes:
    return wkb.dumps(wkb.POINT, [np.array([[x, y]])])


def geom_type(g: Column) -> Column:
    return _each("string", lambda a: wkb.NAMES[wkb.loads(a)[0]])(g)


def area(g: Column) -> Column:
    return _each("double", lambda a: plane.area(wkb.polygons(a)))(g)


def length(g: Column) -> Column:
    def work(a):
        kind, parts = wkb.loads(a)
        return sum(plane.length(p) for p in parts) if kind in (wkb.LINE, wkb.MULTILINE) else sum(plane.length(r) for s in wkb.polygons(a) for r in s)

    return _each("double", work)(g)


def buffer(g: Column, distance: float, quarter: int = 8) -> Column:
    def work(a):
        kind, parts = wkb.loads(a)
        if kind in (wkb.LINE, wkb.MULTILINE):
            return wkb.from_polygons(plane.union([plane.buffer_line(p, distance, quarter) for p in parts]))
        if kind in (wkb.POINT, wkb.MULTIPOINT):
            return wkb.from_polygons(plane.union([[plane._capsule(p[0], p[0], distance, quarter)] for p in parts]))
        return wkb.from_polygons(plane.buffer(wkb.polygons(a), distance, quarter))

    return _each("binary", work)(g)


def simplify(g: Column, tolerance: float) -> Column:
    def work(a):
        kind, parts = wkb.loads(a)
        if kind in (wkb.LINE, wkb.MULTILINE):
            return wkb.dumps(kind, [plane.simplify(p, tolerance) for p in parts])
        return wkb.from_polygons([[plane.simplify(r, tolerance) for r in s] for s in wkb.polygons(a)])

    return _each("binary", work)(g)


def make_valid(g: Column) -> Column:
    return _each("binary", lambda a: wkb.from_polygons(plane.make_valid(wkb.polygons(a))))(g)


def is_valid(g: Column) -> Column:
    return _each("boolean", lambda a: plane.is_valid(wkb.polygons(a)))(g)


def dump(g: Column) -> Column:
    """The single polygons or lines of a geometry, to be exploded."""
    def work(a):
        kind, parts = wkb.loads(a)
        if kind in (wkb.LINE, wkb.MULTILINE):
            return [wkb.dumps(wkb.LINE, [p]) for p in parts]
        return [wkb.from_polygons([s]) for s in wkb.polygons(a)] or [a]

    return _each("array<binary>", work)(g)


def representative_point(g: Column) -> Column:
    return _each("binary", lambda a: _xy(*plane.representative_point(max(wkb.polygons(a), key=lambda s: plane.area([s])))))(g)


def convex_hull(g: Column) -> Column:
    return _each("binary", lambda a: wkb.dumps(wkb.POLYGON, [plane.convex_hull(np.concatenate([r for s in wkb.polygons(a) for r in s]))]))(g)


def _pair(work: Callable) -> Callable[[Column, Column], Column]:
    def function(a: Column, b: Column) -> Column:
        return _each("binary", lambda p, q: wkb.from_polygons(work(wkb.polygons(p), wkb.polygons(q))))(a, b)

    return function


intersection = _pair(plane.intersection)
difference = _pair(plane.difference)


def intersects(a: Column, b: Column) -> Column:
    return _each("boolean", lambda p, q: plane.intersects(wkb.polygons(p), wkb.polygons(q)))(a, b)


def contains_point(g: Column, x: Column, y: Column) -> Column:
    return _each("boolean", lambda a, px, py: bool(plane.covers(wkb.polygons(a), np.array([[px, py]]))[0]))(g, x, y)


def _reprojected(column: pd.Series, source: int, target: int) -> pd.Series:
    """The coordinates of all shapes of a batch are moved together."""
    def arrays(parts):
        for p in parts:
            yield from [p] if isinstance(p, np.ndarray) else arrays(p)

    def moved(parts):
        return [take(len(p)) if isinstance(p, np.ndarray) else moved(p) for p in parts]

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return xy[at - n : at]

    read = [None if a is None else wkb.loads(a) for a in column]
    coordinates = [p for s in read if s is not None for p in arrays(s[1])]
    if not coordinates:
        return column
    xy, at = projection.reproject(np.concatenate(coordinates), source, target), 0
    return pd.Series([None if s is None else wkb.dumps(s[0], moved(s[1])) for s in read], dtype=object)


def reproject(g: Column, source: int, target: int) -> Column:
    return F.pandas_udf(lambda column: _reprojected(column, source, target), "binary", F.PandasUDFType.SCALAR)(g)


#: Parts of a table for each core, where its rows go through functions on shapes.
PARTS = 4


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores: a small file of shapes is one task otherwise, however long each takes."""
    return df.repartition(PARTS * df.sparkSession.sparkContext.defaultParallelism)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return _each("binary", wkb.box)(x0, y0, x1, y1)


def with_bounds(df: DataFrame, geom: str) -> DataFrame:
    """``df`` with x0, y0, x1, y1 of a geometry, for joins on grid cells."""
    @F.pandas_udf("x0 double, y0 double, x1 double, y1 double")
    def bounds(column: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 4 if a is None else wkb.bounds(a) for a in column]
        return pd.DataFrame(rows, columns=["x0", "y0", "x1", "y1"])

    return df.withColumn("_b", bounds(geom)).select(*df.columns, "_b.*")


def dissolve(df: DataFrame, keys: list[str], geom: str, cell: float) -> DataFrame:
    """Union of geometries by key, in two steps: the shapes that begin in one grid cell, then the cells of a key.

    A first union makes the second small, so a key with many shapes is not one task's list of all of them.
    """
    fields = [df.schema[k] for k in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = group[keys].iloc[:1].copy()
        out[geom] = [wkb.from_polygons(plane.union([wkb.polygons(g) for g in group[geom]]))]
        return out

    placed = with_bounds(df.select(*keys, geom).dropna(), geom).withColumns({"cx": F.floor(F.col("x0") / cell), "cy": F.floor(F.col("y0") / cell)})
    cells = placed.select(*keys, geom, "cx", "cy").groupBy(*keys, "cx", "cy").applyInPandas(lambda g: merge(g), f"{kinds}, `{geom}` binary")
    return cells.groupBy(*keys).applyInPandas(merge, f"{kinds}, `{geom}` binary")
