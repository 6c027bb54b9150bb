"""Bounds, UTM zones and projections of points as Column expressions, and graphs in other coordinates.

The projection is Krüger's series on the WGS 84 ellipsoid, so it stays in the JVM; it is exact to well below a
millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..geometry.projection import _ALPHA, _BETA, _E0, _K0, _N, _R

#: From conformal to geodetic latitude, to the fourth order of the third flattening (fixed values).
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
BOX = ("x0", "y0", "x1", "y1")


def total_bounds(df: DataFrame, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """One row (x0, y0, x1, y1): the bounds of all boxes; nulls of an empty table. NaN and null coordinates don't count."""
    def known(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    return df.agg(*[f(known(c)).alias(n) for c, n, f in zip(box, BOX, (F.min, F.min, F.max, F.max))])


def utm_srid(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone of a place: 326zz in the north, 327zz in the south; the wide zones of Norway and
    Svalbard aren't used."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)
    return F.when(lon.isNotNull() & lat.isNotNull(), F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone))


def estimated_srid(df: DataFrame, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """One row (srid): the UTM zone of the middle of a table's bounds, in degrees; null for an empty table."""
    b = total_bounds(df, box)
    return b.select(utm_srid((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).alias("srid"))


def _middle(srid: Column) -> Column:
    ok = srid.between(32601, 32660) | srid.between(32701, 32760)
    checked = F.when(ok | srid.isNull(), srid).otherwise(F.raise_error(F.concat(F.lit("not a UTM zone: "), srid.cast("string"))).cast("int"))
    return F.radians((checked % 100) * 6 - 183)


def _north(srid: Column) -> Column:
    return F.when(srid < 32700, 0.0).otherwise(1e7)


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of values that are worked out once, however often it names them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def to_utm(lon: Column, lat: Column, srid: Column) -> Column:
    """struct(x, y): east and north in metres, in the zone ``srid``, of degrees."""
    e = 2 * math.sqrt(_N) / (1 + _N)

    def sphere(p: Column) -> Column:
        up = F.sin(F.radians(p["lat"]))
        return _let({"along": F.radians(p["lon"]) - p["middle"], "t": F.sinh(F.atanh(up) - e * F.atanh(e * up)), "north": p["north"]}, plane)

    def plane(p: Column) -> Column:
        return _let({"xi": F.atan2(p["t"], F.cos(p["along"])), "eta": F.atanh(F.sin(p["along"]) / F.sqrt(1 + p["t"] * p["t"])), "north": p["north"]}, series)

    def series(p: Column) -> Column:
        x, y = p["eta"], p["xi"]
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            y = y + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return F.struct((_E0 + _K0 * _R * x).alias("x"), (p["north"] + _K0 * _R * y).alias("y"))

    return _let({"lon": lon, "lat": lat, "middle": _middle(srid), "north": _north(srid)}, sphere)


def from_utm(x: Column, y: Column, srid: Column) -> Column:
    """struct(x, y): longitude and latitude in degrees, of metres in the zone ``srid``."""
    def series(p: Column) -> Column:
        a, b = p["xi"], p["eta"]
        for j, c in enumerate(_BETA, 1):
            a = a - c * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            b = b - c * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return _let({"a": a, "b": b, "middle": p["middle"]}, sphere)

    def sphere(p: Column) -> Column:
        return _let({"up": F.asin(F.sin(p["a"]) / F.cosh(p["b"])), "lon": F.atan2(F.sinh(p["b"]), F.cos(p["a"])) + p["middle"]}, ellipsoid)

    def ellipsoid(p: Column) -> Column:
        lat = p["up"]
        for j, d in enumerate(_DELTA, 1):
            lat = lat + d * F.sin(2 * j * p["up"])
        return F.struct(F.degrees(p["lon"]).alias("x"), F.degrees(lat).alias("y"))

    return _let({"xi": (y - _north(srid)) / (_K0 * _R), "eta": (x - _E0) / (_K0 * _R), "middle": _middle(srid)}, series)


def reprojected(df: DataFrame, source: int | Column, target: int | Column, columns: list[tuple[str, str]]) -> DataFrame:
    """``df`` with pairs of coordinate columns brought from one system to another: 4326 (degrees) or UTM zones.

    Either may be a column. Null coordinates stay null; a system of another kind raises when rows are read.
    """
    a, b = (s if isinstance(s, Column) else F.lit(s) for s in (source, target))
    def moved(x: Column, y: Column) -> Column:
        same = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        degrees = F.when((a == b) | (a == 4326), same).otherwise(from_utm(x, y, F.when(a != 4326, a)))
        return _let({"p": degrees}, lambda v: F.when((a == b) | (b == 4326), v["p"]).otherwise(to_utm(v["p"]["x"], v["p"]["y"], F.when(b != 4326, b))))

    for x, y in columns:
        df = df.withColumn("_p", moved(F.col(x), F.col(y))).withColumns({x: F.col("_p.x"), y: F.col("_p.y")}).drop("_p")
    return df


def reprojected_graph(nodes: DataFrame, edges: DataFrame, source: int | None, target: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (x, y) and edges (x, y, x2, y2) of a graph in another system; a graph without one raises ValueError."""
    if source is None:
        raise ValueError("the graph has no coordinate system")
    return reprojected(nodes, source, target, [("x", "y")]), reprojected(edges, source, target, [("x", "y"), ("x2", "y2")])
