"""Well-known binary. A geometry is (kind, parts): points and lines are lists of coordinate arrays, a polygon is a
list of rings, a multi-polygon a list of polygons."""

from __future__ import annotations

import struct

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}


def _coords(xy: np.ndarray) -> bytes:
    return struct.pack("<I", len(xy)) + np.ascontiguousarray(xy, "<f8").tobytes()


def dumps(kind: int, parts: list) -> bytes:
    head = struct.pack("<BI", 1, kind)
    if kind == POINT:
        return head + np.asarray(parts[0], "<f8").reshape(2).tobytes()
    if kind == LINE:
        return head + _coords(parts[0])
    if kind == POLYGON:
        return head + struct.pack("<I", len(parts)) + b"".join(_coords(r) for r in parts)
    inner = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}[kind]
    return head + struct.pack("<I", len(parts)) + b"".join(dumps(inner, p if inner == POLYGON else [p]) for p in parts)


def _read(data: bytes, at: int) -> tuple[int, list, int]:
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    kind, at = kind & 0xFF, at + 5

    def coords(at: int, n: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(data, order + "f8", 2 * n, at).reshape(n, 2).astype(float), at + 16 * n

    def counted(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == POINT:
        xy, at = coords(at, 1)
        return kind, [xy], at
    n, at = counted(at)
    if kind == LINE:
        xy, at = coords(at, n)
        return kind, [xy], at
    parts = []
    for _ in range(n):
        if kind == POLYGON:
            m, at = counted(at)
            xy, at = coords(at, m)
            parts.append(xy)
        else:
            inner, sub, at = _read(data, at)
            parts.append((inner, sub) if kind == COLLECTION else sub if kind == MULTIPOLYGON else sub[0])
    return kind, parts, at


def loads(data: bytes) -> tuple[int, list]:
    kind, parts, _ = _read(data, 0)
    return kind, parts


def polygons(data: bytes) -> list[list[np.ndarray]]:
    """The polygons of a geometry, each a list of rings; none for points and lines."""
    kind, parts = loads(data)
    if kind == POLYGON:
        return [parts]
    if kind == MULTIPOLYGON:
        return parts
    if kind == COLLECTION:
        return [p for k, sub in parts for p in ([sub] if k == POLYGON else sub if k == MULTIPOLYGON else [])]
    return []


def from_polygons(shapes: list[list[np.ndarray]]) -> bytes:
    return dumps(POLYGON, shapes[0]) if len(shapes) == 1 else dumps(MULTIPOLYGON, shapes)


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return dumps(POLYGON, [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]])])


def bounds(data: bytes) -> tuple[float, float, float, float]:
    def walk(parts):
        for p in parts:
            if isinstance(p, np.ndarray):
                yield p
            elif isinstance(p, tuple):
                yield from walk(p[1])
            else:
                yield from walk(p)

    xy = np.concatenate(list(walk(loads(data)[1])))
    return (*xy.min(0), *xy.max(0))
