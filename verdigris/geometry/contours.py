"""Level lines of a raster by marching squares with linear interpolation, and the polygons between them."""

from __future__ import annotations

import numpy as np

from .plane import polygonise, representative_point


def level_segments(values: np.ndarray, level: float) -> np.ndarray:
    """Segments (col, row, col, row) of the level line; cells with a missing corner have none."""
    a, b, c, d = values[:-1, :-1], values[:-1, 1:], values[1:, 1:], values[1:, :-1]
    rows, cols = np.indices(a.shape)
    known = np.isfinite(a + b + c + d)

    def cut(p, q, x0, y0, x1, y1):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(p != q, (level - p) / (q - p), 0.5)
        return cols + x0 + (x1 - x0) * t, rows + y0 + (y1 - y0) * t

    sides = {"t": cut(a, b, 0, 0, 1, 0), "r": cut(b, c, 1, 0, 1, 1), "b": cut(d, c, 0, 1, 1, 1), "l": cut(a, d, 0, 0, 0, 1)}
    case = (a > level) * 8 + (b > level) * 4 + (c > level) * 2 + (d > level) * 1
    mean = (a + b + c + d) / 4 > level
    joins = {1: ["lb"], 2: ["br"], 3: ["lr"], 4: ["tr"], 6: ["tb"], 7: ["lt"], 8: ["lt"], 9: ["tb"], 11: ["tr"], 12: ["lr"], 13: ["br"], 14: ["lb"]}
    out = []

    def take(mask, pair):
        (x0, y0), (x1, y1) = sides[pair[0]], sides[pair[1]]
        out.append(np.stack([x0[mask], y0[mask], x1[mask], y1[mask]], 1))

    for k, pairs in joins.items():
        for pair in pairs:
            take(known & (case == k), pair)
    for k, high, low in ((5, ("lt", "br"), ("lb", "tr")), (10, ("lb", "tr"), ("lt", "br"))):  # saddles, by the mean
        for flag, pairs in ((mean, high), (~mean, low)):
            for pair in pairs:
                take(known & (case == k) & flag, pair)
    found = np.concatenate(out) if out else np.zeros((0, 4))
    return found[(found[:, :2] != found[:, 2:]).any(axis=1)]


def lines(segments: np.ndarray) -> list[np.ndarray]:
    """Segments chained to lines; closed lines end where they begin."""
    key = lambda p: (round(p[0] * 1e7), round(p[1] * 1e7))
    links: dict = {}
    for i, s in enumerate(segments):
        links.setdefault(key(s[:2]), []).append(i)
        links.setdefault(key(s[2:]), []).append(i)
    left, out = set(range(len(segments))), []

    def follow(at, i):
        path = []
        while i is not None:
            left.discard(i)
            s = segments[i]
            end = s[2:] if key(s[:2]) == at else s[:2]
            path.append(end)
            at = key(end)
            i = next((j for j in links[at] if j in left), None)
        return path

    starts = [i for i in left if any(len(links[key(e)]) == 1 for e in (segments[i][:2], segments[i][2:]))]
    for i in [*starts, *range(len(segments))]:
        if i in left:
            s = segments[i]
            first = s[:2] if len(links[key(s[:2])]) == 1 or len(links[key(s[2:])]) != 1 else s[2:]
            out.append(np.array([first, *follow(key(first), i)]))
    return out


def bands(values: np.ndarray, levels: list[float]) -> list[tuple[float, list[np.ndarray]]]:
    """(value at a point inside, polygon) of the areas between the level lines and the raster's frame."""
    h, w = values.shape
    frame = np.array([[0, 0, w - 1, 0], [w - 1, 0, w - 1, h - 1], [w - 1, h - 1, 0, h - 1], [0, h - 1, 0, 0]], float)
    segments = np.concatenate([frame, *(level_segments(values, v + 1e-9) for v in levels)])
    out = []
    for face in polygonise(segments):
        x, y = representative_point(face)
        out.append((float(values[min(h - 1, int(round(y))), min(w - 1, int(round(x)))]), face))
    return out
