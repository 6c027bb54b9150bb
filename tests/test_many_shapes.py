"""Shapes in many rows: boxes without the overlay's nodes and faces, and projections of whole batches."""

import numpy as np
import pandas as pd

from verdigris.functions import shapes
from verdigris.geometry import plane, projection, wkb


def _box(x0, y0, x1, y1):
    return [[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)]]


def test_buffers_of_boxes_equal_those_of_the_overlay(monkeypatch):
    boxes = [_box(0, 0, 200, 150), _box(3.25, -7.5, 40.125, 60), _box(0, 0, 50, 80)]
    quick = [[plane.buffer(b, d) for d in (25.0, -25.0, -3.0)] for b in boxes]
    monkeypatch.setattr(plane, "as_box", lambda shape: None)
    for b, of in zip(boxes, quick):
        for d, got in zip((25.0, -25.0, -3.0), of):
            assert _vertices(got) == _vertices(plane.buffer(b, d))
    monkeypatch.undo()
    monkeypatch.setattr(plane, "overlay", None)  # boxes need none
    assert plane.area(plane.buffer(boxes[0], -25.0)) == 150 * 100


def _vertices(shape):
    return {tuple(p) for polygon in shape for ring in polygon for p in np.rint(ring / plane.GRID).astype(int).tolist()}


def test_intersections_of_boxes_equal_those_of_the_overlay(monkeypatch):
    a, others = _box(0, 0, 10, 10), [_box(5, 5, 20, 20), _box(-5, 2, 20, 4), _box(10, 0, 20, 10), _box(30, 30, 40, 40), _box(0, 0, 10, 10)]
    quick = [plane.intersection(a, b) for b in others]
    monkeypatch.setattr(plane, "as_box", lambda shape: None)
    assert [_vertices(q) for q in quick] == [_vertices(plane.intersection(a, b)) for b in others]
    monkeypatch.undo()
    assert plane.as_box([[np.array([[0, 0], [2, 0], [3, 1], [0, 1], [0, 0]], float)]]) is None
    monkeypatch.setattr(plane, "overlay", None)  # boxes need none
    assert plane.area(plane.intersection(a, others[0])) == 25


def test_a_batch_is_reprojected_together(monkeypatch):
    calls, whole = [], projection.reproject
    monkeypatch.setattr(projection, "reproject", lambda xy, *rest: calls.append(len(xy)) or whole(xy, *rest))
    rows = [wkb.dumps(wkb.POINT, [np.array([[30.0 + i, 50.0]])]) for i in range(3)] + [None, wkb.box(30, 50, 31, 51)]
    got = shapes._reprojected(pd.Series(rows, dtype=object), 4326, 32636)
    assert calls == [8] and got[3] is None
    assert [wkb.loads(g)[0] for g in got if g is not None] == [wkb.POINT] * 3 + [wkb.POLYGON]
    for before, after in zip(rows, got):
        if before is not None:
            flat = wkb.loads(before)[1][0]
            np.testing.assert_allclose(wkb.loads(after)[1][0], whole(flat, 4326, 32636), rtol=1e-14)
