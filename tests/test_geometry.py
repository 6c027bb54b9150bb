import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.geometry import contours, plane, projection, wkb
from verdigris.sources import geotiff


def box(x0, y0, x1, y1):
    return [[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)]]


boxes = st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 15), st.integers(1, 15)).map(lambda t: (t[0], t[1], t[0] + t[2], t[1] + t[3]))


@settings(max_examples=40, deadline=None)
@given(boxes, boxes)
def test_set_operations_of_boxes(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = w * h if w > 0 and h > 0 else 0
    size = [(c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)]
    p, q = box(*a), box(*b)
    assert plane.area(plane.intersection(p, q)) == pytest.approx(common, abs=1e-6)
    assert plane.area(plane.union([p, q])) == pytest.approx(sum(size) - common, abs=1e-6)
    assert plane.area(plane.difference(p, q)) == pytest.approx(size[0] - common, abs=1e-6)


def test_holes_and_buffers():
    ring = plane.difference(box(0, 0, 10, 10), box(3, 3, 6, 6))
    assert len(ring) == 1 and len(ring[0]) == 2 and plane.area(ring) == pytest.approx(91)
    assert not plane.contains(ring, np.array([[4.0, 4.0]]))[0] and plane.contains(ring, np.array([[1.0, 1.0]]))[0]
    wide = plane.buffer(box(0, 0, 10, 10), 2, 8)
    assert plane.area(wide) == pytest.approx(100 + 80 + math.pi * 4, rel=2e-3)
    assert plane.area(plane.buffer(box(0, 0, 10, 10), -2, 8)) == pytest.approx(36, rel=1e-3)
    assert plane.area(plane.buffer_line(np.array([[0, 0], [10, 0], [10, 10]], float), 1)) == pytest.approx(38 + math.pi * 1.25 + 0.0, rel=0.03)
    assert plane.intersects(box(0, 0, 2, 2), box(1, 1, 3, 3)) and not plane.intersects(box(0, 0, 1, 1), box(2, 2, 3, 3))
    bow = [[np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)]]
    assert not plane.is_valid(bow) and plane.area(plane.make_valid(bow)) == pytest.approx(2)


def test_lines():
    line = np.array([[0, 0], [5, 0.01], [10, 0], [10, 10]], float)
    assert len(plane.simplify(line, 0.1)) == 3 and plane.length(plane.segmentise(line, 3)) == pytest.approx(plane.length(line))
    hull = plane.convex_hull(np.array([[0, 0], [1, 1], [2, 0], [2, 2], [0, 2]], float))
    assert plane.ring_area(hull) == pytest.approx(4)
    x, y = plane.representative_point(plane.difference(box(0, 0, 10, 10), box(1, 1, 9, 9))[0])
    assert plane.contains(plane.difference(box(0, 0, 10, 10), box(1, 1, 9, 9)), np.array([[x, y]]))[0]


def test_wkb_round_trip():
    shape = plane.difference(box(0, 0, 10, 10), box(3, 3, 6, 6)) + box(20, 20, 30, 30)
    data = wkb.from_polygons(shape)
    assert plane.area(wkb.polygons(data)) == pytest.approx(plane.area(shape)) and wkb.bounds(data) == (0, 0, 30, 30)
    for kind, parts in ((wkb.POINT, [np.array([[1.0, 2.0]])]), (wkb.LINE, [np.ones((3, 2))]), (wkb.MULTILINE, [np.ones((2, 2))] * 2)):
        found, back = wkb.loads(wkb.dumps(kind, parts))
        assert found == kind and all((a == b).all() for a, b in zip(parts, back))


def test_utm():
    assert projection.utm_srid(30.3, 59.9) == 32636 and projection.utm_srid(151, -33) == 32756
    rng = np.random.default_rng(1)
    for srid, lat in ((32636, 1), (32756, -1)):
        mid = (srid % 100) * 6 - 183
        p = np.stack([mid + rng.uniform(-3, 3, 50), lat * rng.uniform(1, 80, 50)], 1)
        assert np.abs(projection.from_utm(projection.to_utm(p, srid), srid) - p).max() < 1e-10
    # a degree of latitude on the central meridian at the equator is 110574.39 m, scaled by 0.9996
    assert projection.to_utm(np.array([[33.0, 1.0]]), 32636)[0] == pytest.approx([500000, 110574.39 * 0.9996], abs=1)


def test_contours():
    y, x = np.mgrid[0:30, 0:30]
    cone = 20 - np.hypot(x - 14.5, y - 14.5)
    found = contours.lines(contours.level_segments(cone, 10.0))
    assert len(found) == 1 and (found[0][0] == pytest.approx(found[0][-1])) and plane.length(found[0]) == pytest.approx(2 * math.pi * 10, rel=0.02)
    areas = contours.bands(np.rint(cone / 5) * 5, [5, 10, 15])
    assert sum(plane.area([f]) for _, f in areas) == pytest.approx(29 * 29)


def test_geotiff(spark, tmp_path):
    values = np.arange(12.0).reshape(3, 4)
    values[1, 2] = np.nan
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n59e030.tif").write_bytes(geotiff.encode(values, 30.0, 60.0, 0.5))
    (tmp_path / "bad.tif").write_bytes(b"II*\0")
    tiles = geotiff.read_tiles(spark, str(tmp_path)).collect()
    good = next(t for t in tiles if t["error"] is None)
    assert len(tiles) == 2 and (good["height"], good["width"], good["x_min"], good["y_max"]) == (3, 4, 29.75, 60.25)
    assert good["values"][6] is None and good["values"][11] == 11.0
    px = geotiff.pixels(geotiff.read_tiles(spark, str(tmp_path))).filter("row = 2 AND col = 3").first()
    assert px["value"] == 11.0 and geotiff.listing(spark, str(tmp_path)).count() == 2


def test_lzw_and_packbits():
    assert geotiff._packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])
    codes = [256, 65, 66, 258, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert geotiff._lzw(data) == b"ABAB"
