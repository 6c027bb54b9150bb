"""Windows of rasters and GeoParquet folders."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.geometry import wkb
from verdigris.ship import ship
from verdigris.sources import geoparquet, geotiff, windows


def tiled(values, x0, y0, size, block):
    """A GeoTIFF of square, deflated blocks; its first pixel's centre is (x0, y0)."""
    import struct
    import zlib

    h, w = values.shape
    down, across = -(-h // block), -(-w // block)
    full = np.full((down * block, across * block), -9999.0, "<f4")
    full[:h, :w] = np.where(np.isfinite(values), values, -9999.0)
    body, offsets, counts = b"", [], []
    for i in range(down):
        for j in range(across):
            raw = zlib.compress(full[i * block : (i + 1) * block, j * block : (j + 1) * block].tobytes())
            offsets.append(8 + len(body))
            counts.append(len(raw))
            body += raw
    n = len(offsets)
    blobs = [struct.pack(f"<{n}I", *offsets), struct.pack(f"<{n}I", *counts), struct.pack("<3d", size, size, 0), struct.pack("<6d", 0, 0, 0, x0, y0, 0)]
    places = [8 + len(body) + sum(map(len, blobs[:k])) for k in range(4)]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 8), (277, 3, 1, 1), (322, 4, 1, block), (323, 4, 1, block), (324, 4, n, places[0] if n > 1 else offsets[0]), (325, 4, n, places[1] if n > 1 else counts[0]), (339, 3, 1, 3), (33550, 12, 3, places[2]), (33922, 12, 6, places[3])]
    at = 8 + len(body) + sum(map(len, blobs))
    return struct.pack("<2sHI", b"II", 42, at) + body + b"".join(blobs) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)


@pytest.fixture
def rasters(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(3)
    values = np.round(rng.random((70, 90)) * 100)
    values[5, 5] = np.nan
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tif").write_bytes(tiled(values, 1005.0, 1995.0, 10.0, 16))
    (tmp_path / "sub" / "b.tif").write_bytes(geotiff.encode(values[:20, :20], 5005.0, 1995.0, 10.0))
    return str(tmp_path), values


def test_blocks_decode_alike(rasters):
    folder, values = rasters
    got, place = geotiff.decode(open(f"{folder}/a.tif", "rb").read())
    assert np.array_equal(np.nan_to_num(got, nan=-1), np.nan_to_num(values.astype("f4"), nan=-1)) and (place["x_min"], place["y_max"]) == (1000.0, 2000.0)


def test_windows_against_whole_rasters(spark, rasters, monkeypatch):
    folder, values = rasters
    whole = windows.read_window(spark, folder).collect()
    assert len(whole) == values.size + 400
    assert {(r["row"], r["col"]): r["value"] for r in whole if r["path"].endswith("a.tif")} == {(i, j): None if np.isnan(v) else float(np.float32(v)) for (i, j), v in np.ndenumerate(values)}
    for bounds in ((1155.0, 1700.0, 1333.0, 1821.0), (0.0, 0.0, 1e4, 1e4), (1000.0, 1990.0, 1010.0, 2000.0), (5100.0, 1900.0, 5110.0, 1950.0), (9000.0, 0.0, 9001.0, 1.0)):
        got = sorted((r["path"], r["row"], r["col"]) for r in windows.read_window(spark, folder, bounds).collect())
        want = sorted((r["path"], r["row"], r["col"]) for r in whole if r["x"] < bounds[2] and r["x"] + 10 > bounds[0] and r["y"] > bounds[1] and r["y"] - 10 < bounds[3])
        assert got == want


def test_only_touched_blocks_are_read(rasters):
    folder, _ = rasters
    asked = []

    class File:
        def __init__(self, path):
            self.data = open(path, "rb").read()

        def read_at(self, n, at):
            asked.append((at, n))
            return self.data[at : at + n]

    size = os.path.getsize(f"{folder}/a.tif")
    saved, windows.HEAD = windows.HEAD, 16
    try:
        page = geotiff.Page(windows._Slices(File(f"{folder}/a.tif"), size))
        asked.clear()
        wanted = page.blocks_in((1170.0, 1830.0, 1330.0, 1840.0))
        assert wanted == [7, 8] and page.across == 6
        for k in wanted:
            page.block(k)
        assert asked == [(page.offsets[k], page.counts[k]) for k in wanted]
    finally:
        windows.HEAD = saved


def test_large_files_are_dealt_to_several_tasks(rasters):
    folder, values = rasters
    reader = windows.GeoTiffReader({"path": folder, "taskbytes": "3000"})
    parts = reader.partitions()
    assert len(parts) > 3
    rows = [r for p in parts for b in reader.read(p) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert len(rows) == len(set(rows)) == values.size + 400


def test_filters_narrow_the_window(spark, rasters):
    folder, values = rasters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = windows.read_window(spark, folder)
        condition = (F.col("x") >= 1100) & (F.col("x") < 1200) & (F.col("y") <= 1900) & (F.col("y") > 1700)
        assert df.filter(condition).count() == 10 * 20
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert df.filter(condition).count() == 10 * 20


def shapes_of(spark, n):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        x, y = rng.uniform(0, 1000, 2)
        rows.append((i, bytearray(wkb.box(x, y, x + 1, y + 1)), float(x), float(y), float(x + 1), float(y + 1)))
    return spark.createDataFrame(rows, "id long, geometry binary, x0 double, y0 double, x1 double, y1 double")


def test_geoparquet_round_trip_and_metadata(spark, tmp_path):
    ship(spark)
    df, path = shapes_of(spark, 3000), f"{tmp_path}/geo"
    geoparquet.write_geoparquet(df, path, srid=32636, row_group=100, file_rows=1500)
    back = geoparquet.read_geoparquet(spark, path)
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    meta = geoparquet.read_metadata(path)
    assert len(meta) == 2 and not glob.glob(f"{path}/_staging*")
    for m in meta.values():
        column = m["columns"][m["primary_column"]]
        assert m["version"] == "1.1.0" and column["encoding"] == "WKB" and column["crs"]["id"]["code"] == 32636 and column["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
    ends = [m["columns"]["geometry"]["bbox"] for m in meta.values()]
    box = df.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    assert [f(e[i] for e in ends) for i, f in enumerate((min, min, max, max))] == list(box)
    geoparquet.write_geoparquet(df.limit(10), path)
    assert geoparquet.read_geoparquet(spark, path).count() == 3010
    geoparquet.write_geoparquet(df.limit(10), path, mode="overwrite")
    assert geoparquet.read_geoparquet(spark, path).count() == 10
    assert "crs" not in next(iter(geoparquet.read_metadata(path).values()))["columns"]["geometry"]


def test_row_groups_are_skipped_by_bounds(spark, tmp_path):
    ship(spark)
    df, path = shapes_of(spark, 20_000), f"{tmp_path}/geo"
    geoparquet.write_geoparquet(df, path, row_group=200)
    bounds = (100.0, 100.0, 130.0, 130.0)
    found = geoparquet.read_geoparquet(spark, path, bounds)
    want = {r["id"] for r in df.filter("x0 <= 130 AND x1 >= 100 AND y0 <= 130 AND y1 >= 100").collect()}
    assert {r["id"] for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [" in plan.toString() and "bbox.xmin" in plan.toString()

    def scanned(node):
        if "FileSourceScan" in node.getClass().getSimpleName():
            return node.metrics().apply("numOutputRows").value()
        return sum(scanned(node.children().apply(i)) for i in range(node.children().size()))

    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    assert 0 < scanned(plan) <= 2000  # of 20,000 rows


def test_geojson_bounds_and_tile_index(spark, tmp_path):
    import json

    from verdigris.sources import vectors

    def feature(kind, coordinates, **properties):
        return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}

    square = [[[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]]
    features = [
        feature("Polygon", square, file_name="a.tif"), feature("MultiPolygon", [square, [[[10, 10], [11, 10], [11, 12], [10, 10]]]], file_name="b.tif"), feature("Point", [5.5, -1.25], file_name="c.tif"),
        feature("LineString", [[1, 2, 7], [3, -4, 8]]), feature("Polygon", [], file_name="e.tif"), feature("Polygon", [[[4, 0], [8, 0], [8, 3], [4, 0]]], file_name="a.tif"), {"type": "Feature", "properties": {"file_name": "z"}, "geometry": None},
    ]
    (tmp_path / "index.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    found = vectors.geojson_boxes(vectors.read_geojson(spark, str(tmp_path / "index.geojson"))).collect()
    assert sorted((r["type"], r["n_positions"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in found if r["x0"] is not None) == [
        ("LineString", 2, 1.0, -4.0, 3.0, 2.0), ("MultiPolygon", 9, 0.0, 0.0, 11.0, 12.0), ("Point", 1, 5.5, -1.25, 5.5, -1.25), ("Polygon", 4, 4.0, 0.0, 8.0, 3.0), ("Polygon", 5, 0.0, 0.0, 4.0, 3.0),
    ]
    assert len(found) == 7
    index = {r["tile_name"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in vectors.read_tile_index(spark, str(tmp_path / "index.geojson")).collect()}
    assert index == {"a.tif": (0, 0, 8, 3), "b.tif": (0, 0, 11, 12), "c.tif": (5.5, -1.25, 5.5, -1.25)}


def test_terrain_of_a_zone(spark, rasters):
    """A zone's heights, slopes and aspects from files: as those of the whole rasters, cut to it."""
    from verdigris.operators import vectorise

    folder, _ = rasters
    y, x = np.mgrid[0:40, 0:60]
    open(f"{folder}/a.tif", "wb").write(tiled(np.where(x < 30, 10.0 * x, 300.0 + y), 1005.0, 1995.0, 10.0, 16))
    os.remove(f"{folder}/sub/b.tif")
    zone = (1105.0, 1700.0, 1455.0, 1903.0)
    for layer, step in (("height", 50.0), ("slope", 5.0), ("aspect", 90.0)):
        part = vectorise.zone_terrain(spark, folder, zone, layer, step, (10.0, 10.0)).collect()
        whole = vectorise.terrain_regions(windows.read_window(spark, folder).withColumnRenamed("path", "tile"), layer, step, (10.0, 10.0)).collect()
        area = {}
        for r in whole:
            wide, high = min(r["x1"], zone[2]) - max(r["x0"], zone[0]), min(r["y1"], zone[3]) - max(r["y0"], zone[1])
            if wide > 0 and high > 0:
                area[r["value"], r["label"]] = area.get((r["value"], r["label"]), 0) + wide * high
        got = {}
        for r in part:
            got[r["value"], r["label"]] = got.get((r["value"], r["label"]), 0) + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
        assert got.keys() == area.keys() and all(got[k] == pytest.approx(area[k]) for k in got) and len(got) > 1 - (layer == "aspect")
        assert all((r["label"] is None) == (layer != "aspect") for r in part)
    with pytest.raises(ValueError, match="unknown layer"):
        vectorise.zone_terrain(spark, folder, zone, "depth", 1.0)
