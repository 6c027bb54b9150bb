import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from verdigris.functions import scalars as S
from verdigris.functions import shapes
from verdigris.geometry import plane, wkb
from verdigris.operators import frame, raster, river, vectorise
from verdigris.operators.components import components
from verdigris.operators.spatial import nearest
from verdigris.plans import composed as Q
from verdigris.sources import geotiff, rasters, vectors
from verdigris.streaming import tiles as T


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    found = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    expect = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect()) == expect


def test_names_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_golden_rings(spark):
    cases = [(5, 4, [4, 2.4, 0.8, 0.3, 0.1]), (8, 3, [3, 2.2, 1.1, 0.6, 0.3, 0.2, 0.1, 0.0]), (5, -4, [-4, -3.9, -3.5, -2.0, -0.5]), (8, -10, [-10, -9.9, -9.6, -8.7, -6.5, -3.5, -1.3, -0.4])]
    for n, first, expect in cases:
        d = spark.range(n).orderBy("id").select(S.ring_impact(F.lit(float(first)), F.lit(float(n)), F.col("id").cast("double")).alias("v"))
        assert [r["v"] for r in d.collect()] == expect


def test_golden_combiner_and_radius(spark):
    for values, expect in (([3, 4], 4.0), ([3, 2], 3.6), ([-6, -8], -10.0), ([3, -8], -5.0), ([-4, -3], -5.0), ([-2.5], -2.5)):
        d = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert d.agg(S.combined_impact(F.col("v"), F.lit(4.0), F.lit(-10.0)).alias("c")).first()["c"] == expect
    for size, expect in ((1000.0, -1200.0), (100000.0, -3222.4), (500000.0, -6000.0)):
        assert one(spark, S.impact_radius(F.lit(-3.0), F.lit(0.4), frame.area_factor(F.lit(size), (1000, 500000, 1, 5)))) == expect


def test_golden_bins_and_scores(spark):
    for parts, expect in (((12, 41, 47), (10, 40, 50)), ((18, 63, 19), (20, 60, 20))):
        got = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(S.soil_bins(*[F.lit(float(p)) for p in parts]))]).first()
        assert tuple(got) == expect
    f, t = F.lit(False), F.lit(True)
    for args, expect in (((t, f, 3.0), 5), ((f, t, -3.0), 0), ((f, f, 2.0), 4), ((f, f, 0.5), 3), ((f, f, 0.0), 2.5), ((f, f, -4.0), 2), ((f, f, -4.01), 1)):
        assert one(spark, S.score(args[0], args[1], F.lit(args[2]))) == expect


def spill_graph(spark):
    return spark.createDataFrame([(1, 2, 10.0), (2, 3, 5.0), (3, 4, 20.0), (2, 5, 5.0), (5, 6, 10.0)], "src long, dst long, cost double")


def test_golden_spill(spark):
    sources = spark.createDataFrame([(0, 1, 100.0)], "source_id long, node long, pollution double")
    got = {r["node"]: round(r["remain"], 6) for r in river.remain_by_node(river.propagate(spill_graph(spark), sources)).collect()}
    assert got == {1: 100, 2: 90, 3: 55, 4: 35, 5: 25, 6: 15}


def walked(edges, sources):
    """Portions followed one by one."""
    out, into = {}, {}
    cheapest = {}
    for u, v, c in edges:
        cheapest[u, v] = min(c, cheapest.get((u, v), c))
    for (u, v), c in cheapest.items():
        out.setdefault(u, []).append((v, c))
        into.setdefault(v, []).append(u)

    def distances(start):
        found, node, total = [0.0], start, 0.0
        while len(out.get(node, [])) == 1 and len(into.get(node, [])) <= 1:
            node, total = out[node][0][0], total + out[node][0][1]
            found.append(total)
        return found

    remain, todo = {}, [(n, p) for _, n, p in sources]
    while todo:
        node, rest = todo.pop()
        remain[node] = remain.get(node, 0) + rest
        kids = out.get(node, [])
        means = [sum(near) / len(near) for v, _ in kids for near in [[d for d in distances(v) if d <= rest]]]
        shares = [rest] if len(kids) == 1 else [rest * m / sum(means) for m in means] if sum(means) else []
        todo += [(v, s - c) for (v, c), s in zip(kids, shares) if s - c >= 0]
    return {n: round(r, 6) for n, r in remain.items()}


def test_spill_with_confluences_and_sources_anywhere(spark):
    edges = [(1, 2, 3.0), (2, 3, 2.0), (3, 4, 1.0), (3, 5, 2.0), (4, 6, 1.0), (5, 6, 1.0), (6, 7, 2.0), (7, 8, 4.0), (8, 9, 1.0), (8, 10, 3.0), (10, 11, 2.0), (12, 7, 1.0), (1, 2, 9.0)]
    sources = [(0, 1, 60.0), (1, 2, 20.0), (2, 5, 15.0), (3, 6, 8.0), (4, 99, 5.0), (5, 12, 30.0), (6, 10, 1.0), (7, 9, 7.0)]
    e = spark.createDataFrame(edges, "src long, dst long, cost double")
    s = spark.createDataFrame(sources, "source_id long, node long, pollution double")
    got = {r["node"]: round(r["remain"], 6) for r in river.remain_by_node(river.propagate(e, s)).collect()}
    assert got == walked(edges, sources)


def test_small_zones_take_the_pixel_they_lie_in(spark):
    pixels = spark.createDataFrame([("t", 0.0, 10.0, 1.0), ("t", 10.0, 10.0, 2.0), ("t", 0.0, 20.0, 3.0), ("t", 10.0, 20.0, 4.0)], "tile string, x double, y double, value double")
    zones = spark.createDataFrame([(1, 4.9, 4.9, 5.0, 5.0), (2, -1.0, 9.0, 11.0, 11.0), (3, 900.0, 900.0, 901.0, 901.0), (4, 14.0, 3.0, 14.2, 3.2)], "zone_id long, bx0 double, by0 double, bx1 double, by1 double")
    got = {r["zone_id"]: (r["value"], r["n"]) for r in raster.zonal_mode(pixels, zones, 50.0, 10.0).collect()}
    assert got == {1: (1.0, 1), 2: (1.0, 1), 3: (None, 0), 4: (2.0, 1)}


def test_water_lines_are_widened_and_areas_are_not(spark):
    d = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 0.0), (2, "b", 0.0, 0.0, 10.0, 10.0)], "source_id long, name string, x0 double, y0 double, x1 double, y1 double")
    got = {r["source_id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in frame.prepare_layer(d, "water", frame.RULES["water"]).collect()}
    assert got == {1: (-5, -5, 15, 5), 2: (0, 0, 10, 10)}


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_of_a_path(spark, monkeypatch, one_task):
    from verdigris.operators import components as module

    monkeypatch.setattr(module, "ONE_TASK", one_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_nearest_looks_further(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 1000.0)], "p long, x double, y double")
    n = spark.createDataFrame([(7, 3.0, 4.0), (8, 400.0, 0.0), (9, 3.0, -4.0)], "n long, nx double, ny double")
    assert {r["p"]: (r["n"], r["dist"]) for r in nearest(p, n, "p", "n", 10.0).collect()} == {1: (7, 5.0), 2: (8, 1e6**0.5 * (0.36 + 1) ** 0.5)}


def layers(spark):
    gas = spark.createDataFrame([(1, "A", 0.0, 0.0, 40.0, 40.0), (2, "B", 45.0, 0.0, 90.0, 40.0)], "source_id long, name string, x0 double, y0 double, x1 double, y1 double")
    water = spark.createDataFrame([(3, None, 500.0, 500.0, 900.0, 900.0)], "source_id long, name string, x0 double, y0 double, x1 double, y1 double")
    woods = spark.createDataFrame([(4, "W", 0.0, 0.0, 300.0, 300.0)], "source_id long, name string, x0 double, y0 double, x1 double, y1 double")
    return {"gas_station": gas, "water": water, "woods": woods}


def test_frame_end_to_end(spark):
    built = frame.build_frame(layers(spark), territory=(-200.0, -200.0, 1200.0, 1200.0), tile=500.0)
    sources = {r["source_id"]: r for r in built.sources.collect()}
    assert built.sources.filter("source_id = 1").count() == 2  # one object of two boxes
    assert sources[1]["names"] == ["A", "B"] and 2 not in sources and sources[3]["names"] == ["Водный объект без названия"]
    assert sources[1]["total_impact_radius"] == -600.0 and sources[3]["total_impact_radius"] == 300.0
    faces = built.map.collect()
    total = sum((f["fx1"] - f["fx0"]) * (f["fy1"] - f["fy0"]) for f in faces)
    assert total <= 1400 * 1400 and all(-4 <= f["layer_impact"] <= 3 for f in faces)
    zones = spark.createDataFrame([(1, 600.0, 600.0, 700.0, 700.0), (2, 5000.0, 5000.0, 5001.0, 5001.0)], "zone_id long, bx0 double, by0 double, bx1 double, by1 double")
    marks = {r["zone_id"]: r for r in frame.mark(built, zones).collect()}
    assert marks[1]["area"] == pytest.approx(10000) and marks[2]["score"] == 0
    twice = frame.merge_frames(built, built)
    assert twice.sources.count() == built.sources.count()


def test_the_boxes_of_an_object_are_one(spark):
    """The map of an object of two boxes that overlap is that of their union, and the space between isn't taken."""
    d = spark.createDataFrame([(1, "A", 0.0, 0.0, 100.0, 10.0), (2, "B", 90.0, 0.0, 100.0, 100.0)], "source_id long, name string, x0 double, y0 double, x1 double, y1 double")
    rule = frame.LayerRule(-4, 0.15, "x", merge_radius=10)
    built = frame.build_frame({"k": d}, {"k": rule}, tile=500.0)
    own = built.map.filter("is_source").collect()
    assert sum((f["fx1"] - f["fx0"]) * (f["fy1"] - f["fy0"]) for f in own) == pytest.approx(1900)
    assert {f["layer_impact"] for f in own} == {-4.0} and {r["total_impact_radius"] for r in built.sources.collect()} == {-600.0}
    points = spark.createDataFrame([(1, 50.0, 5.0), (2, 50.0, 50.0)], "point_id long, x double, y double")
    labels = spark.createDataFrame([("k", "x")], "type string, label string")
    found = {(r["point_id"], r["kind"]) for r in frame.influencers(built.sources, built.buffers, points, labels, 500.0).collect()}
    assert found == {(1, "source"), (2, "effect")}


def test_industrial_sources(spark):
    points = spark.createDataFrame([("Завод 1", 2, 5.0, 5.0), ("кафе", 1, 5.0, 5.0), (None, 1, 5.0, 5.0)], "name string, level int, x double, y double")
    boxes = spark.createDataFrame([(1, "X", 0.0, 0.0, 10.0, 10.0), (2, None, 100.0, 0.0, 110.0, 10.0), (3, "X", 0.0, 0.0, 10.0, 10.0)], "box_id long, name string, x0 double, y0 double, x1 double, y1 double")
    rows = frame.industrial_sources(points, boxes).collect()
    assert [(r["box_id"], r["name"], r["level"]) for r in rows] == [(1, "X, Завод 1", 2)]


def test_shapes(spark):
    d = spark.createDataFrame([(1, bytearray(wkb.box(0, 0, 10, 10)), bytearray(wkb.box(5, 5, 15, 15))), (1, bytearray(wkb.box(10, 0, 20, 10)), None)], "k int, a binary, b binary")
    r = d.select(shapes.area(F.col("a")).alias("area"), shapes.area(shapes.intersection(F.col("a"), F.col("b"))).alias("cut"), shapes.intersects(F.col("a"), F.col("b")).alias("hit"), shapes.geom_type(F.col("a")).alias("kind"), shapes.area(shapes.buffer(F.col("a"), 1.0)).alias("wide")).collect()
    assert r[0]["area"] == 100 and r[0]["cut"] == pytest.approx(25) and r[0]["hit"] and r[0]["kind"] == "Polygon" and r[1]["cut"] is None and r[0]["wide"] == pytest.approx(143.1, abs=0.2)
    assert shapes.dissolve(d, ["k"], "a", 5.0).select(shapes.area(F.col("a")).alias("v")).first()["v"] == pytest.approx(200)


def test_vectorised_tiles(spark, tmp_path):
    y, x = np.mgrid[0:24, 0:24]
    (tmp_path / "n59e030.tif").write_bytes(geotiff.encode(np.where(x < 12, 10.0, 30.0), 500000.0, 6000000.0, 10.0))
    tiles = geotiff.read_tiles(spark, str(tmp_path))
    rows = {r["value"]: r for r in vectorise.height_polygons(tiles, 10.0).collect()}
    assert all(r["error"] is None for r in rows.values())
    assert sum(plane.area(wkb.polygons(bytes(r["geom"]))) for r in rows.values()) == pytest.approx(230 * 230)
    assert vectorise.height_isolines(tiles, 10.0).count() >= 1
    slopes = vectorise.slope_polygons(tiles, 5.0, 0.0, metres=True).collect()
    assert {r["value"] for r in slopes} == {45.0}
    assert {r["label"] for r in vectorise.aspect_polygons(tiles, 90.0, metres=True).filter("error IS NULL").collect()} <= {"N", "E", "S", "W"}


def test_vector_cache_and_stitch(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 10.0, 10.0), ("b", 2.0, 10.0, 0.0, 20.0, 10.0)], "tile_name string, value double, x0 double, y0 double, x1 double, y1 double")
    vectors.write_layer(d, str(tmp_path / "v"), "slope_polygons", 2.0)
    tiles = d.drop("value")
    zone = spark.createDataFrame([(8.0, 2.0, 12.0, 4.0)], "bx0 double, by0 double, bx1 double, by1 double")
    out = vectors.stitch(spark, str(tmp_path / "v"), "slope_polygons", 2.0, tiles, zone, 50.0).collect()
    assert sorted((r["tile_name"], r["x0"], r["x1"], r["y0"], r["y1"]) for r in out) == [("a", 8, 10, 2, 4), ("b", 10, 12, 2, 4)]
    more = tiles.union(spark.createDataFrame([("c", 9.0, 0.0, 11.0, 10.0)], tiles.schema))
    with pytest.raises(Exception, match="not in the cache: c"):
        vectors.stitch(spark, str(tmp_path / "v"), "slope_polygons", 2.0, more, zone, 50.0).collect()


def test_tile_stream_resumes(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    handle = lambda df, n: seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.select("path").collect())
    for name in ("a.tif", "b.tif"):
        (source / name).write_bytes(b"x")
        T.process_new_tiles(spark, str(source), "*.tif", handle, str(tmp_path / "state"))
    assert seen == ["a.tif", "b.tif"]
    T.append_log(spark.createDataFrame([("a", "a.tif", "slope", "p", None, "1.5")], ", ".join(f"{c} string" for c in T.LOG_COLUMNS)), str(tmp_path / "log"))
    assert T.read_log(spark, str(tmp_path / "log")).first()["elapsed_sec"] == "1.5"


def test_folder_job_resumes_and_logs_errors(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    y, x = np.mgrid[0:16, 0:16]
    for name in ("n59e030", "n59e031"):
        (folder / f"{name}.tif").write_bytes(geotiff.encode(np.where(x < 8, 10.0, 30.0), 500000.0, 6000000.0, 10.0))
    (folder / "broken.tif").write_bytes(b"nothing")
    layers = {"height_polygons": (10.0, lambda t: vectorise.height_polygons(t, 10.0)), "slope_polygons": (5.0, lambda t: vectorise.slope_polygons(t, 5.0, 0.0, metres=True))}
    paths = str(folder), str(tmp_path / "out"), str(tmp_path / "log")
    T.vectorise_folder(spark, *paths, layers)
    log = T.read_log(spark, paths[2]).collect()
    assert len(log) == 6 and {r["tile_name"] for r in log if r["error"]} == {"broken"} and all(float(r["elapsed_sec"]) >= 0 for r in log)
    assert {r["tile_name"] for r in vectors.read_layer(spark, paths[1], "height_polygons", 10.0).collect()} == {"n59e030", "n59e031"}
    (folder / "broken.tif").write_bytes(geotiff.encode(np.where(x < 8, 10.0, 30.0), 0.0, 0.0, 10.0))
    T.vectorise_folder(spark, *paths, layers)
    again = T.read_log(spark, paths[2]).collect()
    assert len(again) == 8 and {r["tile_name"] for r in again if r["error"] is None} == {"n59e030", "n59e031", "broken"}


def test_raster_file_sets(spark):
    paths = ["/r/N059E030.TIF", "/r/n60e031.tif", "/f/RP10/ID7_x_RP10_depth.tif", "/f/RP10/ID7_a_RP10_depth.tif", "/f/RP30/ID7_x_RP30_depth.tif", *[f"/s/t1/{v}/{v}_0-5cm_mean.tif" for v in rasters.SOIL_VARIABLES]]
    files = spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in paths], "path string, file_name string")
    wanted = spark.createDataFrame([("n59e30.tif",), ("N60E031.tif",), ("n61e001.tif",)], "file_name string")
    assert {r["file_name"]: r["path"] for r in rasters.find_files(wanted, files).collect()} == {"n59e30.tif": paths[0], "N60E031.tif": paths[1], "n61e001.tif": None}
    flood = rasters.flood_files(spark.createDataFrame([(7,), (8,)], "id long"), files).collect()
    assert [(r["id"], r["period"], r["path"]) for r in flood] == [(7, 10, paths[3])]
    tiles = spark.createDataFrame([("t1",)], "tile_name string")
    soil = rasters.soil_files(tiles, files, "0-5cm")
    assert soil.count() == 4
    with pytest.raises(Exception, match="no soil raster: t2"):
        rasters.soil_files(spark.createDataFrame([("t2",)], "tile_name string"), files, "0-5cm").collect()
    read = spark.createDataFrame([(p, 1, 2, 0.0, 9.0, 1.0, 1.0, [float(i), 50.0]) for i, p in enumerate(paths[5:])], "path string, height int, width int, x_min double, y_max double, size_x double, size_y double, values array<double>")
    cells = sorted(rasters.soil_pixels(soil, read).collect(), key=lambda r: r["col"])
    assert [(r["x"], r["clay"], r["silt"], r["sand"], r["cfvo"]) for r in cells] == [(0.0, 0.0, 1.0, 2.0, 3.0), (1.0, 50.0, 50.0, 50.0, 50.0)]
    classes = vectorise.soil_areas(vectorise.soil_classes(rasters.soil_pixels(soil, read)), "tile_name").collect()
    assert {(r["tile_name"], r["n"]) for r in classes} == {("t1", 1)}
