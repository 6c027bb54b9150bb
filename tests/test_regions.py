"""Regions of boxes, river networks from water, prepared layers and texts, against grids and plain Python."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from verdigris.operators import frame, regions, reports, river, vectorise

SCHEMA = "source_id long, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, seed, n=25, wide=60, size=18):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(wide), rng.randrange(wide)
        rows.append((i, float(x), float(y), float(x + rng.randint(1, size)), float(y + rng.randint(1, size))))
    return rows, spark.createDataFrame(rows, SCHEMA)


def cells(rows):
    return {(i, j) for _, x0, y0, x1, y1 in rows for i in range(int(x0), int(x1)) for j in range(int(y0), int(y1))}


def covered(df):
    """Unit cells of whole-number boxes; they must not overlap."""
    found = [(i, j) for r in df.collect() for i in range(int(r["x0"]), int(r["x1"])) for j in range(int(r["y0"]), int(r["y1"]))]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize(("seed", "buffer"), [(1, 0), (2, 2), (3, 5), (4, 9)])
def test_closing_against_a_grid(spark, seed, buffer):
    rows, df = boxes(spark, seed, 15)
    wide = cells([(i, a - buffer, b - buffer, c + buffer, d + buffer) for i, a, b, c, d in rows])
    near = [(i, j) for i in range(-buffer, buffer + 1) for j in range(-buffer, buffer + 1)]
    want = {(i, j) for i, j in wide if all((i + a, j + b) in wide for a, b in near)}
    assert want >= cells(rows)
    for tile in (7.0, 40.0, 1000.0):
        assert covered(regions.closed(df, float(buffer), tile)) == want


def test_closing_of_odd_inputs(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, None, 0.0, 1.0, 1.0), (3, 3.0, 0.0, 5.0, 2.0), (3, 3.0, 0.0, 5.0, 2.0)], SCHEMA)
    assert covered(regions.closed(df, 1.0, 50.0)) == {(i, j) for i in range(5) for j in range(2)}
    assert regions.closed(df.limit(0), 1.0, 50.0).count() == 0
    keyed = regions.closed(df.withColumn("k", F.col("source_id") % 2), 1.0, 50.0, ["k"]).groupBy("k").count().collect()
    assert {r["k"] for r in keyed} == {1}


def test_sweep_subtracts(spark):
    rows, df = boxes(spark, 8)
    minus, other = boxes(spark, 9)
    both = df.withColumns({"p": F.lit(1), "n": F.lit(0)}).unionByName(other.withColumns({"p": F.lit(0), "n": F.lit(1)})).withColumn("k", F.lit(1))
    assert covered(regions.swept(both, ["k"], ["p", "n"], lambda c: (c["p"] > 0) & (c["n"] == 0))) == cells(rows) - cells(minus)
    assert covered(regions.swept(both, ["k"], ["p", "n"], lambda c: (c["p"] > 1) & (c["n"] > 0))) <= cells(rows) & cells(minus)


def test_regions_of_pixels(spark):
    """Regions of equal class and their rectangles, against a flood fill."""
    rng = random.Random(4)
    values = {(r, c): rng.choice("aab") for r in range(20) for c in range(30) if rng.random() < 0.9}
    df = spark.createDataFrame([(r, c, v, 5.0, 700.0, 10.0, 20.0) for (r, c), v in values.items()] + [(None, 1, "a", 5.0, 700.0, 10.0, 20.0)], "row int, col int, cls string, x_min double, y_max double, size_x double, size_y double")
    merged = regions.pixel_regions(df.union(df), ["cls"])
    assert merged.count() < len(values)
    assert merged.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).first()[0] == 200 * len(values)
    for cell in (15.0, 1000.0):
        got = sorted((r["cls"], r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in regions.region_facts(regions.dissolved_regions(merged, ["cls"], cell), ["cls"]).collect())
        left, want = set(values), []
        while left:
            stack = [left.pop()]
            own = list(stack)
            while stack:
                r, c = stack.pop()
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if n in left and values[n] == values[own[0]]:
                        left.discard(n)
                        stack.append(n)
                        own.append(n)
            rs, cs = [r for r, _ in own], [c for _, c in own]
            want.append((values[own[0]], 200.0 * len(own), 5.0 + 10 * min(cs), 680.0 - 20 * max(rs), 15.0 + 10 * max(cs), 700.0 - 20 * min(rs)))
        assert got == sorted(want)


def test_regions_of_null_values(spark):
    df = spark.createDataFrame([(None, 0.0, 0.0, 1.0, 4.0), (None, 1.0, 1.0, 2.0, 2.0), (None, 2.0, 2.0, 3.0, 3.0), (5.0, 1.0, 0.0, 2.0, 1.0)], "v double, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["v"] or 0, r["area"]) for r in regions.region_facts(regions.dissolved_regions(df, ["v"], 10.0), ["v"]).collect())
    assert got == [(0, 1.0), (0, 5.0), (5.0, 1.0)]  # a corner joins nothing
    assert regions.dissolved_regions(df.limit(0), ["v"], 10.0).count() == 0


def layer(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", dangerous_level int, name string")


def test_radius_comes_before_merging(spark):
    """Of merged objects, each has the radius of its own level and area; the strongest stays."""
    d = layer(spark, [(1, 0.0, 0.0, 10.0, 10.0, 4, "a"), (2, 15.0, 0.0, 25.0, 10.0, 1, "b")])
    assert {(r["source_id"], r["impact"], r["total_impact_radius"]) for r in frame.prepare_layer(d, "industrial", frame.RULES["industrial"]).collect()} == {(1, -10.0, -8000.0)}
    d = layer(spark, [(1, 0.0, 0.0, 100.0, 100.0, 1, "a"), (2, 105.0, 0.0, 205.0, 100.0, 1, "b")])
    assert {r["total_impact_radius"] for r in frame.prepare_layer(d, "landfill", frame.RULES["landfill"]).collect()} == {-1685.9}


def test_woods_are_united_and_closed(spark):
    d = layer(spark, [(7, 0.0, 0.0, 1000.0, 1000.0, 1, "a"), (8, 1400.0, 0.0, 2000.0, 1000.0, 1, None), (9, 5000.0, 0.0, 5001.0, 1.0, 1, "c"), (10, 4000.0, 0.0, 4000.0, 9.0, 1, "a line")])
    got = frame.prepare_layer(d, "woods", frame.RULES["woods"]).collect()
    assert {(r["source_id"], tuple(r["names"]), r["impact"]) for r in got} == {(7, ("Зелёная зона",), 3.0)}
    assert sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in got) == 2_000_000 + 1


def test_map_in_regions(spark):
    d = layer(spark, [(1, 0.0, 0.0, 100.0, 100.0, 1, "a"), (2, 90.0, 90.0, 220.0, 220.0, 1, "b")])
    rule = frame.LayerRule(-4, 0.02, "x")
    for tile in (64.0, 1000.0):
        built = frame.build_frame({"k": d}, {"k": rule}, tile=tile)
        facts = regions.region_facts(frame.dissolved_map(built), ["layer_impact", "is_source"]).collect()
        own = sorted((r["layer_impact"], r["area"]) for r in facts if r["is_source"])
        assert own[0][0] == -4.0 and sum(a for _, a in own) == 100 * 100 + 130 * 130 - 100
        total = built.map.agg(F.sum((F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0")))).first()[0]
        assert sum(r["area"] for r in facts) == pytest.approx(total)
    own = frame.build_frame({"k": d}, {"k": rule}, fading=lambda impact, n, i: impact - i, combine=lambda c: F.min(c))
    assert {r["layer_impact"] for r in own.map.collect()} >= {-4.0, -5.0}
    again = frame.merge_frames(own, own, fading=lambda impact, n, i: impact - 10 * i, combine=lambda c: F.min(c))
    assert {r["layer_impact"] for r in again.map.collect()} >= {-4.0, -14.0}


def test_width_of_the_water_that_holds_the_vertex(spark):
    """A river along x = 500 to 900; body 1 has two basins that touch and one apart, body 2 lies over part of it."""
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, "R"), (1, 2, 0.0, 400.0, "R"), (1, 3, 0.0, 800.0, "R"), (2, 1, 5000.0, 0.0, None), (3, 1, 9000.0, 9000.0, "S"), (3, 2, 9300.0, 9300.0, "S")], "line_id long, pos int, x double, y double, name string")
    water = spark.createDataFrame([(1, -50.0, -10.0, 0.0, 900.0), (1, 0.0, 350.0, 120.0, 900.0), (1, 300.0, 350.0, 900.0, 900.0), (2, -700.0, 700.0, 4000.0, 900.0), (3, 9250.0, 9250.0, 9500.0, 9500.0)], "water_id long, bx0 double, by0 double, bx1 double, by1 double")
    for cell in (100.0, 5000.0):
        edges, nodes = river.water_graph(lines, water, 400.0, 50_000.0, cell=cell)
        width = {(r["x"], r["y"]): round(r["width"], 6) for r in nodes.collect()}
        assert width[0.0, 0.0] == 50.0 and width[0.0, 400.0] == 170.0 and width[0.0, 800.0] == 170.0  # the first body counts
        assert width[9000.0, 9000.0] == 5.0 and width[9300.0, 9300.0] == pytest.approx(2 * 50 * 2**0.5, abs=1e-5) or cell
        rows = edges.collect()
        assert {r["name"] for r in rows} == {"R", "S"}
        first = next(r for r in rows if r["y2"] == 400.0)
        assert first["width"] == 110.0 and first["weight"] == pytest.approx(110 * 400 / 50)
    _, nodes = river.water_graph(lines, water, 400.0, 60.0, cell=10.0)
    assert {(r["x"], r["y"]): r["width"] for r in nodes.collect()}[0.0, 400.0] == 60.0  # not beyond the widest
    edges, nodes = river.water_graph(lines.limit(0), water, 400.0)
    assert edges.count() == 0 and nodes.count() == 0
    assert {r["width"] for r in river.water_graph(lines, water.limit(0))[1].collect()} == {5.0}


def test_segments_meet_at_the_given_vertices(spark):
    lines = spark.createDataFrame([(i, p, 0.1 * i + p * 977.7, p * 333.3 + 0.7) for i in range(3) for p in range(4)], "line_id long, pos int, x double, y double")
    parts = river.segmentised(river.vertex_pairs(lines), 100.0)
    ends = {(r["x2"], r["y2"]) for r in parts.collect()}
    assert {(r["x"], r["y"]) for r in lines.filter("pos > 0").collect()} <= ends
    assert parts.agg(F.max("length")).first()[0] <= 100.0


def test_edges_of_equal_remain(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 7.0), (4, 5, 5.0), (9, 8, 5.0), (8, 7, 5.0), (20, 21, None)], "src long, dst long, remain double")
    assert sorted((r["remain"] or 0, r["edges"]) for r in river.dissolved_edges(e).collect()) == [(0, 1), (5.0, 1), (5.0, 2), (5.0, 2), (7.0, 1)]


def test_names_are_cut_at_words(spark):
    rng = random.Random(1)
    words = ["Завод", "well-known", "a-b", "x" * 30, "y" * 90, "и", "3-4", "пром-площадка", "ООО", "semi--final", " end", "tail"]
    texts = ["", " ", "short", "z" * 70, "z" * 71, "a " * 34 + "bb", "a " * 35 + "b"] + [("  " if i % 3 else " \n").join(rng.choice(words) for _ in range(rng.randint(1, 25))) for i in range(300)]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", reports.shortened(F.col("t")).alias("s")).collect()}
    off = [(t, got[i], textwrap.shorten(t, 70, placeholder="...")) for i, t in enumerate(texts) if got[i] != textwrap.shorten(t, 70, placeholder="...")]
    assert not off


def test_texts_of_points_and_marks(spark):
    points = spark.createDataFrame([(1,), (2,)], "point_id long")
    found = spark.createDataFrame([(1, "effect", "negative", "B", "АЗС", 600.0), (1, "source", "negative", None, None, None), (1, "effect", "negative", "A", "АЗС", 600.0)], "point_id long, kind string, sign string, name string, type string, radius double")
    got = {r["point_id"]: r["report"] for r in reports.influencer_texts(found, points).collect()}
    bar = "-" * 40
    assert got[2] == "Нет данных о влияющих объектах"
    assert got[1] == (
        f"\n=== Источники негативного воздействия ===\n\n• Название: Нет названия\n• Тип: Неизвестно\n• Радиус воздействия: Нет данных\n{bar}\n\n"
        f"\n=== Влияние от негативных источников ===\n\n• Название: A\n• Тип: АЗС\n• Радиус воздействия: 600.0\n{bar}\n\n• Название: B\n• Тип: АЗС\n• Радиус воздействия: 600.0\n{bar}"
    )
    marks = spark.createDataFrame([(1, 2.5, 0.0, 120.5), (2, 4.0, 2.25, 0.0)], "zone_id long, score double, mean_impact double, area double")
    texts = {r["zone_id"]: r["text"] for r in reports.mark_texts(marks, spark.createDataFrame([(1, "отчёт")], "zone_id long, report string")).collect()}
    assert texts[1].startswith("Полная оценка территории:\n  Абсолютная оценка: 2.5\n  Описание объектов: Проектная территория имеет оценку 2.5 балла") and "Интерпретация оценки: отчёт\n\n  Площадь: 120.5\n" in texts[1]
    assert "Абсолютная оценка: 4\n" in texts[2] and texts[2].endswith("Площадь: Неизвестно\n")


def test_soil_and_flood_of_several_rasters(spark):
    rows = [("a", r, c, 20.0, 40.0, 40.0, float(10 * c), 0.0, 100.0, 10.0, 10.0) for r in range(3) for c in range(4)] + [("b", 0, 0, 20.0, 40.0, 40.0, 100.0, 40.0, 100.0, 10.0, 10.0), ("b", 0, 1, 0.0, 0.0, 0.0, 1.0, 40.0, 100.0, 10.0, 10.0)]
    soil = spark.createDataFrame(rows, "tile_name string, row int, col int, clay double, silt double, sand double, cfvo double, x_min double, y_max double, size_x double, size_y double")
    out = vectorise.soil_polygons(soil).collect()
    assert sorted((r["x0"], r["y0"], r["x1"], r["y1"], r["coarse"]) for r in out) == [(0, 70, 40, 100, 22), (40, 90, 50, 100, 22)]
    zones = spark.createDataFrame([(1, 35.0, 95.0, 45.0, 200.0), (2, 500.0, 0.0, 600.0, 1.0)], "zone_id int, bx0 double, by0 double, bx1 double, by1 double")
    assert sorted((r["zone_id"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in vectorise.soil_polygons(soil, zones).collect()) == [(1, 35, 95, 40, 100), (1, 40, 95, 45, 100)]
    flood = soil.select("row", "col", (F.col("cfvo") / 100).alias("value"), "x_min", "y_max", "size_x", "size_y", F.lit(10).alias("period"))
    got = {(r["period"], r["depth_m"]): r for r in vectorise.flood_polygons(flood.filter("x_min = 0"), keys=["period"]).collect()}
    assert set(got) == {(10, 0.1), (10, 0.2), (10, 0.3)} and (got[10, 0.1]["x0"], got[10, 0.1]["y0"], got[10, 0.1]["y1"]) == (10.0, 70.0, 100.0)


def test_tiles_that_are_cut_to_quarters(spark):
    """However tiles are cut, the map is the same; copies of one box and boxes over whole tiles cut nothing."""
    from verdigris.operators import overlay

    rng = random.Random(6)
    rows = []
    for i in range(300):
        x, y = rng.random() ** 3 * 90, rng.random() ** 3 * 90  # crowded in a corner
        rows.append((i % 3, x, y, x + rng.random() * 9, y + rng.random() * 9, -1.0 - i % 4, i % 5 == 0))
    rows += [(0, 0.0, 0.0, 100.0, 100.0, -2.0, False)] * 40
    df = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double, impact double, is_source boolean")
    results = []
    for tile, most in ((100.0, None), (100.0, 15), (33.0, 4)):
        dealt = overlay.dealt_to_tiles(df, ["k"], tile, most)
        assert most is None or dealt.agg(F.max("lvl")).first()[0] > 0
        faces = overlay.overlay(df, ["k"], tile, most=most)
        results.append(sorted((r["k"], r["layer_impact"], r["is_source"], round(r["area"], 6)) for r in overlay.dissolved(faces, ["k", "layer_impact", "is_source"]).collect()))
    assert results[0] == results[1] == results[2]
    same = df.filter("impact = -2 AND x1 = 100")
    assert overlay.dealt_to_tiles(same, ["k"], 64.0, 1).agg(F.max("lvl")).first()[0] == 0
    assert overlay.dealt_to_tiles(df.limit(0), ["k"], 64.0, 1).count() == 0


def test_sources_alike_are_one_shape(spark):
    d = layer(spark, [(1, 0.0, 0.0, 100.0, 100.0, 1, "a"), (2, 50.0, 50.0, 150.0, 150.0, 1, "b"), (3, 2000.0, 0.0, 2100.0, 100.0, 3, "c")])
    rule = frame.LayerRule(("dangerous_level", lambda c: -3 * c), 0.01, "x")
    built = frame.build_frame({"k": d}, {"k": rule}, tile=500.0)
    own = built.map.filter("is_source").groupBy("layer_impact").agg(F.sum((F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0"))).alias("a")).collect()
    assert {(r["layer_impact"], r["a"]) for r in own} == {(-3.0, 17500.0), (-9.0, 10000.0)}


def test_ring_counts_of_another_frame(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 1, "a"), (2, 500.0, 0.0, 510.0, 10.0, 3, "b")]
    rule = frame.LayerRule(("dangerous_level", lambda c: -c), 0.1, "x")
    first = frame.build_frame({"k": layer(spark, rows)}, {"k": rule}, least_layers=3, most_layers=7)
    count = lambda f: {r["source_id"]: r["layers_count"] for r in f.sources.collect()}
    assert count(first) == {1: 3, 2: 7}
    d = layer(spark, [*rows, (3, 900.0, 0.0, 910.0, 10.0, 5, "c"), (4, 900.0, 500.0, 910.0, 510.0, 2, "d")])
    assert count(frame.build_frame({"k": d}, {"k": rule}, least_layers=2, most_layers=4, settings_from=first)) == {1: 3, 2: 7, 3: 11, 4: 5}


def test_projection_against_the_kernel(spark):
    import numpy as np

    from verdigris.functions import coordinates
    from verdigris.geometry import projection

    rng = np.random.default_rng(2)
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, 200), rng.uniform(-80, 84, 200)))] + [(200, 0.0, 0.0), (201, 180.0, 10.0), (202, None, 5.0)]
    df = spark.createDataFrame(places, "i int, x double, y double").withColumn("srid", coordinates.utm_srid(F.col("x"), F.col("y")))
    there = coordinates.reprojected(df, 4326, F.col("srid"), [("x", "y")])
    back = {r["i"]: r for r in coordinates.reprojected(there, F.col("srid"), 4326, [("x", "y")]).collect()}
    for r in there.collect():
        i, lon, lat = places[r["i"]]
        if lon is None:
            assert r["x"] is None and back[i]["x"] is None
            continue
        assert r["srid"] == projection.utm_srid(lon, lat)
        want = projection.to_utm(np.array([[lon, lat]]), r["srid"])[0]
        assert abs(r["x"] - want[0]) < 1e-6 and abs(r["y"] - want[1]) < 1e-6
        assert abs(back[i]["x"] - lon) < 1e-8 and abs(back[i]["y"] - lat) < 1e-8
    nodes = spark.createDataFrame([(1, 30.0, 60.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 30.0, 60.0, 30.1, 60.1)], "src long, dst long, x double, y double, x2 double, y2 double")
    n, e = coordinates.reprojected_graph(nodes, edges, 4326, 32636)
    assert (n.first()["x"], n.first()["y"]) == (e.first()["x"], e.first()["y"]) and e.first()["x2"] > e.first()["x"]
    with pytest.raises(ValueError, match="no coordinate system"):
        coordinates.reprojected_graph(nodes, edges, None, 32636)
    with pytest.raises(Exception, match="not a UTM zone: 3857"):
        coordinates.reprojected(nodes, 3857, 4326, [("x", "y")]).collect()
    boxes_ = spark.createDataFrame([(29.0, 59.0, 31.0, 61.0), (None, float("nan"), 33.0, 61.5)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(coordinates.total_bounds(boxes_).first()) == (29.0, 59.0, 33.0, 61.5) and coordinates.estimated_srid(boxes_).first()[0] == 32636
    assert coordinates.estimated_srid(boxes_.limit(0)).first()[0] is None


def test_river_of_many_confluences(spark):
    """Pollution goes through all confluences in one round."""
    n = 300
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)] + [(1000 + i, i, 0.5) for i in range(n)], "src long, dst long, cost double")
    sources = spark.createDataFrame([(0, 1000, 1e4), (1, 1100, 50.0), (2, 5000, 7.0)], "source_id long, node long, pollution double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("river", "river")
    got = {(r["source_id"], r["node"]): r["remain"] for r in river.propagate(edges, sources).collect()}
    jobs = len(tracker.getJobIdsForGroup("river"))
    spark.sparkContext.setJobGroup("", "")
    want = {(0, 1000): 1e4, (1, 1100): 50.0, (2, 5000): 7.0} | {(0, i): 1e4 - 0.5 - i for i in range(n + 1)} | {(1, 100 + i): 49.5 - i for i in range(50)}
    assert got == want and jobs < 60
    with pytest.raises(ValueError, match="circles without cost"):
        river.propagate(spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0)], "src long, dst long, cost double"), sources.withColumn("node", F.lit(1).cast("long")))
    round_ = river.propagate(spark.createDataFrame([(1, 2, 3.0), (2, 1, 4.0)], "src long, dst long, cost double"), spark.createDataFrame([(0, 1, 15.0)], "source_id long, node long, pollution double"))
    assert sorted((r["node"], r["remain"]) for r in round_.collect()) == [(1, 1.0), (1, 8.0), (1, 15.0), (2, 5.0), (2, 12.0)]


def test_nodes_are_numbered_alike_in_ranges(spark, monkeypatch):
    rng = random.Random(9)
    lines = spark.createDataFrame([(i * 3, p, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(60) for p in range(5)], "line_id long, pos int, x double, y double")
    one = sorted(map(tuple, river.interned(lines).collect()))
    monkeypatch.setattr(river, "LINES_OF_RANGE", 7)
    assert sorted(map(tuple, river.interned(lines).collect())) == one and [r[0] for r in one] == list(range(len(one)))
