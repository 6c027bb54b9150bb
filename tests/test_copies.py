"""Many rows of one place: work must not grow with the product of both sides. Each of these took minutes before."""

import time

import pytest
from pyspark.sql import functions as F

from verdigris.operators import components, frame, reports, river, spatial

MANY = 50_000
SECONDS = 60


@pytest.fixture
def bounded():
    began = time.time()
    yield
    assert time.time() - began < SECONDS


def test_nearest_of_many_copies(spark, bounded):
    points = spark.range(MANY).select(F.col("id").alias("p"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    nodes = spark.range(MANY).select((F.col("id") + 7).alias("n"), (F.lit(4.0) + 9 * (F.col("id") % 2)).alias("nx"), F.lit(6.0).alias("ny"))
    found = spatial.nearest(points, nodes, "p", "n").groupBy("n", "dist").count().collect()
    assert [tuple(r) for r in found] == [(7, 5.0, MANY)]


def _crowd(spark, inside: int):
    """Copies of a point and of a box beside it in one cell, and boxes that hold the point."""
    points = spark.range(MANY).select(F.col("id").alias("p"), F.lit(50.0).alias("x"), F.lit(50.0).alias("y"))
    far = spark.range(MANY).select((F.col("id") + 100).alias("b"), F.lit(60.0).alias("bx0"), F.lit(60.0).alias("by0"), F.lit(90.0).alias("bx1"), F.lit(90.0).alias("by1"))
    near = spark.range(inside).select(F.col("id").alias("b"), F.lit(40.0).alias("bx0"), F.lit(40.0).alias("by0"), (F.lit(60.0) + F.col("id")).alias("bx1"), F.lit(60.0).alias("by1"))
    return points, far.union(near)


def test_first_cover_of_many_copies(spark, bounded):
    points, boxes = _crowd(spark, 3)
    found = spatial.first_cover(points, boxes, 100.0, "p", "b").groupBy("b").count().collect()
    assert [tuple(r) for r in found] == [(0, MANY)]


def test_join_of_many_copies(spark, bounded):
    points, boxes = _crowd(spark, 3)
    at = points.select("p", *[F.col(c).alias(n) for c, n in (("x", "x0"), ("y", "y0"), ("x", "x1"), ("y", "y1"))])
    found = spatial.box_join(at, boxes, 100.0, predicate="within", copies=True)
    assert found.columns == [*at.columns, *boxes.columns]
    assert {tuple(r) for r in found.groupBy("b").count().collect()} == {(b, MANY) for b in range(3)}
    with pytest.raises(ValueError):
        spatial.box_join(at, boxes, 100.0, refine=F.lit(True), copies=True)


def test_join_of_rows_of_lists_and_without_others(spark):
    """More rows of a place, and boxes of one place, than a list holds; rows that lie alone; ids that are null."""
    points = spark.sql("SELECT CASE WHEN id > 0 THEN id END AS p, CASE WHEN id < 2500 THEN 5D ELSE CAST(id AS DOUBLE) END AS x0, -0D AS y0 FROM range(2600)").withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    boxes = spark.sql("SELECT CASE WHEN id > 0 THEN id END AS b, 'n' AS n, 0D AS bx0, 0D AS by0, CASE WHEN id < 1500 THEN 10D ELSE 2510D END AS bx1, 9D AS by1 FROM range(1600)")
    pairs = spatial.box_join(points, boxes, 100.0, predicate="within", copies=True)
    box = [c for c in boxes.columns if c.startswith("b") and c != "b"]
    for kept, other in ((points, boxes), (points, boxes.select(*box)), (points.drop("p"), boxes), (points.drop("p"), boxes.select(*box))):
        got = spatial.box_join(kept, other, 100.0, predicate="within", copies=True)
        assert got.columns == [*kept.columns, *other.columns] and got.count() == 2500 * 1600 + 11 * 100
    got = {tuple(r) for r in pairs.groupBy("p").agg(F.count(F.lit(1)), F.count("b"), F.count_distinct("b"), F.max("n")).collect()}
    assert got == {(p or None, 1600, 1599, 1599, "n") for p in range(2500)} | {(p, 100, 100, 100, "n") for p in range(2500, 2511)}


def test_pairs_of_places_are_small_in_files(spark, tmp_path):
    points = spark.range(4000).select((F.col("id") * 7919).alias("p"), *[F.lit(50.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    boxes = spark.range(1000).select((F.col("id") * 104729).alias("b"), F.lit(40.0).alias("bx0"), F.lit(40.0).alias("by0"), (F.lit(60.0) + F.col("id") % 10).alias("bx1"), F.lit(60.0).alias("by1"))
    pairs = spatial.box_join(points, boxes, 100.0, predicate="within", copies=True).select("p", "b")
    pairs.write.parquet(f"file://{tmp_path}/pairs")
    written = spark.read.parquet(f"file://{tmp_path}/pairs")
    assert written.count() == written.distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1_500_000


def _sources(spark, n: int):
    """Sources of one place and name beside the point (50, 50), and one over it."""
    far = spark.range(n).select((F.col("id") + 100).alias("source_id"), F.array(F.lit("far")).alias("names"), F.lit(-4).alias("impact"), F.lit(60.0).alias("x0"), F.lit(90.0).alias("x1"))
    near = spark.range(1).select(F.col("id").alias("source_id"), F.array(F.lit("near")).alias("names"), F.lit(-8).alias("impact"), F.lit(40.0).alias("x0"), F.lit(52.0).alias("x1"))
    s = far.union(near).withColumns({"type": F.lit("t"), "y0": F.col("x0"), "y1": F.col("x1"), "total_impact_radius": F.lit(20.0)})
    buffers = s.select("source_id", *[(F.col(c) + d).alias(c) for c, d in (("x0", -20), ("y0", -20), ("x1", 20), ("y1", 20))])
    return s, buffers, spark.createDataFrame([("t", "label")], "type string, label string")


def test_influencers_of_many_copies(spark, bounded):
    points, _ = _crowd(spark, 0)
    s, b, labels = _sources(spark, MANY)
    found = frame.influencers(s, b, points.withColumnRenamed("p", "point_id"), labels, 100.0)
    got = {tuple(r) for r in found.groupBy("kind", "sign", "name", "type", "radius").count().collect()}
    assert got == {("source", "negative", "near", "label", 20.0, MANY), ("effect", "negative", "near", "label", 20.0, MANY), ("effect", "negative", "far", "label", 20.0, MANY)}


def test_influencers_of_an_id_at_two_places(spark):
    s, b, labels = _sources(spark, 2)
    points = spark.createDataFrame([(1, 50.0, 50.0), (1, 50.5, 50.5), (1, 500.0, 500.0)], "point_id long, x double, y double")
    assert sorted((r.kind, r.name) for r in frame.influencers(s, b, points, labels, 100.0).collect()) == [("effect", "far"), ("effect", "near"), ("source", "near")]


def test_influences_of_places_are_small_in_files(spark, tmp_path):
    points, _ = _crowd(spark, 0)
    s, b, labels = _sources(spark, 40)
    s = s.withColumn("names", F.array(F.concat(F.lit("far "), F.col("source_id"))))
    found = frame.influencers(s, b, points.select((F.col("p") * 7919).alias("point_id"), "x", "y"), labels, 100.0)
    found.write.parquet(f"file://{tmp_path}/found")
    written = spark.read.parquet(f"file://{tmp_path}/found")
    assert written.count() == written.distinct().count() == 42 * MANY
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 2_000_000


def test_texts_of_many_copies(spark, bounded):
    points, _ = _crowd(spark, 0)
    points = points.withColumnRenamed("p", "point_id").union(spark.sql("SELECT -1L, 500D, 500D")).union(spark.sql("SELECT -2L, CAST(NULL AS DOUBLE), 500D"))
    s, b, labels = _sources(spark, MANY)
    texts = {r.report: r["count"] for r in reports.point_texts(s, b, points, labels, 100.0).groupBy("report").count().collect()}
    assert texts.pop(reports.NO_INFLUENCE) == 2 and list(texts.values()) == [MANY]
    few = points.filter("point_id = 0")
    assert list(texts) == [reports.influencer_texts(frame.influencers(s, b, few, labels, 100.0), few).first().report]


def test_texts_of_a_part_begin_with_the_longest(spark):
    """A writer takes the size of rows from those before, so it would hold all long texts that come after short ones."""
    at = F.when(F.col("id") % 3 > 0, -500.0 * (F.col("id") % 3)).otherwise(50.0)
    points = spark.range(6000).select(F.col("id").alias("point_id"), at.alias("x"), at.alias("y"))
    s, b, labels = _sources(spark, 40)
    found = reports.point_texts(s, b, points, labels, 100.0).select("point_id", F.length("report").alias("n"), F.monotonically_increasing_id().alias("i")).collect()
    assert {(r.point_id, r.n > 100) for r in found} == {(i, i % 3 == 0) for i in range(6000)} and len(found) == 6000
    parts = {}
    for r in sorted(found, key=lambda r: r.i):
        parts.setdefault(r.i >> 33, []).append(r.n)
    assert all(n == sorted(n, reverse=True) for n in parts.values())


def test_lists_hold_all_rows_and_few_each(spark):
    rows = spark.sql("SELECT id % 3 AS k, CASE WHEN id % 5 > 0 THEN id END AS a, CASE WHEN id > 9 THEN 'x' END AS b FROM range(9000)")
    for rest in (["a"], ["a", "b"], []):
        lists = spatial.listed(rows.select("k", *rest), ["k"])
        assert lists.agg(F.max(F.size("_rows"))).first()[0] == spatial.LIST and lists.count() == 9
        got = spatial.unlisted(lists.drop("_n"), rest) if rest else lists.select(F.explode("_rows"), "k").select("k")
        assert sorted(map(str, got.select("k", *rest).collect())) == sorted(map(str, rows.select("k", *rest).collect()))


def _works(spark):
    """Points of two names at one place, boxes of one place around them with and without a name, and one box far off."""
    points = spark.range(MANY).select(F.concat(F.lit("Завод "), F.col("id") % 2).alias("name"), (F.col("id") % 2 + 1).cast("int").alias("level"), F.lit(50.0).alias("x"), F.lit(50.0).alias("y"))
    boxes = spark.range(MANY).select(F.col("id").alias("box_id"), F.when(F.col("id") % 2 == 0, F.lit("Завод 00")).alias("name"), F.lit(40.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(60.0).alias("y1"))
    return points, boxes.union(spark.sql("SELECT -1L, 'far', 500D, 500D, 510D, 510D"))


def test_points_into_boxes_of_many_copies(spark, bounded):
    points, boxes = _works(spark)
    got = {tuple(r) for r in frame.points_into_boxes(points, boxes, 10.0, 100.0).groupBy("name", "level").count().collect()}
    assert got == {("Завод 0, Завод 00, Завод 1", 2, MANY // 2), ("Завод 0, Завод 1", 2, MANY // 2), ("far", 4, 1)}


def test_industrial_sources_look_at_two_boxes_a_place(spark, bounded, monkeypatch):
    points, boxes = _works(spark)
    seen, whole = [], frame.points_into_boxes
    monkeypatch.setattr(frame, "points_into_boxes", lambda p, b, *rest: seen.append(b.count()) or whole(p, b, *rest))
    bare = spark.sql("SELECT id + 200000 AS box_id, CASE WHEN id = 1 THEN 'own' END name, 900D x0, 900D y0, 910D x1, 910D y1 FROM range(3)")
    got = {(r.box_id, r.name, r.level) for r in frame.industrial_sources(points, boxes.union(bare), 10.0, 100.0).collect()}
    assert got == {(0, "Завод 0, Завод 00, Завод 1", 2), (-1, "far", 4), (200001, "own", 4)}
    assert seen == [4]  # the first of each place, and the first with a name where that is another


def test_components_of_many_copies(spark, bounded):
    boxes = spark.range(3 * MANY).select((F.col("id") + 5).alias("source_id"), (F.col("id") % 3 * F.lit(15.0)).alias("x0"), F.lit(0.0).alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 4 + F.when(F.col("x0") == 0, 10.0).otherwise(0.0), "y1": F.lit(4.0)})
    found = components.buffer_components(boxes, 1.0, 100.0)
    assert sorted(tuple(r) for r in found.groupBy("component").count().collect()) == [(5, 2 * MANY), (7, MANY)]


def test_spills_of_many_sources_of_one_node_are_one_portion(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (2, 4, 1.0), (3, 5, 2.0)], "src long, dst long, cost double")
    sources = spark.range(MANY).select(F.col("id").alias("source_id"), (F.col("id") % 2).alias("node"), (F.lit(50.0) + F.col("id") % 2).alias("pollution"))
    few = {r.node: r.remain for r in river.remain_by_node(river.propagate(edges, sources.limit(0).union(sources.filter("source_id < 2")))).collect()}
    seen, whole = [], river.propagate
    monkeypatch.setattr(river, "propagate", lambda e, s: seen.append(s.count()) or whole(e, s))
    got = {r.node: r.remain for r in river.spilled(edges, sources).collect()}
    assert seen == [2]
    assert got == pytest.approx({n: v * MANY / 2 for n, v in few.items()})


def test_spills_and_their_edges_broadcast_nothing(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0)], "src long, dst long, cost double")
    nodes = spark.createDataFrame([(0, 9.0), (1, 7.0), (2, 1.0)], "node long, remain double")
    for only in (True, False):
        found = river.edge_remain(edges, nodes, only)
        assert {(r.src, r.dst): r.remain for r in found.collect()} == {(0, 1): 8.0, (1, 2): 4.0} | ({} if only else {(1, 3): 0.0})
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def test_first_cover_of_many_boxes_over_each_other(spark, bounded):
    n, side = 20_000, 40
    spread = spark.range(n).select(F.col("id").alias("b"), *[(F.hash("id", F.lit(k)) % 97 + 100.0 * sign).cast("double").alias(c) for k, (c, sign) in enumerate((("bx0", -1), ("by0", -1), ("bx1", 1), ("by1", 1)))])
    small = spark.createDataFrame([(-1, 0.25, 0.25, 1.25, 1.25), (-2, 100.0, 0.0, 100.0, 25.0), (-3, 7.5, -50.0, 25.0, 50.0)], "b long, bx0 double, by0 double, bx1 double, by1 double")
    boxes = spread.union(small)
    points = spark.range(n).select(F.col("id").alias("p"), (F.col("id") % side * 6.25 - 125.0).alias("x"), (F.col("id") / side).cast("int") * 0.5 - 125.0)
    points = points.toDF("p", "x", "y")
    got = {(r.p, r.b) for r in spatial.first_cover(points, boxes, 100.0, "p", "b").collect()}
    rows = sorted(tuple(r) for r in boxes.collect())
    want = set()
    for r in points.filter("p % 37 = 0").collect():
        want |= {(r.p, b) for b in [next((b for b, x0, y0, x1, y1 in rows if x0 <= r.x <= x1 and y0 <= r.y <= y1), None)] if b is not None}
    assert {(p, b) for p, b in got if p % 37 == 0} == want
