"""Equal boxes of a tile are one row of the overlay, with their number."""

import numpy as np
from pyspark.sql import functions as F

from verdigris.operators import overlay


def _copies(spark, n: int):
    return spark.range(n).select(F.lit(1).alias("k"), F.lit(-3.0).alias("impact"), (F.col("id") == 0).alias("is_source"), (-F.col("id")).cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"))


def test_boxes_over_a_whole_tile_are_two_rows(spark):
    found = overlay.faces(_copies(spark, 500), ["k"], 10.0, counted=True).filter("cx = 0 AND cy = 0")
    assert sorted((r.is_source, r.copies) for r in found.collect()) == [(False, 499), (True, 1)]


def test_copies_count_in_sums_and_in_combiners_of_ones_own(spark):
    caps = spark.sql("SELECT 100D most, -100D least")
    boxes = _copies(spark, 4).withColumn("x0", F.lit(0.0))
    assert [r.layer_impact for r in overlay.overlay(boxes, ["k"], 5.0, caps).collect()] == [-6.0] * 4
    assert [r.layer_impact for r in overlay.overlay(boxes.limit(1), ["k"], 5.0, caps).collect()] == [-3.0] * 4
    assert [r.layer_impact for r in overlay.overlay(boxes, ["k"], 5.0, caps, combine=F.sum).collect()] == [-12.0] * 4
    assert {(r.layer_impact, r.is_source) for r in overlay.overlay(boxes, ["k"], 5.0, caps, combine=F.min, once=True).collect()} == {(-3.0, True)}


def test_boxes_of_a_source_are_painted_and_never_paired_with_faces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, side = 400, 40
    x0, y0 = rng.integers(0, side - 12, (2, n))
    rows = [("a" if i % 2 else "b", int(i % 4), -float(1 + i % 4), i % 4 == 0, float(x), float(y), float(x + 4 + i % 9), float(y + 3 + i % 8)) for i, (x, y) in enumerate(zip(x0, y0))]
    boxes = spark.createDataFrame(rows, "of string, level int, impact double, is_source boolean, x0 double, y0 double, x1 double, y1 double")
    expected = {}
    for of in "ab":
        least = np.full((side, side), 9)
        for o, level, *_, ax, ay, bx, by in rows:
            if o == of:
                cut = least[int(ay) : int(by), int(ax) : int(bx)]
                np.minimum(cut, level, out=cut)
        for y, x in zip(*np.nonzero(least < 9)):
            expected.setdefault((x, y), []).append(int(least[y, x]))
    monkeypatch.setattr(overlay, "faces", None)  # pairs of faces and boxes: some 25,000 here, of 1,600 cells
    caps = spark.sql("SELECT 100D most, -100D least")
    assert overlay.seen_faces(boxes.union(boxes), [], 8.0, "of", 20).agg(F.sum((F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0")))).first()[0] == sum(map(len, expected.values()))
    got = {}
    for r in overlay.overlay(boxes.union(boxes), [], 8.0, caps, source="of", most=20).collect():
        for x in range(int(r.fx0), int(r.fx1)):
            for y in range(int(r.fy0), int(r.fy1)):
                assert (x, y) not in got
                got[x, y] = r.layer_impact, r.is_source
    want = {p: (-(levels[0] + 1.0) if len(levels) == 1 else -round(sum((v + 1.0) ** 2 for v in levels) ** 0.5, 1), 0 in levels) for p, levels in expected.items()}
    assert got == want


def test_dense_tiles_are_dealt_to_many_parts(spark):
    found = overlay.faces(_copies(spark, 500), ["k"], 5.0, counted=True)
    per_part = found.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(per_part) > 1  # adaptive execution made one of so few boxes
