"""Spatial joins on bounding boxes: equi-joins on grid cells, exact on axis-aligned boxes, refined for other shapes.

Every box is put into each grid cell that it touches and the join runs on the cell. A pair that meets in several cells
is kept in one of them only - the cell with the lower left corner of the intersection - so no distinct is needed.
Places at which many rows lie are searched once, and their rows put back by joins on the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared_table

BOX = ("x0", "y0", "x1", "y1")


def in_cells(df: DataFrame, cell: float, box: tuple[str, str, str, str] = BOX, prefix: str = "") -> DataFrame:
    """One row for each grid cell that a box touches, in columns {prefix}cx and {prefix}cy."""
    x0, y0, x1, y1 = (F.col(c) for c in box)

    def span(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))

    return df.withColumn(f"{prefix}cx", span(x0, x1)).withColumn(f"{prefix}cy", span(y0, y1))


#: Rows in a list, and of a place that a join holds at once; parts for each core.
LIST, PARTS = 1024, 4


def _numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with a number, from 0, for each ``LIST`` rows of one key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or key))) - 1) / LIST))


def listed(rows: DataFrame, key: list[str], name: str = "_rows") -> DataFrame:
    """Rows of one ``key`` as lists of at most ``LIST``: the key, the number ``_n`` of the list, and ``name``."""
    rest = [c for c in rows.columns if c not in key]
    found = F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(0).alias("_")))
    if len(rest) == 1:
        found = F.transform(found, lambda row: row[rest[0]])
    return _numbered(rows, key, "_n").groupBy(*key, "_n").agg(found.alias(name))


def unlisted(df: DataFrame, rest: list[str], name: str = "_rows") -> DataFrame:
    """A row for each of a list of ``listed``, with its columns ``rest`` first."""
    others = [c for c in df.columns if c != name]
    if len(rest) == 1:
        return df.select(F.explode(name).alias(rest[0]), *others)
    return df.select(F.explode(name).alias(name), *others).select(*[F.col(name)[c].alias(c) for c in rest], *others)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, in a fixed number of parts: of such rows far more are made than they are, so parts that adaptive
    execution joined by their size would be too large."""
    spark = df.sparkSession
    return df.repartition(max(PARTS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def places(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each different ``key``, with the number of times that it has ``LIST`` rows, or begins to, in ``_lists``."""
    return rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("_lists"))


def put_back(found: DataFrame, rows: DataFrame, key: list[str], lists: str | None = None, rest: list[str] | None = None) -> DataFrame:
    """``found`` of ``places``, by the numbers in ``key``, with the rows of each place put back.

    A row of ``found`` goes once to each ``LIST`` rows of its place and meets one after the other; they are all that is
    held at once, and a place of many rows is many parts' work. Values of ``found`` come in runs, and the rows in the
    same order again and again, so files of pairs stay small. ``lists`` and ``rest`` are a column of lists in ``found``,
    opened after its rows were dealt, and what is in them.
    """
    # A string, as Spark would deal numbers that aren't whole once more for the join.
    at = F.concat(*[part for c in (*key, "_n") for part in ((F.col(c) + F.lit(0)).cast("string"), F.lit(" "))])
    here = dealt(_numbered(rows, key, "_n").withColumn("_at", at).drop(*key, "_n"), "_at")
    each = found.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lists") - 1)))
    there = dealt(each.withColumn("_at", at).drop("_n", "_lists"), "_at")
    return (there if lists is None else unlisted(there, rest, lists)).join(here.hint("merge"), "_at").drop("_at")


def box_join(left: DataFrame, right: DataFrame, cell: float, how: str = "inner", predicate: str = "intersects", left_box=("x0", "y0", "x1", "y1"), right_box=("bx0", "by0", "bx1", "by1"), refine: Column | None = None, left_id: str | None = None, copies: bool = False) -> DataFrame:
    """Pairs of boxes; the two sides must have different column names.

    ``predicate`` is ``intersects`` (touching counts), ``within`` (left inside right) or ``overlaps`` (a common area).
    ``how``: inner, left_semi, left_anti, or left (which needs ``left_id``, a unique column of the left side).
    ``refine`` is a further exact condition, for shapes that aren't boxes.
    ``copies``, for inner joins without ``refine``: each different box is compared once, and the rows of equal boxes are
    put back by joins on the box, those of the right side as lists, so only pairs that belong to the result are made of
    them, and none is shuffled.
    """
    if copies:
        if how != "inner" or refine is not None:
            raise ValueError("copies are for inner joins without refine")
        own = [c for c in right.columns if c not in right_box]
        met = box_join(places(left, list(left_box)), right.select(*right_box).distinct(), cell, how, predicate, left_box, right_box)
        found = met.join(listed(right, list(right_box), "_theirs").drop("_n").hint("merge"), list(right_box))
        return put_back(found, left, list(left_box), "_theirs", own).select(*left.columns, *right.columns)
    ax0, ay0, ax1, ay1 = (F.col(c) for c in left_box)
    bx0, by0, bx1, by1 = (F.col(c) for c in right_box)
    test = {
        "intersects": (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1),
        "overlaps": (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1),
        "within": (ax0 >= bx0) & (ax1 <= bx1) & (ay0 >= by0) & (ay1 <= by1),
    }[predicate]
    if refine is not None:
        test = test & refine
    a, b = in_cells(left, cell, left_box, "_l"), in_cells(right, cell, right_box, "_r")
    meet = (F.col("_lcx") == F.col("_rcx")) & (F.col("_lcy") == F.col("_rcy"))
    own = (F.floor(F.greatest(ax0, bx0) / cell) == F.col("_lcx")) & (F.floor(F.greatest(ay0, by0) / cell) == F.col("_lcy"))
    helpers = ("_lcx", "_lcy", "_rcx", "_rcy")
    if how == "inner":
        return a.join(b, meet & test & own).drop(*helpers)
    if how not in ("left", "left_semi", "left_anti"):
        raise ValueError(how)
    if left_id is None:
        raise ValueError("left_id names a unique column of the left side")
    pairs = a.join(b, meet & test & own).drop(*helpers)
    if how == "left":
        found = pairs.select(F.col(left_id).alias("_id"), *right.columns)
        return left.join(found, left[left_id] == F.col("_id"), "left").drop("_id")
    return left.join(pairs.select(F.col(left_id).alias("_id")).distinct(), left[left_id] == F.col("_id"), how)


def first_cover(points: DataFrame, boxes: DataFrame, cell: float, point_id: str, box_id: str) -> DataFrame:
    """(point_id, box_id) of the first box, by id, that covers each point (columns x, y; bx0 .. by1).

    Of equal boxes only the first is looked at, and points of one place are looked up once. In a cell that a box covers
    wholly no later box can be first, so those go before points are compared; then in cells a quarter as wide.
    """
    box = ("bx0", "by0", "bx1", "by1")
    first = boxes.groupBy(*box).agg(F.min(box_id).alias(box_id))

    def pruned(dealt: DataFrame, side: float) -> DataFrame:
        # well beyond the cell, so that rounding puts no point beside the box
        over = [F.col(lo) <= F.col(c) * side - side * 1e-6 for lo, c in (("bx0", "_cx"), ("by0", "_cy"))] + [F.col(hi) >= (F.col(c) + 1) * side + side * 1e-6 for hi, c in (("bx1", "_cx"), ("by1", "_cy"))]
        least = dealt.filter(over[0] & over[1] & over[2] & over[3]).groupBy("_cx", "_cy").agg(F.min(box_id).alias("_least"))
        return dealt.join(least, ["_cx", "_cy"], "left").filter(F.col("_least").isNull() | (F.col(box_id) <= F.col("_least"))).drop("_least")

    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(lo, hi))

    fine, big = cell / 4, pruned(in_cells(first, cell, box, "_"), cell)
    for c, lo, hi in (("_cx", "bx0", "bx1"), ("_cy", "by0", "by1")):
        big = big.withColumn(c, cells(F.greatest(F.col(c) * 4, F.floor(F.col(lo) / fine)), F.least(F.col(c) * 4 + 3, F.floor(F.col(hi) / fine))))
    few = shared_table(pruned(big, fine), "covers")
    places = points.select("x", "y").distinct().withColumns({"_cx": F.floor(F.col("x") / fine), "_cy": F.floor(F.col("y") / fine)})
    holds = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    found = places.join(few, ["_cx", "_cy"]).filter(holds).groupBy("x", "y").agg(F.min(box_id).alias(box_id))
    return points.select(point_id, "x", "y").join(found, ["x", "y"]).groupBy(point_id).agg(F.min(box_id).alias(box_id))


def nearest(points: DataFrame, nodes: DataFrame, point_id: str, node_id: str, cell: float | None = None) -> DataFrame:
    """(point_id, node_id, dist) of the nearest node of each point; the least id on ties.

    Nodes (columns nx, ny) in a point's cell and the eight around it are searched first: a hit no further than a cell
    is final. Points without one go on with cells eight times as wide, until each has its node. A round writes the
    points that are left, so none is worked out twice. Without ``cell``, it is chosen so that some 20 nodes lie in nine
    cells. Points with a null coordinate get no row. Points of one place are looked up once, and of the nodes of one place
    only that of least id is looked at.
    """
    at = points.select(point_id, "x", "y").dropna(subset=["x", "y"])
    kind = nodes.schema[node_id].dataType
    nodes = shared_table(nodes.groupBy("nx", "ny").agg(F.min(node_id).alias(node_id)), "places")
    bounds = nodes.agg(F.min("nx").alias("a"), F.max("nx").alias("b"), F.min("ny").alias("c"), F.max("ny").alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"]:
        return at.select(point_id, F.lit(None).cast(kind).alias(node_id), F.lit(None).cast("double").alias("dist"))
    if cell is None:
        sides = bounds["b"] - bounds["a"], bounds["d"] - bounds["c"]
        cell = 1.5 * max((sides[0] * sides[1] / bounds["n"]) ** 0.5, max(sides) / bounds["n"]) or 1.0
    reach = at.agg(F.max(F.greatest(F.abs(F.col("x") - bounds["a"]), F.abs(F.col("x") - bounds["b"]), F.abs(F.col("y") - bounds["c"]), F.abs(F.col("y") - bounds["d"])))).first()[0] or 0.0
    found, left = None, shared_table(at.select("x", "y").distinct(), "left")
    while True:
        last = cell > reach
        around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
        cells = left.withColumn("dx", around).withColumn("dy", around)
        cells = cells.withColumns({"cx": F.floor(F.col("x") / cell) + F.col("dx"), "cy": F.floor(F.col("y") / cell) + F.col("dy")}).drop("dx", "dy")
        dealt = nodes.select(F.col(node_id), "nx", "ny", F.floor(F.col("nx") / cell).alias("cx"), F.floor(F.col("ny") / cell).alias("cy"))
        dist = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
        best = cells.join(dealt, ["cx", "cy"]).groupBy("x", "y").agg(F.min(F.struct(dist.alias("dist"), F.col(node_id))).alias("m"))
        best = best.select("x", "y", F.col(f"m.{node_id}").alias(node_id), F.col("m.dist").alias("dist"))
        best = best if last else shared_table(best.filter(F.col("dist") <= cell), "nearest")
        found = best if found is None else found.union(best)
        if not last:
            left = shared_table(left.join(best, ["x", "y"], "left_anti"), "left")
        if last or left.isEmpty():
            break
        cell *= 8
    least = at.join(found, ["x", "y"]).groupBy(point_id).agg(F.min(F.struct("dist", node_id)).alias("m"))
    return least.select(point_id, F.col(f"m.{node_id}").alias(node_id), F.col("m.dist").alias("dist"))
