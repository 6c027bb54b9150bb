"""Directed river graphs: from lines to nodes, edges and widths, and the spread of pollution downstream.

A portion of pollution is (source, node, rest). It loses the cost of each edge it flows along. Where a river splits,
it divides by the mean distance of the reach that each branch offers within the rest, so what a path carries depends
on its own history: portions are followed apart and only summed by node at the end. A round takes all portions on to the
next splits of their paths, through all confluences, by one join, so there are as many rounds as splits on a path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rint
from ..tables import shared_table
from .components import components
from .regions import runs
from .spatial import first_cover, in_cells, nearest

#: Steps after which a graph is taken to run in circles without cost.
MOST_STEPS = 10_000
#: Lines that one task numbers, about.
LINES_OF_RANGE = 100_000


def vertex_pairs(lines: DataFrame, line: str = "line_id", pos: str = "pos") -> DataFrame:
    """Consecutive vertices of each line: (line, pos, x, y, x2, y2, length); the last vertex has no pair."""
    w = Window.partitionBy(line).orderBy(pos)
    out = lines.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).dropna(subset=["x2", "y2"])
    return out.withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))


def segmentised(pairs: DataFrame, most: float) -> DataFrame:
    """Vertex pairs cut into equal parts of at most ``most``."""
    n = F.greatest(F.ceil(F.col("length") / most), F.lit(1))
    out = pairs.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))

    def at(a: str, b: str, i: Column) -> Column:
        # the ends are the given vertices to the last bit, so lines still meet there
        return F.when(i == F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n"))

    cut = {"x": at("x", "x2", F.col("part")), "y": at("y", "y2", F.col("part")), "x2": at("x", "x2", F.col("part") + 1), "y2": at("y", "y2", F.col("part") + 1)}
    return out.withColumns(cut).withColumn("length", F.col("length") / F.col("_n")).drop("_n")


def interned(lines: DataFrame, line: str = "line_id", pos: str = "pos") -> DataFrame:
    """Nodes (node, x, y) of the distinct vertices; a node's number is the rank of its first vertex.

    Lines are dealt to ranges; a vertex counts those of the ranges, then of the lines, then of the vertices before it,
    so no window holds all lines.
    """
    first = lines.groupBy("x", "y").agg(F.min(F.struct(F.col(line).alias("l"), F.col(pos).alias("p"))).alias("f")).select("x", "y", "f.l", "f.p")
    first = shared_table(first, "vertices")
    per_line = first.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    n_lines = per_line.count()
    if n_lines <= LINES_OF_RANGE:  # one range
        starts = per_line.select("l", (F.sum("n").over(Window.orderBy("l")) - F.col("n")).alias("start"))
    else:
        ranged = shared_table(per_line.repartitionByRange(n_lines // LINES_OF_RANGE + 1, "l").withColumn("part", F.spark_partition_id()), "lines")
        parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))
        before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
        within = F.sum("n").over(Window.partitionBy("part").orderBy("l")) - F.col("n")
        starts = ranged.withColumn("within", within).join(before, "part").select("l", (F.col("before") + F.col("within")).alias("start"))
    return first.join(starts, "l").select((F.col("start") + F.row_number().over(Window.partitionBy("l").orderBy("p")) - 1).alias("node"), "x", "y")


def edges_of(pairs: DataFrame, nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edges (src, dst, x, y, x2, y2, length) in the direction of the lines; the shortest of parallel ones, no loops.
    Columns ``keep`` of the line come along."""
    u = nodes.select(F.col("node").alias("src"), "x", "y")
    v = nodes.select(F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = pairs.join(u, ["x", "y"]).join(v, ["x2", "y2"]).filter("src <> dst")
    return edges.groupBy("src", "dst").agg(F.min(F.struct("length", "x", "y", "x2", "y2", *(keep or []))).alias("e")).select("src", "dst", "e.*")


def cross_section(width: float | Column, dx: Column, dy: Column, x: Column, y: Column) -> list[Column]:
    """End points (ax, ay, bx, by) of a line of a width through a vertex, across the flow (dx, dy)."""
    angle = F.atan2(dy, dx) + math.pi / 2
    ox, oy = F.cos(angle) * width / 2, F.sin(angle) * width / 2
    return [x - ox, y - oy, x + ox, y + oy]


def node_widths(edges: DataFrame, widths: DataFrame, basic: float = 5.0) -> DataFrame:
    """(node, width): the least candidate width (src, dst, wu, wv; null for none) over a node's edges, or ``basic``."""
    stacked = widths.selectExpr("stack(2, src, wu, dst, wv) AS (node, width)").dropna()
    least = stacked.groupBy("node").agg(F.min("width").alias("width"))
    nodes = edges.selectExpr("explode(array(src, dst)) AS node").distinct()
    return nodes.join(least, "node", "left").select("node", F.coalesce("width", F.lit(float(basic))).alias("width"))


def section_widths(edges: DataFrame, water: DataFrame, most: float = 50_000.0, basic: float = 5.0, cell: float = 1000.0) -> DataFrame:
    """(src, dst, wu, wv): how wide the water is across each edge (x, y, x2, y2) at its ends.

    ``water`` has the boxes of bodies (water_id, bx0 .. by1). A vertex lies in the first body, by id, that covers it;
    across the edge, a line of at most ``most`` is cut by that body's boxes to intervals, those that touch are merged,
    and the one that holds the vertex is the width. A vertex in no body, or with no width there, has ``basic``.

    Lines start short and only those whose water reaches their end grow, so most meet a few cells of the grid.
    """
    u = F.struct(F.lit("u").alias("end"), F.col("src").alias("node"), F.col("x").alias("px"), F.col("y").alias("py"))
    v = F.struct(F.lit("v").alias("end"), F.col("dst").alias("node"), F.col("x2").alias("px"), F.col("y2").alias("py"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    length = F.sqrt(dx * dx + dy * dy)
    ends = edges.filter(length > 0).select("src", "dst", (-dy / length).alias("ux"), (dx / length).alias("uy"), F.explode(F.array(u, v)).alias("p")).select("src", "dst", "ux", "uy", "p.*")
    spots = ends.groupBy("node").agg(F.first("px").alias("x"), F.first("py").alias("y"))
    body = first_cover(spots, water, cell, "node", "water_id")
    left = shared_table(ends.join(body, "node").drop("node"), "sections")
    boxes = shared_table(in_cells(water.select("water_id", "bx0", "by0", "bx1", "by1"), cell, ("bx0", "by0", "bx1", "by1")), "water")
    half, found = min(cell, most) / 2, None
    while True:
        across = shared_table(_across(left, boxes, half, cell), "across")  # read for the widths and for what goes on
        last = half >= most / 2
        width = F.col("t1") - F.col("t0")
        done = across if last else across.filter((F.col("t0") > -half) & (F.col("t1") < half))
        widths = done.select("src", "dst", "end", width.alias("width"))
        found = widths if found is None else found.unionByName(widths)
        if last:
            break
        reached = across.filter((F.col("t0") <= -half) | (F.col("t1") >= half)).select("src", "dst", "end")
        left = shared_table(left.join(reached, ["src", "dst", "end"], "left_semi"), "sections")
        half = min(half * 4, most / 2)
    found = found.filter("width > 0").groupBy("src", "dst").agg(*[F.max(F.when(F.col("end") == e, F.col("width"))).alias(f"w{e}") for e in "uv"])
    return edges.select("src", "dst").join(found, ["src", "dst"], "left").select("src", "dst", *[F.coalesce(f"w{e}", F.lit(float(basic))).alias(f"w{e}") for e in "uv"])


def _across(sections: DataFrame, boxes: DataFrame, half: float, cell: float) -> DataFrame:
    """(src, dst, end, t0, t1): of the water along each section, the interval that holds its vertex, at 0."""
    ax, bx = (F.col("px") + s * half * F.abs("ux") for s in (-1, 1))  # from left to right
    rise = F.when(F.col("ux") < 0, -F.col("uy")).otherwise(F.col("uy"))
    ay, by = (F.col("py") + s * half * rise for s in (-1, 1))
    placed = sections.withColumns({"ax": ax, "bx": bx, "ay": ay, "by": by}).withColumn("cx", F.explode(F.sequence(F.floor(F.col("ax") / cell), F.floor(F.col("bx") / cell))))

    def height(x: Column) -> Column:
        return F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))

    steep = F.col("bx") - F.col("ax") < cell * 1e-6
    y0 = F.when(steep, F.col("ay")).otherwise(height(F.greatest("ax", F.col("cx") * cell)))
    y1 = F.when(steep, F.col("by")).otherwise(height(F.least("bx", (F.col("cx") + 1) * cell)))
    rows = F.sequence(F.floor(F.least(y0, y1) / cell - 1e-6), F.floor(F.greatest(y0, y1) / cell + 1e-6))
    met = placed.withColumn("cy", F.explode(rows)).drop("ax", "bx", "ay", "by").join(boxes, ["water_id", "cx", "cy"])

    def span(p: str, u: str, lo: str, hi: str) -> tuple[Column, Column]:
        inside = (F.col(p) >= F.col(lo)) & (F.col(p) <= F.col(hi))
        a, b = ((F.col(c) - F.col(p)) / F.nullif(F.col(u), F.lit(0.0)) for c in (lo, hi))
        level = F.col(u) == 0
        return F.when(level, F.when(inside, -half).otherwise(2 * half)).otherwise(F.least(a, b)), F.when(level, half).otherwise(F.greatest(a, b))

    (x0, x1), (y0, y1) = span("px", "ux", "bx0", "bx1"), span("py", "uy", "by0", "by1")
    cut = met.select("src", "dst", "end", F.greatest(x0, y0, F.lit(-half)).alias("t0"), F.least(x1, y1, F.lit(half)).alias("t1")).filter("t0 <= t1").distinct()
    return runs(cut, ["src", "dst", "end"], "t0", "t1").filter("t0 <= 0 AND t1 >= 0")


def water_graph(lines: DataFrame, water: DataFrame, segment: float = 300.0, most: float = 50_000.0, basic: float = 5.0, speed: float = 50.0, cell: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """A river network from lines (line_id, pos, x, y, and a name if there is one) and water (water_id, bx0 .. by1).

    Edges (src, dst, name, x, y, x2, y2, length, wu, wv, width, weight) are the lines cut to ``segment``, in their
    direction; nodes (node, x, y, width) have the least width across their edges. Lines of one vertex have no edge.
    """
    keep = [c for c in ("name",) if c in lines.columns]
    parts = segmentised(vertex_pairs(lines.dropna(subset=["x", "y"])), segment)
    parts = shared_table(parts.withColumn("at", F.struct("pos", "part")), "segments")
    after = F.struct("pos", (F.col("part") + 1).alias("part"))
    vertices = parts.select("line_id", "at", "x", "y").union(parts.select("line_id", after, "x2", "y2"))
    nodes = shared_table(interned(vertices, pos="at"), "nodes")
    edges = shared_table(edges_of(parts.select("x", "y", "x2", "y2", "length", *keep), nodes, keep), "edges")
    widths = shared_table(node_widths(edges, section_widths(edges, water, most, basic, cell), basic), "widths")
    return weighted(edges, widths, speed), nodes.join(widths, "node", "left").select("node", "x", "y", F.coalesce("width", F.lit(float(basic))).alias("width"))


def dissolved_edges(edges: DataFrame) -> DataFrame:
    """(remain, region, edges): edges (src, dst, remain) of equal remain that share a node are one region."""
    known = shared_table(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")
    at = known.select("edge", "remain", F.explode(F.array("src", "dst")).alias("node"))
    hub = at.groupBy("node", "remain").agg(F.min("edge").alias("least"))  # a star for each node, not all pairs
    linked = components(at.join(hub, ["node", "remain"]).select(F.col("edge").alias("src"), F.col("least").alias("dst")))
    of = known.join(linked.withColumnRenamed("node", "edge"), "edge", "left").withColumn("region", F.coalesce("component", "edge"))
    return of.groupBy("remain", "region").agg(F.count(F.lit(1)).alias("edges"))


def weighted(edges: DataFrame, widths: DataFrame, speed: float = 50.0) -> DataFrame:
    """Edges with width (mean of its ends) and weight = width * length / speed."""
    u, v = (widths.select(F.col("node").alias(n), F.col("width").alias(w)) for n, w in (("src", "wu"), ("dst", "wv")))
    out = edges.join(u, "src").join(v, "dst").withColumn("width", (F.col("wu") + F.col("wv")) / 2)
    return out.withColumn("weight", F.col("width") * F.col("length") / speed)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outs, ins)."""
    both = edges.selectExpr("stack(2, src, 1, 0, dst, 0, 1) AS (node, o, i)")
    return both.groupBy("node").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


def reaches(edges: DataFrame) -> DataFrame:
    """(head, step, node, cum): the nodes of each unbranched reach, with their distance from its head.

    A node goes on when it has one way out at most and one in; a reach ends with, and includes, the first that doesn't.
    Heads are nodes that don't go on (each a reach of its own), their children, and springs. The places within reaches
    are found by pointer doubling, so a reach of n nodes takes log2(n) joins.
    """
    deg = shared_table(degrees(edges), "degrees")
    plain = deg.filter("outs <= 1 AND ins <= 1").select(F.col("node").alias("p"))
    goes_on = edges.join(plain, edges["src"] == F.col("p"), "left_semi")
    # up[node] = the node before it in the reach, while that one goes on
    up = goes_on.select(F.col("dst").alias("node"), F.col("src").alias("anc"), F.col("cost").cast("double").alias("dist"), F.lit(1).cast("long").alias("steps"))
    up = shared_table(up, "up")
    for _ in range(64):
        above = up.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("steps").alias("steps2"))
        # a confluence may be the end of several reaches, so each of its rows is followed apart
        joined = up.join(above, "anc", "left")
        if not joined.filter("anc2 IS NOT NULL").limit(1).count():
            break
        if up.agg(F.max("steps")).first()[0] > 2 * up.count():
            raise ValueError("a reach runs in a circle")
        up = shared_table(joined.select("node", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0.0))).alias("dist"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")), "up")
    below_others = edges.join(plain, edges["src"] == F.col("p"), "left_anti").select(F.col("dst").alias("head"))
    heads = deg.filter("outs > 1 OR ins <> 1").select(F.col("node").alias("head")).union(below_others).distinct()
    own = heads.select("head", F.lit(0).cast("long").alias("step"), F.col("head").alias("node"), F.lit(0.0).alias("cum"))
    return own.union(up.select(F.col("anc").alias("head"), F.col("steps").alias("step"), "node", F.col("dist").alias("cum")))


def chains(edges: DataFrame) -> DataFrame:
    """(start, step, node, cum): the reach that begins with each child of a split."""
    splits = degrees(edges).filter("outs >= 2").select(F.col("node").alias("src"))
    starts = edges.join(splits, "src", "left_semi").select(F.col("dst").alias("head")).distinct()
    return reaches(edges).join(starts, "head", "left_semi").withColumnRenamed("head", "start")


def chain_average(chain: DataFrame, rest: float) -> DataFrame:
    """(start, mean): mean distance of the reach within ``rest``, the start's 0 included."""
    return chain.groupBy("start").agg(F.avg(F.when(F.col("cum") <= rest, F.col("cum"))).alias("mean"))


def paths(edges: DataFrame, deg: DataFrame, heads: DataFrame, most: float) -> DataFrame:
    """(head, step, node, cum): each of ``heads`` with the nodes downstream of it, up to and with the next split, within
    a distance of ``most``.

    A node with one way out goes on, whatever joins it. Jumps of 1 to 4, then of 4 to 16 steps and so on are tables,
    each made of the one before; a path of n nodes takes log4(n) of them.
    """
    single = deg.filter("outs = 1").select(F.col("node").alias("src"))
    base = edges.join(single.hint("merge"), "src").select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("cost").alias("dist")).filter(F.col("dist") <= most)
    found = heads.select("head", F.lit(0).cast("long").alias("step"), F.col("head").alias("node"), F.lit(0.0).alias("cum"))
    n_edges = edges.count()
    for k in range(31):
        four = base.select("node", F.struct("to", "dist").alias("j1"))
        for j in (2, 3, 4):
            after, far = base.select(F.col("node").alias("at"), "to", "dist"), F.col(f"j{j - 1}.dist") + F.col("dist")
            four = four.join(after.hint("merge"), F.col(f"j{j - 1}.to") == F.col("at"), "left").withColumn(f"j{j}", F.when(far <= most, F.struct("to", far.alias("dist")))).drop("at", "to", "dist")
        four = shared_table(four, "jumps")
        places = F.array(F.struct("step", "node", "cum"), *[F.when(F.col(f"j{j}").isNotNull(), F.struct((F.col("step") + j * 4**k).alias("step"), F.col(f"j{j}.to").alias("node"), (F.col("cum") + F.col(f"j{j}.dist")).alias("cum"))) for j in (1, 2, 3)])
        found = found.join(four.hint("merge"), "node", "left").select("head", F.explode(F.filter(places, lambda p: p.isNotNull() & (p["cum"] <= most))).alias("p")).select("head", "p.*")
        base = four.filter("j4 IS NOT NULL").select("node", "j4.to", "j4.dist")
        if base.isEmpty():
            return shared_table(found, "paths")
        if 4 ** (k + 1) > n_edges and not base.filter("dist = 0").isEmpty():
            break
    raise ValueError("the graph runs in circles without cost")


def propagate(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, node, remain): every portion that reaches a node; portions that carry the same there are one row.

    ``edges`` (src, dst, cost >= 0; loops are dropped, of parallel edges the cheapest stays), ``sources`` (source_id,
    node, pollution). Each round joins the portions to the paths that they enter and divides them at the next splits; a
    source of many paths is many rows, so it is no single task's work. A source outside the graph keeps its own node.
    With a column ``n``, a row stands for so many sources. Joins on nodes are merged: the small files of a large graph
    are no small broadcast.
    """
    edges = edges.filter("src <> dst AND cost IS NOT NULL").groupBy("src", "dst").agg(F.min("cost").cast("double").alias("cost"))
    edges = shared_table(edges, "edges")
    deg = shared_table(degrees(edges), "degrees")
    n = F.col("n") if "n" in sources.columns else F.lit(1)
    level = sources.select("source_id", F.col("node").cast("long").alias("head"), F.col("pollution").cast("double").alias("rest"), n.cast("long").alias("n"))
    level = shared_table(level, "sources")
    most = level.agg(F.max("rest")).first()[0] or 0.0
    ends = shared_table(edges.join(deg.filter("outs > 1").select(F.col("node").alias("src")).hint("merge"), "src"), "ends").withColumnRenamed("src", "node")
    children = ends.select(F.col("dst").alias("head")).distinct()
    ways = paths(edges, deg, children.union(level.select("head")).distinct(), most)
    # The mean distance of a branch counts its nodes up to the first that other branches join.
    joined = ways.join(children.hint("merge"), "head", "left_semi").join(deg.filter("ins > 1").select("node", F.lit(True).alias("joined")).hint("merge"), "node", "left")
    stop = F.min(F.when(F.col("joined"), F.col("step"))).over(Window.partitionBy("head"))
    reach = shared_table(joined.withColumn("stop", stop).filter("stop IS NULL OR step <= stop").select(F.col("head").alias("dst"), "cum"), "reaches")
    found = []
    for _ in range(MOST_STEPS):
        hits = level.join(ways.hint("merge"), "head").filter("cum <= rest").select("source_id", "node", (F.col("rest") - F.col("cum")).alias("remain"), "n")
        hits = shared_table(hits.groupBy("source_id", "node", "remain").agg(F.sum("n").alias("n")), "portions")
        found.append(hits)
        branches = hits.join(ends.hint("merge"), "node")
        if branches.isEmpty():
            break
        offers = branches.join(reach.hint("merge"), "dst").filter("cum <= remain")
        offers = offers.groupBy("source_id", "node", "remain", "n", "dst", "cost").agg(F.avg("cum").alias("mean"))
        total = F.sum("mean").over(Window.partitionBy("source_id", "node", "remain"))
        share = F.col("remain") * F.col("mean") / F.nullif(total, F.lit(0.0))
        level = offers.select("source_id", F.col("dst").alias("head"), (share - F.col("cost")).alias("rest"), "n").filter("rest >= 0")
    else:
        raise ValueError(f"more than {MOST_STEPS} rounds: the graph runs in circles without cost")
    out = found[0]
    for t in found[1:]:
        out = out.union(t)
    return out.select("source_id", "node", (F.col("remain") * F.col("n")).alias("remain"))


def simulate_spill(edges: DataFrame, nodes: DataFrame, sources: DataFrame, least_distance: float = 100.0, only_polluted: bool = True, cell: float | None = None) -> DataFrame:
    """(src, dst, remain) of the edges that pollution reaches; with ``only_polluted`` off, of all, 0 for the others.

    ``edges`` (src, dst, cost), ``nodes`` (node, x, y), ``sources`` (source_id, x, y, pollution). A source flows from
    its nearest node when that is at most ``least_distance`` away; an edge has the mean of its ends.
    """
    spots = nearest(sources, nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny")), "source_id", "node", cell)
    at = sources.join(spots.filter(F.col("dist") <= least_distance).select("source_id", "node"), "source_id").select("source_id", "node", "pollution")
    polluted = shared_table(spilled(edges, at), "remain")
    return edge_remain(edges, polluted, only_polluted)


def spilled(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, remain): what reaches each node of all sources, as the sum of ``propagate``.

    Who sent a portion is left out, so portions that carry the same at a node are one row with their number, whichever
    sources they come from."""
    alike = sources.groupBy("node", "pollution").agg(F.count(F.lit(1)).alias("n")).withColumn("source_id", F.lit(0).cast("long"))
    return remain_by_node(propagate(edges, alike))


def remain_by_node(portions: DataFrame) -> DataFrame:
    return portions.groupBy("node").agg(F.sum("remain").alias("remain"))


def edge_remain(edges: DataFrame, nodes: DataFrame, only_polluted: bool = True) -> DataFrame:
    """(src, dst, remain): the mean of the ends of edges that are both polluted; of others 0, or no row."""
    u, v = (nodes.select(F.col("node").alias(n), F.col("remain").alias(r)) for n, r in (("src", "ru"), ("dst", "rv")))
    how = "inner" if only_polluted else "left"
    both = edges.select("src", "dst").distinct().join(u.hint("merge"), "src", how).join(v.hint("merge"), "dst", how)
    return both.select("src", "dst", F.coalesce((F.col("ru") + F.col("rv")) / 2, F.lit(0.0)).alias("remain"))


def conditional_mean(value: Column) -> Column:
    """Aggregate: mean of the positive values, 0 when there are none."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0))


def r6(x: Column) -> Column:
    return rint(x, 6)
