"""Connected components, and objects merged by a buffer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sign_collapse
from ..tables import shared_table
from .spatial import box_join


#: Edges up to which components are found in one task, which holds them all.
ONE_TASK = 200_000


def _united(batches) -> Iterator:
    """Components of all edges of one task, by union-find."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, b_ = find(u), find(v)
            root[max(a, b_)] = min(a, b_)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (src, dst long): (node, component), the least node's id.

    At most ``ONE_TASK`` different edges go to one task. More take large-star and small-star steps by turns (Kiveris et
    al. 2014) until nothing changes; each round is a written table, and the hub of a large component is a skewed join
    key that adaptive execution splits. Both ways give the same rows; loops are left out.
    """
    def star(pairs: DataFrame) -> DataFrame:
        # Written first, so the join has plain shuffles on both sides and a hub's rows can be split.
        least = shared_table(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        return pairs.join(least, "u")

    def state(t: DataFrame):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    now, was = shared_table(now, "edges"), None
    if now.count() <= ONE_TASK:
        return shared_table(now.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    while (is_ := state(now)) != was:
        was = is_
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        joined = star(large)
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = shared_table(small, "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def buffer_components(boxes: DataFrame, buffer: float, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(source_id, component) of boxes that touch when each is widened by ``buffer``; with equal ``keys`` only."""
    keys = keys or []
    place = [*keys, "x0", "y0", "x1", "y1"]
    firsts = boxes.groupBy(*place).agg(F.min(F.col("source_id").cast("long")).alias("place"))  # equal boxes always touch
    firsts = shared_table(firsts, "places")
    wide = firsts.select("place", *keys, *[(F.col(c) + s * buffer).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    other = wide.select(F.col("place").alias("b_id"), *[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    same = F.col("place") < F.col("b_id")
    for k in keys:
        same = same & (F.col(k) == F.col(f"b_{k}"))
    edges = box_join(wide, other, cell, refine=same).select(F.col("place").alias("src"), F.col("b_id").alias("dst"))
    found = components(edges)
    of = firsts.join(found, F.col("place") == F.col("node"), "left").select(*place, F.coalesce("component", "place").alias("component"))
    own = F.col("source_id").cast("long")
    return boxes.select("source_id", *place).join(of, place, "left").select("source_id", F.coalesce("component", own).alias("component"))


def merged_by_buffer(boxes: DataFrame, buffer: float, cell: float, keys: list[str] | None = None, collapsed: list[str] | None = None) -> DataFrame:
    """The boxes of each component, a row for each place: component, sorted distinct names, the impact that its members
    agree on, how many they are, and x0 .. y1 of the place. An object of several boxes is as large as they are together.
    Columns ``collapsed`` are brought to one value as impacts are.
    """
    collapsed = collapsed or []
    keys = keys or []
    of = boxes.join(buffer_components(boxes, buffer, cell, keys), "source_id")
    facts = of.groupBy(*keys, "component").agg(F.array_sort(F.collect_set("name")).alias("names"), sign_collapse(F.col("impact")).alias("impact"), F.count(F.lit(1)).alias("n"), *[sign_collapse(F.col(c)).alias(c) for c in collapsed])
    return of.select(*keys, "component", "x0", "y0", "x1", "y1").distinct().join(facts, [*keys, "component"]).select(*keys, "component", "names", "impact", "n", *collapsed, "x0", "y0", "x1", "y1")


def collapsed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every other column of ``df`` as its distinct values in order, nulls left out: one row for each of ``keys``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in rest])


def collected(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every other column of ``df`` as the list of its values, nulls kept, in the order of the rows by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))), lambda r: r["row"])
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, *[F.col("_rows")[c].alias(c) for c in rest])
